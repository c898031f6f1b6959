"""R-style model formulas as lists of terms.

`y ~ 1 + cat(type) * load + spl(speed, 5) + circspl(hour, 6, 0, 24) + 2dspl(x, y, 4)`. A star stands for
both sides and their product, a colon for the product. The intercept is implied unless `-1` or `0`
is written. Main effects come in order of their names, then products by order, then splines as
written; inside a product names are in order, too.
"""

from __future__ import annotations

import ast
import math
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Spline:
    kind: str  # default, circular, 2d, custom
    variables: tuple[str, ...]
    n: int
    bounds: tuple[float, float] | None = None
    function: Callable | None = None  # custom: (values, knots) -> rows of functions

    @property
    def name(self) -> str:
        return "_".join(self.variables) if self.kind == "2d" else self.variables[0]


@dataclass
class Formula:
    response: str
    intercept: bool = True
    terms: list[tuple[str, ...]] = field(default_factory=list)  # products of variables; of one: a main effect
    categorical: set[str] = field(default_factory=set)
    splines: list[Spline] = field(default_factory=list)

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys([v for t in self.terms for v in t] + [v for s in self.splines for v in s.variables]))


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}


def number(text: str) -> float:
    """A plain arithmetic expression; pi is known."""

    def of(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](of(node.left), of(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -of(node.operand)
        if isinstance(node, ast.Name) and node.id == "pi":
            return math.pi
        raise FormulaError(f"not a number: {text}")

    try:
        return of(ast.parse(text, mode="eval").body)
    except SyntaxError as e:
        raise FormulaError(f"not a number: {text}") from e


_CALL = re.compile(r"(2dspl|circspl|spl|cat)\(([^()]*(?:\([^()]*\)[^()]*)*)\)")


def parse(text: str) -> Formula:
    """Raises FormulaError for an empty side, an unknown function or a spline inside a product."""
    flat = re.sub(r"\s+", "", text)
    if flat.count("~") != 1:
        raise FormulaError("a formula has one ~")
    response, right = flat.split("~")
    if not right:
        raise FormulaError("nothing right of ~")
    out = Formula(response or "y")

    def call(m: re.Match) -> str:
        name, args = m[1], m[2].split(",")
        if name == "cat":
            out.categorical.add(args[0])
            return args[0]
        if m.string[m.end() : m.end() + 1] in ("*", ":") or m.string[m.start() - 1 : m.start()] in ("*", ":"):
            raise FormulaError(f"a spline cannot be part of a product: {m[0]}")
        if name == "2dspl":
            out.splines.append(Spline("2d", (args[0], args[1]), int(number(args[2]))))
        elif name == "circspl":
            out.splines.append(Spline("circular", (args[0],), int(number(args[1])), (number(args[2]), number(args[3]))))
        else:
            out.splines.append(Spline("default", (args[0],), int(number(args[1]))))
        return "@"

    plain = _CALL.sub(call, right)
    if "(" in plain:
        raise FormulaError(f"unknown function in {text}")
    terms: dict[tuple[str, ...], None] = {}
    for sign, body in re.findall(r"([+-]?)([^+-]+)", plain):
        drop = sign == "-"
        if body in ("@", ""):
            continue
        if body in ("1", "0"):
            out.intercept = (body == "1") != drop
            continue
        groups: list[tuple[str, ...]] = []
        for factor in body.split("*"):
            names = tuple(sorted(set(factor.split(":"))))
            groups += [tuple(sorted(set(g + names))) for g in groups] + [names]
        for g in groups:
            if drop:
                terms.pop(g, None)
            else:
                terms[g] = None
    bad = [v for t in terms for v in t if not re.fullmatch(r"[A-Za-z_]\w*", v)]
    if bad:
        raise FormulaError(f"not a variable: {bad[0]}")
    out.terms = sorted(terms, key=lambda t: (len(t), t))
    return out
