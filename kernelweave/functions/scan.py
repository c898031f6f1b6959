"""Running sums, maxima and neighbours along an order, in two levels: inside tiles, and from tile to tile.

A window over a whole group is one task however long the group is. Here rows are dealt to tiles of their order's first key; each
tile is a window of its own, and what stands before a tile comes from one row for each tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of the first key of an order that one tile spans.
TILE = 16_384


def scan(df: DataFrame, by: list[str], order: list[str], what: dict[str, tuple[str, Column | str]], tile: int = TILE) -> DataFrame:
    """df with a column for each name in what: (kind, column) over the rows of by's group that stand before, in order.

    kind: sum (0 where none stands before), max, min, last (the row just before), next (the row just after). The first key of
    order is a number; a group is dealt to tiles of it. Rows that are equal in all keys have no order.
    """
    own = [f"_{k}_" for k in what]
    rows = df.withColumn("_tile", F.floor(F.col(order[0]) / F.lit(tile))).withColumns({o: F.col(c) if isinstance(c, str) else c for o, (_, c) in zip(own, what.values(), strict=True)})
    keys = F.struct(*order)
    of_tile = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.max_by(c, keys), "next": lambda c: F.min_by(c, keys)}
    tiles = rows.groupBy(*by, "_tile").agg(*[of_tile[kind](o).alias(o) for o, (kind, _) in zip(own, what.values(), strict=True)])
    before = W.partitionBy(*by).orderBy("_tile")  # a row for each tile
    upto = before.rowsBetween(W.unboundedPreceding, -1)
    carried = {"sum": lambda c: F.sum(c).over(upto), "max": lambda c: F.max(c).over(upto), "min": lambda c: F.min(c).over(upto), "last": lambda c: F.lag(c).over(before), "next": lambda c: F.lead(c).over(before)}
    tiles = tiles.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_tile").alias("_of"), *[carried[kind](o).alias(f"{o}carried") for o, (kind, _) in zip(own, what.values(), strict=True)])
    on = F.col("_tile") == F.col("_of")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    inside = W.partitionBy(*by, "_tile").orderBy(*order)
    within = inside.rowsBetween(W.unboundedPreceding, -1)
    at = {
        "sum": lambda o: F.sum(o).over(within), "max": lambda o: F.max(o).over(within), "min": lambda o: F.min(o).over(within),
        "last": lambda o: F.lag(F.struct(o)).over(inside), "next": lambda o: F.lead(F.struct(o)).over(inside),
    }
    rows = rows.withColumns({f"{o}in": at[kind](o) for o, (kind, _) in zip(own, what.values(), strict=True)}).join(tiles, on, "left")
    out = {}
    for name, o, (kind, _) in zip(what, own, what.values(), strict=True):
        here, there = F.col(f"{o}in"), F.col(f"{o}carried")
        if kind == "sum":
            out[name] = F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        elif kind in ("max", "min"):
            out[name] = (F.greatest if kind == "max" else F.least)(here, there)
        else:
            # a neighbour that is null is another thing than none in this tile
            out[name] = F.when(here.isNotNull(), here[o]).otherwise(there)
    return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])
