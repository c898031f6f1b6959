"""Main text of web pages by line-block distribution.

Markup is cut into lines: one for each block, its character references decoded, its white space
one space. A line weighs its characters; one inside menus, headers, footers, sidebars, notices,
adverts, forms or reader comments, or that is mostly links, weighs none. A class or id alone does not put an article or main element inside it
outside, unless the page has another article or more text elsewhere. Where the page marks
its article, lines outside weigh none. The weights are summed over windows of WINDOW lines; text
begins where the sums surge to SURGE characters or, on a page that never has so many together, to the most it has
(inside a marked article from nothing to any), and lasts until they dive to nothing. Of all such stretches and
what lies between them the lines that weigh are the text.

Null and empty pages have no text. Broken markup ends at the page's end; of silent elements without an end tag only the start tag goes; unclosed blocks end where the next
begins. Nothing is cut from long pages. Rows stay, repeated ones too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 80

# fixed values: element names by their part in a page
SILENT = frozenset("script style noscript template svg math iframe object embed canvas select option textarea button head title audio video map".split())
ASIDE = frozenset("nav header footer aside form dialog menu fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: In class, id or role: parts that are not the article.
BOILERPLATE = re.compile(
    r"(?<![a-z])(ads?|adverts?|advertisement|advertising|sponsor(ed)?|promo(tion)?s?|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|signup|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|footer|header|masthead|topbar|toolbar|share|sharing|social|related|recommend(ed|ations)?|"
    r"comments?|disqus|respond|replies|reply|pagination|pager|popup|modal|overlay|widget|skip|search|form|complementary|contentinfo)(?![a-z])"
)
ARTICLE = re.compile(r"(?<![a-z])(article|main|post|entry|content|story)(?![a-z])")
#: The header of an article holds its title.
_TITLE = re.compile(r"(?:article|post|entry|story)-header\Z")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
#: Elements whose content is never markup; without an end tag they last to the page's end.
RAW = frozenset("script style textarea title".split())
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
#: Tokens of class and id that tell of a layout, not of what the element holds.
_LAYOUT = re.compile(r"(?:^|\s)(?:has|no|not|with|without|hide|show)-[^\s]*|[^\s]*-(?:off|on|none|disabled|enabled|free)(?=\s|\Z)")
_ATTRS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WHITE = re.compile(r"\s+")
#: Elements whose names say enough.
_EXEMPT = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())


class _Open:
    __slots__ = ("name", "aside", "soft", "outer", "article")

    def __init__(self, name: str, aside: bool, soft: int, outer: int, article: int):
        self.name, self.aside, self.soft, self.outer, self.article = name, aside, soft, outer, article


def _marks(name: str, attrs: str) -> tuple[bool, bool, int]:
    """(outside the article, outside by class or id alone; 2: the article's own element, 1: one named like it)."""
    aside, soft, article = name in ASIDE, False, 2 * (name in ("article", "main"))
    if attrs.strip():
        for key, value in _ATTRS.findall(attrs):
            value = value.strip("\"'").lower()
            if key.lower() == "hidden" or (key.lower() == "aria-hidden" and value == "true"):
                aside = True
            elif name not in _EXEMPT:
                tokens = _LAYOUT.sub(" ", value.replace("_", "-")).split()
                if any(BOILERPLATE.search(w) and not _TITLE.search(w) for w in tokens):
                    soft, aside = soft or key.lower() != "role", aside or key.lower() == "role"
                elif name in ("div", "section", "td") and ARTICLE.search(value):
                    article = max(article, 1)
    return aside, soft, article


def lines(page: str) -> list[tuple[str, bool, int, int, int]]:
    """(text, outside, how the article is marked, characters in links, containers around the article that are outside by class or id alone) of each block."""
    out: list[tuple[str, bool, int, int, int]] = []
    stack: list[_Open] = []
    endless: set[str] = set()  # elements of which no further end tag follows
    parts: list[str] = []
    links = linked = 0

    def end_block() -> None:
        nonlocal linked
        text = _WHITE.sub(" ", "".join(parts)).strip()
        if text:
            top = stack[-1] if stack else None
            out.append((text, bool(top and (top.aside or top.soft)), top.article if top else 0, linked, top.outer if top else 0))
        parts.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(html.unescape(text))
            linked += len(text) if links else 0
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if name == "a":
                links = max(links - 1, 0)
            if name in BLOCKS:
                end_block()
            if any(o.name == name for o in stack):
                while stack.pop().name != name:
                    pass
            continue
        if name in SILENT and name not in VOID:
            if name not in ("head",):
                if name in RAW or not (name in endless or _SELF_CLOSED.search(m["attrs"])):
                    end = re.compile(rf"</{name}(?=[\s>/]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                    if end or name in RAW:
                        at = end.end() if end else n
                    else:
                        endless.add(name)
                if name in BLOCKS or name in ("script", "style"):
                    end_block()
                continue
        if name in BLOCKS:
            end_block()
            # an open paragraph, item or cell ends where another block begins
            if stack and stack[-1].name == "p" or (stack and name == stack[-1].name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                stack.pop()
        if name == "a":
            links += 1
        if name in VOID or m["attrs"].rstrip().endswith("/"):
            links -= name == "a"
            continue
        if name in BLOCKS:
            aside, own, article = _marks(name, m["attrs"] or "")
            top = stack[-1] if stack else None
            soft, outer = (top.soft, top.outer) if top else (0, 0)
            if article == 2:
                soft, outer = 0, outer + soft  # an article clears what only names put outside
            stack.append(_Open(name, aside or bool(top and top.aside), soft + own, outer, max(article, top.article if top else 0)))
    end_block()
    return out


def main_text(page: str | None) -> str:
    found = lines(page or "")
    # articles in containers that are outside by name count only where the page has no other and less text elsewhere
    level = min((outer for _, aside, article, _, outer in found if not aside and article), default=0)
    if level:
        inner = sum(len(text) for text, aside, article, _, outer in found if not aside and article and outer == level)
        if sum(len(text) for text, aside, article, linked, _ in found if not aside and not article and linked <= 0.5 * len(text)) >= inner:
            level = 0
    marked = max((article for _, aside, article, _, outer in found if not aside and outer <= level), default=0)
    size = []
    for text, aside, article, linked, outer in found:
        counts = not aside and outer <= level and article >= marked and (marked or linked <= 0.5 * len(text))
        size.append(len(text) if counts else 0)
    lo, hi = surge_to_dive(size, 1 if marked else SURGE)
    return "\n".join(found[i][0] for i in range(lo, hi) if size[i])


def surge_to_dive(size: list[int], least: int) -> tuple[int, int]:
    """From the first line whose window surges to `least` (or the page's fullest window) to the last before a dive."""
    sums = [sum(size[i : i + WINDOW]) for i in range(len(size))]
    least = min(least, max(sums, default=0))
    surges = [i for i, n in enumerate(size) if n and sums[i] >= least]
    if not surges:
        return 0, 0
    dive = surges[-1]
    while dive < len(sums) and sums[dive]:
        dive += 1
    return surges[0], dive


def extract(pages: Column) -> Column:
    """string: the main text of each whole page."""

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    return of(pages)
