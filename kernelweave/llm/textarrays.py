"""Whole texts as numpy arrays: UTF-8 bytes, code points, words, pre-tokens and their 64-bit hashes.

All functions take many texts at once; callers pass slices of bounded size (`slices`).
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def slices(texts: pa.Array, max_bytes: int = 1 << 19) -> Iterator[pa.Array]:
    """Parts of texts of about max_bytes; a longer text is a part of its own."""
    if len(texts) == 0:
        return
    sizes = np.diff(utf8(texts)[1])
    part = (np.cumsum(sizes) - sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield texts.slice(lo, hi - lo)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    lo, hi = int(offs[0]), int(offs[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return raw, offs - lo


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, twice)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA5CB9243F13A8E6D)
    h ^= h >> U64(32)
    return h


#: A prime and two bases: a span's hash is its polynomial's values at both, about 62 bits.
_PRIME, _BASES = (1 << 31) - 1, (1_374_907_163, 732_590_081)
_P = U64(_PRIME)
_held: list[list[np.ndarray]] = [[np.ones(1, U64), np.ones(1, U64)] for _ in _BASES]


def _powers(n: int) -> list[list[np.ndarray]]:
    """Of each base the powers 0..n and their inverses; the longest so far are kept."""
    for held, base in zip(_held, _BASES, strict=True):
        for i, b in enumerate((base, pow(base, -1, _PRIME))):
            while len(held[i]) <= n:
                held[i] = np.concatenate([held[i], held[i] * U64(pow(b, len(held[i]), _PRIME)) % _P])
    return _held


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span, from prefix sums modulo a prime; it depends on nothing outside the span.

    64-bit values stand for hashes, whose halves go to one base each; smaller ones are taken as they are.
    """
    out = (ends - starts).astype(U64) * _ODD
    wide = values.dtype == U64
    for lane, (power, inverse) in enumerate(_powers(len(values))):
        lanes = (values >> U64(33) if lane else values & _P) if wide else values.astype(U64)
        sums = np.zeros(len(values) + 1, U64)
        np.cumsum(lanes * power[: len(values)] % _P, out=sums[1:])
        out = mix(out + (sums[ends] - sums[starts]) % _P * inverse[starts] % _P)
    return out


@functools.cache
def _byte_values() -> np.ndarray:
    v = (mix(np.arange(1, 257, dtype=U64) * _ODD) % _P).astype(np.uint32)
    v[ord("A") : ord("Z") + 1] = v[ord("a") : ord("z") + 1]
    return v


@functools.cache
def _white_bytes() -> np.ndarray:
    white = np.zeros(256, bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    return white


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words [^\\x20\\x09-\\x0D]+, and for each text the index of its first word (and the end).

    breaks: for each byte whether it ends words instead.
    """
    inside = ~(_white_bytes() if breaks is None else breaks)[data]
    n = len(data)
    cut = offsets[(offsets > 0) & (offsets < n)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word, with A-Z in lower case."""
    return span_hashes(_byte_values()[data], starts, ends)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all width-word shingles, text by text, and where each text's begin.

    A text of 1 to width-1 words has one shingle, the whole sequence; one without words has none.
    """
    counts = np.diff(first)
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(many)])
    pos = np.repeat(first[:-1] - at[:-1], many) + np.arange(at[-1])
    size = np.repeat(np.minimum(counts, width), many)
    out = size.astype(U64) * _ODD
    for k in range(width):
        has = size > k
        w = hashes[np.minimum(pos + k, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(len(pos), U64)
        out += np.where(has, mix(w + U64((k + 1) * int(_ODD) & 0xFFFFFFFFFFFFFFFF)), U64(0))
    return mix(out), at


def distinct_sorted(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each text."""
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        v = np.sort(values[lo:hi])
        out.append(v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v)
    return out


# ---- code points and pre-tokens

LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
EDGE_POINT = 0x110000  # stands between texts


@functools.cache
def point_classes() -> np.ndarray:
    out = np.full(EDGE_POINT + 1, OTHER, np.uint8)
    for p in range(0x110000):
        kind = unicodedata.category(chr(p))[0]
        if kind == "L":
            out[p] = LETTER
        elif kind == "N":
            out[p] = NUMBER
    # fixed values: the Unicode White_Space property
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    out[EDGE_POINT] = EDGE
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points with EDGE_POINT after each text, and where each text begins (and the end)."""
    edge = np.uint32(EDGE_POINT).tobytes()
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"".join(x + edge for x in raw), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(x) // 4 + 1 for x in raw], dtype=np.int64)]).astype(np.int64)


def pretokens(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens that the pattern of byte-level BPE finds:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    from class runs: the last white space before a run stands alone or, if it is a blank,
    joins the run; a lone apostrophe takes a contraction's letters.
    """
    kind = point_classes()[points]
    n = len(points)
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    edge = kind == EDGE
    run = start.copy()
    # the last white space of a run that text follows
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero(points[:-1] == 0x27)
    quote = quote[start[quote] & run[quote] & (kind[quote + 1] == LETTER)]
    if len(quote):
        a, b = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two & ~one] + 3] = True
    start[:-1] |= edge
    start[n] = True
    starts = np.flatnonzero(start)
    starts, ends = starts[:-1], starts[1:]
    keep = ~edge[starts]
    return starts[keep], ends[keep]


def span_bytes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The UTF-8 bytes of points[start:end] for each span."""
    size = ends - starts
    upto = np.concatenate([[0], np.cumsum(size)])
    mine = points[np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])]
    mine = np.where((mine >= 0xD800) & (mine < 0xE000), np.uint32(ord("?")), mine)
    wide = np.concatenate([[0], np.cumsum(1 + (mine >= 0x80) + (mine >= 0x800) + (mine >= 0x10000))])
    raw, cuts = mine.tobytes().decode("utf-32-le").encode(), wide[upto].tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
