"""Byte-level BPE encoding by speculation and verification, and decoding.

Each distinct pre-token is cut greedily into longest vocabulary entries. The cut is the exact
encoding if and only if every adjacent pair is stable: no merge crosses the border at any time
while both sides grow from bytes. All adjacent pairs are tested at once on arrays; only
pre-tokens with an unstable pair are merged exactly, rank by rank.

Null texts encode to no ids and decode to the empty text; ids outside the vocabulary are
skipped when decoding; bytes that are no UTF-8 decode to U+FFFD. Long texts are whole. Columns
are added to the given frame, whose others, and rows, stay as they are.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.llm import textarrays as ta

#: Distinct pre-tokens that a Python worker remembers; beyond it, it starts anew.
MAX_REMEMBERED = 500_000
#: It starts anew also where these have more code points than so many on average.
MEAN_POINTS = 32


class Vocabulary:
    """Token bytes and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # the fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max(*ids.values(), *self.special.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for i in set(ids.values()) - set(self.special.values()):
            if len(self.bytes[i]) == 1:
                self.of_byte[self.bytes[i][0]] = i
        # formed[i]: when i is merged (-1: a byte), from left[i] and right[i]
        self.formed, self.left, self.right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for a, b in merges:
            x, y, z, rank = ids[a], ids[b], ids[a + b], len(self.merges)
            self.merges.setdefault((x, y), (rank, z))
            if self.formed[z] < 0:
                self.formed[z], self.left[z], self.right[z] = rank, x, y
        pairs = np.array([(x << 32 | y, r) for (x, y), (r, _) in self.merges.items()] or [(-1, 0)], np.int64)
        order = np.argsort(pairs[:, 0])
        self.pair_keys, self.pair_ranks = pairs[order, 0], pairs[order, 1]
        self.made = np.array([z for _, z in self.merges.values()] or [0], np.int64)  # by rank
        self.byte_ranks = self.ranks(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)).reshape(256, 256)
        self.longest = ahocorasick.Automaton()
        for token, i in ids.items():
            if token not in self.special and (self.formed[i] >= 0 or len(self.bytes[i]) == 1):
                self.longest.add_word(self.bytes[i].decode("latin-1"), i)
        self.longest.make_automaton()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """When the pair merges; never: past all merges."""
        key = (x << 32) | y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a, b stay apart when their bytes are encoded together.

        Time runs back from the finished tokens: the side formed later (of equal ones the right
        one, for equal merges go left to right) is undone to its part at the border. Two parts
        that stood side by side would have merged if their rank is below that of what was undone.
        """
        ok = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        until = np.full(len(a), np.iinfo(np.int64).max, np.int64)
        while len(at):
            crossed = self.ranks(x, y) < until
            ok[at[crossed]] = False
            more = ~crossed & ((self.formed[x] >= 0) | (self.formed[y] >= 0))
            at, x, y = at[more], x[more], y[more]
            undo_left = self.formed[x] > self.formed[y]
            until = np.where(undo_left, self.formed[x], self.formed[y] + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return ok

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the exact encodings: the lowest rank first, leftmost of equals.

        Words of like lengths are merged together, one merge in each a step; very long ones alone.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        low = 0
        for width in (8, 16, 32, 64):
            mine = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if len(mine):
                rows = self._merged_rows([words[i] for i in mine.tolist()], sizes[mine], width)
                counts = (rows >= 0).sum(1)
                for i, x in zip(mine.tolist(), np.split(rows[rows >= 0], np.cumsum(counts)[:-1]), strict=True):
                    parts[i] = x
        for i in np.flatnonzero(sizes > low).tolist():
            parts[i] = np.array(self._merged_long(words[i]), np.int64)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _merged_rows(self, words: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
        never = np.iinfo(np.int64).max
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        col = np.arange(width + 1)
        ids = np.full((len(words), width + 1), -1, np.int64)  # the last column stands for no neighbour
        ids[:, :width] = np.where(col[:width] < sizes[:, None], self.of_byte[raw], -1)
        after = np.minimum(np.broadcast_to(col + 1, ids.shape), sizes[:, None])
        after = np.where(after >= sizes[:, None], width, after)
        before = np.where(col - 1 < 0, width, np.broadcast_to(col - 1, ids.shape)).copy()
        rank = np.full(ids.shape, never)
        rank[:, : width - 1] = np.where(col[: width - 1] + 1 < sizes[:, None], self.byte_ranks[raw[:, :-1], raw[:, 1:]], never)
        row = np.arange(len(words))
        while True:
            at = rank[row].argmin(1)
            more = rank[row, at] < never
            row, at = row[more], at[more]
            if not len(row):
                return ids[:, :width]
            gone = after[row, at]
            ids[row, at] = z = self.made[rank[row, at]]
            far, near = after[row, gone], before[row, at]
            ids[row, gone], rank[row, gone] = -1, never
            after[row, at] = far
            before[row, far] = at
            rank[row, at] = self.ranks(z, ids[row, far])
            inner = near < width
            rank[row[inner], near[inner]] = self.ranks(ids[row[inner], near[inner]], z[inner])

    def _merged_long(self, word: bytes) -> list[int]:
        ids: list[int] = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, heap = self.merges.get, []
        for i in range(n - 1):
            if m := get((ids[i], ids[i + 1])):
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get((z, ids[k])):
                    heapq.heappush(heap, (m[0], i, z, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := get((ids[h], z))):
                heapq.heappush(heap, (m[0], h, ids[h], z, m[1]))
        return [i for i in ids if i >= 0]

    def proposed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: ids, and the word of each."""
        gap = "Ā"  # in no token
        found = np.fromiter((v for end, i in self.longest.iter_long(gap.join(w.decode("latin-1") for w in words)) for v in (end, i)), np.int64).reshape(-1, 2)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        return found[:, 1], np.searchsorted(ends, found[:, 0], "right")

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids in each word)."""
        ids, word = self.proposed(words)
        covered = np.bincount(word, self.lengths[ids], len(words)).astype(np.int64)
        bad = covered != np.array([len(w) for w in words])
        inner = np.flatnonzero(word[1:] == word[:-1])
        a, b = ids[inner], ids[inner + 1]
        pairs, which = np.unique((a << 32) | b, return_inverse=True)
        bad[word[inner[~self.stable(pairs >> 32, pairs & 0xFFFFFFFF)[which]]]] = True
        counts = np.bincount(word, minlength=len(words))
        broken = np.flatnonzero(bad)
        if len(broken):
            exact, many = self.merged([words[i] for i in broken.tolist()])
            good = ~bad[word]
            ids, word = np.concatenate([ids[good], exact]), np.concatenate([word[good], np.repeat(broken, many)])
            ids = ids[np.argsort(word, kind="stable")]
            counts[broken] = many
        return ids.astype(np.int32), counts


class Grown:
    """An array that is added to at its end; its room doubles."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 10, dtype), 0

    def add(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(n, 2 * self.n) - self.n, self.data.dtype)])
        self.data[self.n : n] = more
        self.n = n


class Remembered:
    """Encodings of distinct pre-tokens by their hash, for one Python worker; code points are compared, so equal hashes alone prove nothing."""

    def __init__(self, encode_words, most: int = MAX_REMEMBERED):
        self.encode_words, self.most = encode_words, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        # of each slot: where its ids begin and how many they are, where its code points begin and how many they are
        self.ids, self.starts, self.counts = Grown(np.int32), Grown(np.int64), Grown(np.int32)
        self.points, self.begins, self.sizes = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def slots_of(self, hashes: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each pre-token points[start:end]; those not yet known are encoded."""
        codes, distinct = pd.factorize(hashes)
        if len(self.keys) + len(distinct) > self.most or self.points.n > MEAN_POINTS * self.most:
            self.clear()
        seen = np.zeros(len(distinct), np.int64)
        seen[codes[::-1]] = np.arange(len(codes))[::-1]
        # in order, so that neighbours are looked up together
        order = np.argsort(distinct)
        keys = distinct[order]
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        of = np.zeros(len(distinct), np.int32)
        of[order[known]] = self.slots[at[known]]
        if not known.all():
            put, fresh = at[~known], order[~known]
            of[fresh] = slots = self._added(points, starts[seen[fresh]], ends[seen[fresh]])
            self.keys, self.slots = np.insert(self.keys, put, keys[~known]), np.insert(self.slots, put, slots)
        out = of[codes]
        # other bytes of the same hash get slots of their own, which no key leads to
        odd = np.flatnonzero(~self._same(points, ends - starts, out))
        if len(odd):
            out[odd] = self._added(points, starts[odd], ends[odd])
        return out

    def _same(self, points: np.ndarray, size: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Whether each pre-token holds its slot's points. Pre-tokens follow one another, but for the edges of texts."""
        mine, upto = points[points != ta.EDGE_POINT], np.cumsum(size) - size
        same = self.sizes.data[slots] == size
        at = np.repeat(self.begins.data[slots] - upto, size)
        at += np.arange(len(mine))
        if not same.all():
            np.minimum(at, self.points.n - 1, out=at)
        same[np.searchsorted(upto, np.flatnonzero(self.points.data[at] != mine), "right") - 1] = False
        return same

    def _added(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        ids, counts = self.encode_words(ta.span_bytes(points, starts, ends))
        slots = (self.counts.n + np.arange(len(starts))).astype(np.int32)
        self.starts.add(self.ids.n + np.cumsum(counts) - counts)
        self.counts.add(counts)
        self.ids.add(ids)
        size = ends - starts
        upto = np.cumsum(size) - size
        self.begins.add(self.points.n + upto)
        self.sizes.add(size)
        self.points.add(points[np.repeat(starts - upto, size) + np.arange(size.sum())])
        return slots

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin)."""
        points, at = ta.code_points(texts)
        starts, ends = ta.pretokens(points)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        slots = self.slots_of(ta.span_hashes(points + np.uint32(1), starts, ends), points, starts, ends)
        counts = self.counts.data[slots].astype(np.int64)
        done = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids.data[np.repeat(self.starts.data[slots] - done[:-1], counts) + np.arange(done[-1])]
        return ids, done[np.searchsorted(starts, at)]


def encode_texts(texts: pa.Array, special: dict[str, int], memory: Remembered) -> pa.Array:
    """list<int32> of whole texts; the strings of special tokens are their ids, as in the file's own library."""
    out_ids, out_counts = [], []
    for part in ta.slices(texts):
        whole = [t or "" for t in part.to_pylist()]
        if any(s in t for s in special for t in whole if s[0] in t):
            # each text as stretches between special tokens, leftmost first
            for t in whole:
                ids: list[int] = []
                while t:
                    at, s = min(((i, s) for s in special if (i := t.find(s)) >= 0), default=(len(t), ""))
                    ids += memory.encode([t[:at]])[0].tolist() + ([special[s]] if s else [])
                    t = t[at + len(s) :]
                out_ids.append(np.array(ids, np.int32))
                out_counts.append(np.array([len(ids)]))
        else:
            ids, at = memory.encode(whole)
            out_ids.append(ids)
            out_counts.append(np.diff(at))
    counts = np.concatenate([np.zeros(1, np.int64), *out_counts])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *out_ids])))


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def remembered(path: str, most: int = MAX_REMEMBERED) -> Remembered:
    return Remembered(vocabulary(path).encode_words, most)


def decode_ids(ids: pa.Array, v: Vocabulary) -> pa.Array:
    """Texts of lists of ids."""
    ids = ids.cast(pa.list_(pa.int64()))
    counts = np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    out, done = [], np.concatenate([[0], np.cumsum(counts)])
    lo = 0
    while lo < len(counts):  # about a million ids at a time
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + (1 << 19), "right")) - 1)
        mine, edges = flat[done[lo] : done[hi]], done[lo : hi + 1] - done[lo]
        good = (mine >= 0) & (mine < len(v.lengths))
        mine = np.where(good, mine, 0)
        size = np.where(good, v.lengths[mine], 0)
        upto = np.concatenate([[0], np.cumsum(size)])
        raw = v.flat[np.repeat(v.starts[mine] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        cuts = upto[edges].tolist()
        out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
        lo = hi
    return pa.array(out, pa.string())


def encode(texts: Column, tokenizer: str) -> Column:
    """array<int>: ids of each whole text by the tokenizer file at this path (on every executor)."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory, special = remembered(tokenizer), vocabulary(tokenizer).special
        for texts in batches:
            yield encode_texts(texts, special, memory)

    return ids(texts)


def decode(ids: Column, tokenizer: str) -> Column:
    """string: the text of each list of ids, special tokens included."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(tokenizer)
        for ids in batches:
            yield decode_ids(ids, v)

    return text(ids)


def round_trip(texts: Column, tokenizer: str, most: int = MAX_REMEMBERED) -> Column:
    """struct<ids, decoded>: each whole text's ids and what they decode to, in one Python pass. most: pre-tokens that a worker remembers."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory, v = remembered(tokenizer, most), vocabulary(tokenizer)
        for texts in batches:
            ids = encode_texts(texts, v.special, memory)
            yield pa.StructArray.from_arrays([ids, decode_ids(ids, v)], ["ids", "decoded"])

    return both(texts)


def with_ids(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    return df.withColumn(ids, encode(F.col(text), tokenizer))


def with_text(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    return df.withColumn(text, decode(F.col(ids), tokenizer))
