"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training. Counts of all n-grams up to ORDER are quantised on a logarithmic scale, and an n-gram of level q is put into a
Bloom filter q times, as (n-gram, 1) to (n-gram, q). Map tasks send sorted hashes with counts, cut by block; a reduce task
sums one block's and makes its bits. A block has as many bits as its items need, and there is a block for every
TOKENS_PER_BLOCK training tokens, so no task's share grows with the corpus.

Scoring. The filter is broadcast in shards of at most SHARD_BYTES; a task loads one after the other for a bounded group of
texts, so memory does not grow with the corpus either. An n-gram's level is found by probing (n-gram, 1), (n-gram, 2), ..
until one is missing; no n-gram counts more than its parts. Levels become counts again, and the probability
of a word is interpolated with that of the shorter context, whose share follows Heaps' law (new words after a context
seen c times: about a * c^b).

Exact counts of tokens, for the plain unigram score, never meet a filter: the at most HEAD most frequent tokens are
broadcast, all others are joined.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; each text ends with one end token, which also stands before the first
word. A null or empty text has the end token alone. Rows without id are scored like others, repeated rows each. Nothing to learn
from gives probability 1 to every token. Other columns stay as they are; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm import textarrays as ta
from kernelweave.llm.common import forget, unlike, written

U64 = np.uint64
ORDER = 2
#: Heaps' law for contexts of 1, 2, .. words.
HEAPS = ((3.0, 0.8), (1.0, 0.9), (1.0, 0.9), (1.0, 0.9))
#: Probes of an item, and bits that hold it: about one false item in 2^PROBES.
PROBES, BITS_PER_ITEM = 5, 5 / np.log(2)
TOKENS_PER_BLOCK, SHARD_BYTES = 1 << 17, 1 << 24
#: n-grams that a map task keeps before it sends them; texts (bytes) that a task scores with one shard loaded.
FLUSH, GROUP_BYTES = 1 << 21, 1 << 23
#: Tokens whose exact counts are broadcast: at most so many, none longer.
HEAD, HEAD_CHARS = 50_000, 64
_KEY_BITS = U64(40)
_END = ta.mix(np.array([0x656E64], U64))


def _thresholds() -> np.ndarray:
    """The least count of each level: 1, 2, 3 and from there on half as much more each."""
    out = [1]
    while out[-1] < 1 << 45:
        out.append(max(out[-1] + 1, int(out[-1] * 1.5)))
    return np.array(out)


LEVELS = _thresholds()
#: What a level stands for: the geometric middle of its counts; level 0 is 0.
MEANING = np.concatenate([[0.0], np.sqrt(LEVELS[:-1] * (LEVELS[1:] - 1.0)), [float(LEVELS[-1])]])


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a slice of texts, and per text its words' numbers, each text ended by -1; where each text begins (and the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("").cast(pa.string())))
    coded = lists.flatten().dictionary_encode()
    codes, words, sizes = coded.indices.to_numpy(), coded.dictionary, pc.list_value_length(lists).to_numpy().astype(np.int64)
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        text = np.repeat(np.arange(len(sizes)), sizes)[codes != empty]
        sizes, codes = np.bincount(text, minlength=len(sizes)), codes[codes != empty]
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(at[-1], -1, np.int64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = codes
    return words, out, at


def hashes(words: pa.Array, codes: np.ndarray) -> np.ndarray:
    """A hash of each token."""
    data, offs = ta.utf8(words)
    return np.concatenate([ta.word_hashes(data, offs[:-1], offs[1:]), _END])[codes]


def grams(h: np.ndarray, order: int) -> list[np.ndarray]:
    """Of each order the hashes of the n-grams that end at each token of h; h begins with the end of another text.

    An n-gram reaches over no text's end but as its first token; where it would, its hash is 0.
    """
    ends = h == _END[0]
    out, whole = [ta.mix(h + U64(1))], np.ones(len(h), bool)
    run = h
    for k in range(2, order + 1):
        run = np.concatenate([np.zeros(1, U64), ta.mix(run[:-1])]) * U64(0x9E3779B97F4A7C15) + h
        # the tokens between first and last are words
        whole = np.concatenate([[False], whole[:-1] & (~ends[:-1] if k > 2 else True)])
        out.append(np.where(whole, ta.mix(run + U64(k)), U64(0)))
    return out


def cells(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each n-gram above its key of 40 bits."""
    return ((h >> U64(32)) * U64(blocks) >> U64(32)) << _KEY_BITS | h & U64((1 << 40) - 1)


def _counted(blocks: int, order: int):
    """Map side: sorted keys (low 32 bits, high 8 bits apart) with counts, one row for each block and flush."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        v = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        n, v = np.diff(np.append(first, len(v))).astype(np.uint32), v[first]
        block = v >> _KEY_BITS
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist()
        low, high = v.astype(np.uint32), (v >> U64(32)).astype(np.uint8)
        cut = list(zip(at, [*at[1:], len(v)], strict=True))
        parts = [pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (low, high, n)]
        return pa.RecordBatch.from_arrays([pa.array(block[at].astype(np.int32)), *parts], ["block", "low", "high", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in ta.slices(batch.column(0), 1 << 21):
                words, codes, _ = tokens(part)
                for k, g in enumerate(grams(np.concatenate([_END, hashes(words, codes)]), order)):
                    g = g[1:]
                    held.append(cells(g[g != 0] if k else g, blocks))
                    size += len(held[-1])
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return of


def _start(key: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An item's first hash and the step to its next ones; a hash's place is its upper half times the bits / 2^32."""
    a = ta.mix(key * U64(0x9E3779B97F4A7C15) + np.asarray(level, U64))
    return a, ta.mix(a) | U64(1)


def filter_bits(key: np.ndarray, count: np.ndarray) -> tuple[bytes, int]:
    """One block's bits, and how many there are."""
    level = np.searchsorted(LEVELS, count, "right")
    items = np.repeat(key, level)
    of = np.arange(len(items)) - np.repeat(np.cumsum(level) - level, level) + 1
    n_bits = max(64, int(np.ceil(len(items) * BITS_PER_ITEM)))
    bits = np.zeros(n_bits, bool)
    a, step = _start(items, of)
    for _ in range(PROBES):
        bits[(a >> U64(32)) * U64(n_bits) >> U64(32)] = True
        a = a + step
    return np.packbits(bits, bitorder="little").tobytes(), n_bits


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """Reduce side: the bits of one block."""
    join = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
    keys = join("high", np.uint8).astype(U64) << U64(32) | join("low", np.uint32)
    order = np.argsort(keys)
    keys, n = keys[order], join("n", np.uint32)[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    bits, n_bits = filter_bits(keys[first], np.add.reduceat(n, first))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n_bits": pa.array([n_bits], pa.int64()), "bits": pa.array([bits], pa.binary())})


class Shard(NamedTuple):
    """The blocks first, first + 1, ..: the byte at which each begins, its bits, and all bytes."""

    first: int
    at: np.ndarray
    n_bits: np.ndarray
    data: np.ndarray

    def levels(self, cell: np.ndarray, level: np.ndarray) -> None:
        """Finds the levels of those n-grams that are in this shard's blocks."""
        block = (cell >> _KEY_BITS).astype(np.int64) - self.first
        alive = np.flatnonzero((block >= 0) & (block < len(self.at)))
        block, key = block[alive], cell[alive] & U64((1 << 40) - 1)
        base, n_bits = self.at[block], self.n_bits[block]
        for q in range(1, len(LEVELS) + 1):
            (a, step), left = _start(key, q), np.arange(len(key))
            for _ in range(PROBES):
                p = ((a >> U64(32)) * n_bits[left] >> U64(32)).astype(np.int64)
                there = (self.data[base[left] + (p >> 3)] >> (p & 7).astype(np.uint8) & 1).astype(bool)
                a, step, left = a[there], step[there], left[there]
                a = a + step
            if not len(left):
                return
            alive, key, base, n_bits = alive[left], key[left], base[left], n_bits[left]
            level[alive] = q


class Model(NamedTuple):
    """tokens, distinct: of the training texts; shards: broadcasts of the filter; head: a broadcast of exact counts; tail: the other tokens' counts."""

    tokens: int
    distinct: int
    blocks: int
    order: int
    shards: list
    head: object
    tail: DataFrame


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of each slice; the end token is null."""
    for batch in batches:
        for part in ta.slices(batch.column(0), 1 << 21):
            words, codes, _ = tokens(part)
            n = np.bincount(codes + 1, minlength=len(words) + 1)
            # the empty string between two breaks is in the dictionary, but no word
            counted = pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(1, pa.string()), words.cast(pa.string())]), pa.array(n)], ["token", "n"])
            yield counted.filter(pa.array(n > 0))


def _shard(rows: list, first: int, size: int) -> Shard:
    """From rows of (block, n_bits, bits); a block without items is one empty bit."""
    at, n_bits, here, parts = np.zeros(size, np.int64), np.ones(size, U64), 1, [b"\0"]
    for r in rows:
        at[r["block"] - first], n_bits[r["block"] - first] = here, r["n_bits"]
        parts.append(r["bits"])
        here += len(r["bits"])
    return Shard(first, at, n_bits, np.frombuffer(b"".join(parts), np.uint8))


def fit(docs: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Counts all texts. The driver sees one shard at a time, the head's tokens and some sums."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    counts = written(texts.mapInArrow(_words, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    n, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    short, level = F.length("token") <= HEAD_CHARS, F.floor(F.log2("n") * 4)
    least, left = 0, HEAD
    for lev, many in sorted(counts.where(short).groupBy(level).count().collect(), reverse=True):
        left -= many
        if left < 0:
            least = lev + 1
            break
    frequent = short & (level >= least)
    rows = counts.where(frequent | F.col("token").isNull()).toArrow()
    head = dict(zip(rows["token"].to_pylist(), rows["n"].to_pylist(), strict=True))
    tail = counts.where(~frequent & F.col("token").isNotNull())
    blocks = int(min(max(1, n // TOKENS_PER_BLOCK), (1 << 24) - 1))
    sent = texts.mapInArrow(_counted(blocks, order), "block int, low binary, high binary, n binary")
    table = written(sent.groupBy("block").applyInArrow(_block, "block int, n_bits long, bits binary"), "blocks")
    largest = table.agg(F.coalesce(F.max(F.length("bits")), F.lit(1))).first()[0]
    per, shards = max(1, SHARD_BYTES // largest), []
    for first in range(0, blocks, per):
        rows = table.where((F.col("block") >= first) & (F.col("block") < first + per)).collect()
        shards.append(spark.sparkContext.broadcast(_shard(rows, first, min(per, blocks - first))))
    forget(table)
    return Model(n, distinct, blocks, order, shards, spark.sparkContext.broadcast(head), tail)


def probabilities(levels: list[np.ndarray], n: int, distinct: int) -> np.ndarray:
    """log10 probability of each token but the first, from its n-grams' levels by order."""
    count = [MEANING[x] for x in levels]
    p = np.minimum((count[0] + 0.5) / (n + 0.5 * (distinct + 1)), 1.0)
    for k in range(1, len(count)):
        context = np.concatenate([np.zeros(1), count[k - 1][:-1]])
        count[k] = np.minimum(np.minimum(count[k], context), count[k - 1])
        a, b = HEAPS[k - 1]
        back = a * context**b
        p = np.where(context > 0, (count[k] + back * p) / np.maximum(context + back, 1e-300), p)
    return np.log10(p[1:])


class _Slice:
    """A slice of texts whose n-grams wait for their levels."""

    def __init__(self, texts: pa.Array, model: Model):
        self.words, codes, self.at = tokens(texts)
        self.codes = codes.astype(np.int32)
        self.cells, self.of, self.levels = [], [], []
        for g in grams(np.concatenate([_END, hashes(self.words, codes)]), model.order):
            distinct, of = np.unique(g, return_inverse=True)
            self.cells.append(cells(distinct, model.blocks))
            self.of.append(of.astype(np.int32))
            self.levels.append(np.zeros(len(distinct), np.uint8))
            if len(self.cells) > 1 and len(distinct) and distinct[0] == 0:
                self.cells[-1][0] = U64((1 << 64) - 1)  # no n-gram, in no block

    def columns(self, model: Model, head: dict) -> list[pa.Array]:
        starts, den = self.at[:-1], model.tokens + 0.5 * (model.distinct + 1)
        lm = np.add.reduceat(probabilities([x[o] for x, o in zip(self.levels, self.of, strict=True)], model.tokens, model.distinct), starts)
        c = np.array([*[head.get(w, -1) for w in self.words.to_pylist()], head.get(None, 0)], np.int64)[self.codes]
        log = np.add.reduceat(np.where(c >= 0, np.log10((np.maximum(c, 0) + 0.5) / den), 0.0), starts)
        text = np.repeat(np.arange(len(starts)), np.diff(self.at))
        pair, n = np.unique((text * (len(self.words) + 1) + self.codes)[c < 0], return_counts=True)
        text, code = pair // (len(self.words) + 1), pair % (len(self.words) + 1)
        token = self.words.take(pa.array(code)).cast(pa.string())
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(starts)))]).astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([token, pa.array(n.astype(np.int64))], ["token", "n"]))
        known, others = np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat((c < 0).astype(np.int64), starts)
        return [pa.array(np.diff(self.at)), pa.array(known), pa.array(log), pa.array(others), pa.array(lm), rare]


_ADDED = {"n_tokens": "long", "known": "long", "log": "double", "others": "long", "score": "double", "rare": "array<struct<token:string,n:long>>"}


def _scoring(model: Model, text: int):
    """Texts in groups of about GROUP_BYTES; for each group every shard is loaded once."""
    model = model._replace(tail=None)

    def scored(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [[_Slice(part, model) for part in ta.slices(b.column(text), 1 << 20)] for b in batches]
        for shard in model.shards:
            for s in (s for many in slices for s in many):
                for cell, level in zip(s.cells, s.levels, strict=True):
                    shard.value.levels(cell, level)
            if len(model.shards) > 1:
                shard.__dict__.pop("_value", None)  # the next shard takes its memory; the worker's local file stays
        for b, many in zip(batches, slices, strict=True):
            added = [pa.concat_arrays(x) for x in zip(*[s.columns(model, model.head.value) for s in many], strict=True)]
            kept = [b.column(i) for i in range(b.num_columns) if i != text]
            yield pa.RecordBatch.from_arrays([*kept, *added], [f"c{i}" for i in range(len(kept) + len(added))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(text).nbytes
            if size >= GROUP_BYTES:
                yield from scored(held)
                held, size = [], 0
        if held:
            yield from scored(held)

    return of


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with a column lm: struct<n_tokens, n_known, base_score, score>."""
    key, whole, out = unlike(docs, "lm_key"), unlike(docs, "lm_text"), unlike(docs, "lm")
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.monotonically_increasing_id().alias(key), F.col(text).alias(whole))
    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"{key} long"] + [f"{n} {t}" for n, t in _ADDED.items()])
    rows = written(rows.mapInArrow(_scoring(model, len(keep) + 1), schema), "scored")
    den = model.tokens + 0.5 * (model.distinct + 1)
    log = lambda c: F.log10((c + 0.5) / F.lit(den))
    pairs = rows.select(F.col(key).alias("k"), F.inline("rare"))
    tail = model.tail.select(F.col("token").alias("t"), F.col("n").alias("c"))
    found = pairs.join(tail, F.col("token") == F.col("t")).groupBy("k").agg(F.sum(F.col("n") * log(F.col("c"))).alias("more_log"), F.sum("n").alias("more"))
    rows = rows.join(found, F.col(key) == F.col("k"), "left")
    more = F.coalesce("more", F.lit(0))
    base = F.col("log") + F.coalesce("more_log", F.lit(0.0)) + (F.col("others") - more) * log(F.lit(0.0))
    lm = F.struct("n_tokens", (F.col("known") + more).alias("n_known"), base.alias("base_score"), "score")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], lm.alias(out))
