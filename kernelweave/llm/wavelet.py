"""Token ids in files of wavelet matrices: bit planes with counts, read without unpacking all.

A file is one range of ids of documents, written by one task; its rows are blocks of whole
documents, each a wavelet matrix over its tokens. Level l holds bit l (highest first) of every
token; below it, tokens with a 0 go before those with a 1, in order. Counts of ones before
each 512th bit make rank, and by it access, counting and occurrence lookup, short.

Null texts are empty documents: only the end id. Documents with the same id stand side by side
in the order of their texts. Very long documents make one large block. No documents give files
without rows.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kernelweave.llm import bpe
from kernelweave.llm.common import shared_dir

BLOCK_TOKENS, STEP = 1 << 20, 512
#: Distinct pre-tokens that a writing Python worker remembers.
REMEMBERED = 1_000_000

SCHEMA = "part int, block int, base bigint, doc_ids array<bigint>, counts array<bigint>, n bigint, bits int, zeros array<bigint>, planes binary, ones binary"


class WaveletMatrix:
    def __init__(self, n: int, bits: int, zeros: list[int], planes: bytes, ones: bytes):
        self.n, self.bits, self.zeros = n, bits, zeros
        self.planes = np.frombuffer(planes, np.uint8).reshape(bits, -1)
        self.ones = np.frombuffer(ones, np.uint32).reshape(bits, -1)

    @staticmethod
    def of(ids: np.ndarray, bits: int) -> WaveletMatrix:
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        n, planes, ones, zeros = len(ids), [], [], []
        for level in range(bits - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << level)) != 0
            packed = np.packbits(one, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (STEP // 8), np.uint8)])
            sums = np.bitwise_count(packed.view(np.uint64)).reshape(-1, STEP // 64).sum(1, dtype=np.uint32)
            planes.append(packed)
            ones.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(sums, dtype=np.uint32)]))
            # positions are quicker here than masks
            ids = np.concatenate([ids[np.flatnonzero(~one)], ids[np.flatnonzero(one)]])
            zeros.append(n - int(one.sum()))
        return WaveletMatrix(n, bits, zeros, np.concatenate(planes).tobytes(), np.concatenate(ones).tobytes())

    def _rank(self, level: int, i: int) -> int:
        """Ones before position i of a level."""
        at = i // STEP
        some = self.planes[level, at * (STEP // 8) : i // 8]
        rest = int(self.planes[level, i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(self.ones[level, at]) + int(np.bitwise_count(some).sum()) + rest.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a level."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank(level, mid + 1)
            lo, hi = (lo, mid) if (ones if bit else mid + 1 - ones) > k else (mid + 1, hi)
        return lo

    def access(self, i: int) -> int:
        token = 0
        for level in range(self.bits):
            ones = self._rank(level, i)
            bit = self.planes[level, i // 8] >> (i % 8) & 1
            token = token << 1 | int(bit)
            i = self.zeros[level] + ones if bit else i - ones
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often token stands in positions lo to hi."""
        if not 0 <= token < 1 << self.bits:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of its k-th occurrence, from 0; -1: there are not so many."""
        if not 0 <= k < self.count(token):
            return -1
        i = self._range(token, 0, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order, from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            up[np.flatnonzero(~one)] = out[: self.zeros[level]]
            up[np.flatnonzero(one)] = out[self.zeros[level] :] | out.dtype.type(1 << (self.bits - 1 - level))
            out = up
        return out


@functools.cache
def _library(path: str) -> tuple[bpe.Remembered, dict[str, int], int]:
    """Encoder of distinct pre-tokens by the tokenizers library's own model; special tokens; bits of an id."""
    from tokenizers import Tokenizer

    whole, v = Tokenizer.from_file(path), bpe.vocabulary(path)
    tokenize, shown = whole.model.tokenize, {}
    for i in v.of_byte.tolist():
        shown[v.bytes[i][0]] = ord(whole.id_to_token(i))

    def encode_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [tokenize(w.decode("latin-1").translate(shown)) for w in words]
        return np.array([t.id for x in got for t in x], np.int32), np.array([len(x) for x in got], np.int64)

    return bpe.Remembered(encode_words, REMEMBERED), v.special, max(1, (len(v.bytes) - 1).bit_length())


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes whole texts, appends end_id to each, and writes files in ascending order of the id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, special, bits = _library(tokenizer)
        part, block, base = TaskContext.get().partitionId(), 0, 0
        doc_ids, counts, ids, held = [], [], [], 0

        def made() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            m = WaveletMatrix.of(flat, bits)
            row = {"part": part, "block": block, "base": base, "doc_ids": doc_ids, "counts": counts, "n": m.n, "bits": bits, "zeros": m.zeros, "planes": m.planes.tobytes(), "ones": m.ones.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for at, size in _cuts(batch.column(1)):
                some = batch.slice(at, size)
                lists = bpe.encode_texts(some.column(1), special, memory)
                n = lists.value_lengths().to_numpy()
                # end_id after each document's own
                ends = np.cumsum(n + 1) - 1
                flat = np.empty(int(n.sum()) + len(n), np.int32)
                own = np.ones(len(flat), bool)
                own[ends] = False
                flat[ends], flat[own] = end_id, lists.flatten().to_numpy()
                doc_ids, counts = doc_ids + some.column(0).to_pylist(), counts + (n + 1).tolist()
                ids.append(flat)
                held += len(flat)
                if held >= BLOCK_TOKENS:
                    yield made()
                    block, base = block + 1, base + held
                    doc_ids, counts, ids, held = [], [], [], 0
        if ids:
            yield made()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n", pa.int64()), ("bits", pa.int32()), ("zeros", pa.list_(pa.int64())), ("planes", pa.binary()), ("ones", pa.binary())])
    rows.mapInArrow(blocks, SCHEMA).write.option("compression", "zstd").parquet(path)


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    from kernelweave.llm import textarrays as ta

    at = 0
    for part in ta.slices(texts):
        yield at, len(part)
        at += len(part)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files: start counts the tokens of all before it."""
    files = spark.read.schema(SCHEMA).parquet(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix(row["n"], row["bits"], row["zeros"], row["planes"], row["ones"]).tokens().astype("<u4")
                counts = np.array(row["counts"], np.int64)
                at = np.concatenate([[0], np.cumsum(counts)])
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(counts), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + at[:-1]), pa.array(counts), pa.array(sums, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(read, "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    # one row for each file
    sizes = files.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(part, block, n) for each block in which token stands: counted on the planes, nothing is unpacked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = WaveletMatrix(row["n"], row["bits"], row["zeros"], row["planes"], row["ones"]).count(token)
                if n:
                    yield pa.RecordBatch.from_pylist([{"part": row["part"], "block": row["block"], "n": n}])

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(read, "part bigint, block bigint, n bigint")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
