"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check on full sets.

A document's set holds its distinct 5-word shingles (A-Z in lower case); with 1 to 4 words the
whole sequence is one shingle; without words or text the set is empty and links with nothing.

1. Each document gets its set's size and digest, and ROWS x BANDS MinHash values.
2. Documents of equal sets form a class; one row stands for it, however many copies there are.
3. Classes that share a band's value are candidates. In each bucket all are paired with its
   smallest id, so a bucket of any size gives one pair for each member.
4. A pair is pruned once the posterior that its similarity reaches the threshold falls below
   MISS, after 24, 48, .. equal signature places; survivors are confirmed on the full sets.
5. Buckets that still hold more than one component get the pairs between components as well:
   members are cut into blocks, each pair of blocks is one group, and inside it signatures are
   compared on arrays with the same pruning, then full sets. Only links that join components
   leave the group. So no candidate of different components stays untested, and no group is
   larger than two blocks.

Repeated rows and equal texts have equal sets, thus one class. Null ids take no part in links
and keep their row. Of rows with the same id and different texts the set of the least digest
stands for the id's links. Very long texts are whole. Columns beyond id and text take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelweave.llm import textarrays as ta
from kernelweave.llm.common import components, forget, written

WIDTH, BANDS, ROWS = 5, 24, 5
#: Miss probability of one pruning step; members of a block.
MISS, BLOCK = 1e-6, 1_000
_PLACES = BANDS * ROWS
_rng = np.random.default_rng(11)
_MULTIPLIERS = _rng.integers(1, 1 << 32, _PLACES, dtype=np.uint32) | np.uint32(1)
_ADDENDS = _rng.integers(1, 1 << 32, _PLACES, dtype=np.uint32)

_SIGNED = "doc_id bigint, n bigint, digest binary, bands array<bigint>, signature binary"


def minhashes(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """uint32 (texts, places): the least of each place's hash over each text's shingles; empty texts: 0."""
    out = np.zeros((len(at) - 1, _PLACES), np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
        for k in range(_PLACES):
            h = low * _MULTIPLIERS[k] + high * _ADDENDS[k]
            out[full, k] = np.minimum.reduceat(h ^ (h >> np.uint32(15)), at[full])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for part in ta.slices(batch.column(1)):
            data, offs = ta.utf8(part)
            starts, ends, first = ta.words(data, offs)
            shingles, at = ta.shingles(ta.word_hashes(data, starts, ends), first, WIDTH)
            sets = ta.distinct_sorted(shingles, at)
            n = np.array([len(s) for s in sets], np.int64)
            digest = _digests(sets)
            places = minhashes(shingles, at)
            band = np.zeros((len(n), BANDS), np.uint64)
            for r in range(ROWS):
                band = ta.mix(band * np.uint64(31) + places[:, r::ROWS].astype(np.uint64) + np.uint64(r + 1))
            band += np.arange(BANDS, dtype=np.uint64)
            band = ta.mix(band).view(np.int64)
            sigs = (places & np.uint32(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(done, len(part)), pa.array(n), pa.array(digest, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(band.ravel()), BANDS).cast(pa.list_(pa.int64())), pa.array([s.tobytes() for s in sigs], pa.binary())],
                ["doc_id", "n", "digest", "bands", "signature"],
            )
            done += len(part)


def _digests(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits of each sorted set."""
    return [hashlib.blake2b(s, digest_size=16).digest() for s in sets]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, shingles) of each text whose set has the digest asked for."""
    for batch in batches:
        done = 0
        for part in ta.slices(batch.column(1)):
            data, offs = ta.utf8(part)
            starts, ends, first = ta.words(data, offs)
            sets = ta.distinct_sorted(*ta.shingles(ta.word_hashes(data, starts, ends), first, WIDTH))
            ids, asked = (batch.column(c).slice(done, len(part)) for c in (0, 2))
            good = np.flatnonzero([d == a for d, a in zip(_digests(sets), asked.to_pylist(), strict=True)])
            at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in good.tolist()])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *[sets[i] for i in good.tolist()]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(good)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "shingles"])
            done += len(part)


def posterior(equal: int, seen: int, threshold: float) -> float:
    """P(similarity >= threshold) after `equal` of `seen` places, from an even prior: a binomial sum."""
    return sum(math.comb(seen + 1, j) * threshold**j * (1 - threshold) ** (seen + 1 - j) for j in range(equal + 1))


def bounds(threshold: float, step: int = 24) -> list[tuple[int, int]]:
    """(places seen, least equal ones) at which a pair goes on."""
    return [(n, next(m for m in range(n + 1) if posterior(m, n, threshold) >= MISS)) for n in range(step, _PLACES + 1, step)]


def likely(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of signatures survive all batches of places."""
    alive, equal, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for seen, least in limits:
        equal = equal[:] + (a[alive, done:seen] == b[alive, done:seen]).sum(1)
        on = equal >= least
        alive, equal, done = alive[on], equal[on], seen
    return alive


def _pruner(limits):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, _PLACES) for c in (batch.column(2), batch.column(3)))
                yield batch.select(["a", "b"]).take(pa.array(likely(a, b, limits)))

    return prune


def between(threshold_percent: int, limits: list[tuple[int, int]] | None = None, key: str = "doc_id"):
    """Links that join different components of a pair of blocks; full sets are compared inside, those first that
    signatures leave (if limits are given), and at most one link for each join leaves."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(group["signature"]), np.uint16).reshape(-1, _PLACES) if limits else None
        ids, side, sets = group[key].to_numpy(), group["side"].to_numpy(), group["shingles"].tolist()
        root = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
        size = np.array([len(x) for x in sets], np.int64)
        every, flat = np.unique(np.concatenate(sets), return_inverse=True)
        at, mark = np.cumsum(size) - size, np.zeros(len(every), bool)
        alone = bool((side == 0).all())
        # members of small components first, so that the large ones are never compared inside
        left = np.arange(len(ids))[np.argsort(np.bincount(root)[root], kind="stable")] if alone else np.flatnonzero(side == 1)
        right = left if alone else np.flatnonzero(side == 2)
        out = []
        for i, x in enumerate(left.tolist()):
            others = right[i + 1 :] if alone else right
            others = others[root[others] != root[x]]
            if limits and len(others):
                others = others[likely(np.broadcast_to(sig[x], (len(others), _PLACES)), sig[others], limits)]
            if not len(others):
                continue
            n, mine = size[others], flat[at[x] : at[x] + size[x]]
            upto = np.cumsum(n) - n
            mark[mine] = True
            shared = np.add.reduceat(mark[flat[np.repeat(at[others] - upto, n) + np.arange(n.sum())]], upto, dtype=np.int64)
            mark[mine] = False
            linked = others[100 * shared >= threshold_percent * (size[x] + n - shared)]
            for y in linked.tolist():
                if root[y] != root[x]:
                    out.append((ids[x], ids[y]))
                    root[root == root[y]] = root[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype=ids.dtype)

    return links


def cells(members: DataFrame, key: str, block: int) -> DataFrame:
    """Members of buckets (bucket, key, component, m: how many) in pairs of blocks (i, j) of about `block`; side 0: both blocks are one, 1 and 2: the two."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    out = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64(key), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.select(
        "bucket", key, "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
    )


def apart(buckets: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Members, with their components so far, of buckets that hold more than one; of buckets with the same members one."""
    members = buckets.where("m > 2").join(found.withColumnRenamed("id", key), key, "left").select("bucket", key, "m", F.coalesce("component", key).alias("component"))
    h = F.xxhash64(key)
    open_ = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), key)).alias("y"), F.count("*").alias("n")).where("lo < hi")
    open_ = open_.groupBy("x", "y", "n").agg(F.min("bucket").alias("bucket")).select("bucket")
    return members.join(open_, "bucket")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold_percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    limits = bounds(threshold_percent / 100)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(docs.mapInArrow(_sign, _SIGNED), "signed")
    classes = written(signed.where("n > 0 and doc_id is not null").groupBy("n", "digest").agg(F.min("doc_id").alias("rep")), "classes")
    of_rep = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.min("digest").alias("digest"))
    reps = written(signed.join(of_rep, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "digest", "bands", "signature"), "reps")
    buckets = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("doc_id").alias("lead"), F.count("*").alias("m")).where("m > 1")
    buckets = written(buckets.join(shared, "bucket").select("bucket", "doc_id", "lead", "m"), "buckets")
    # full sets of all members of such buckets; texts meet their ids by a shuffle at any size
    some = reps.select("doc_id", "digest").join(buckets.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = docs.join(some.hint("merge"), "doc_id").select("doc_id", "text", "digest").mapInArrow(_sets, "doc_id bigint, shingles array<bigint>")
    # written without repeated rows, so that nothing stands between the joins' shuffles and a hot id can be split
    sets = written(sets.dropDuplicates(["doc_id"]), "sets")
    stars = buckets.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    sig = reps.select("doc_id", "signature")
    pairs = stars.join(sig.withColumnsRenamed({"doc_id": "b", "signature": "sb"}), "b").join(sig.withColumnsRenamed({"doc_id": "a", "signature": "sa"}), "a").select("a", "b", "sa", "sb")
    pairs = written(pairs.mapInArrow(_pruner(limits), "a bigint, b bigint"), "pairs")
    both = pairs.join(sets.withColumnsRenamed({"doc_id": "b", "shingles": "sb"}), "b").join(sets.withColumnsRenamed({"doc_id": "a", "shingles": "sa"}), "a")
    same = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa").cast("long") + F.size("sb").cast("long") - same
    links = written(both.where(100 * same >= threshold_percent * union).select("a", "b"), "links")
    forget(pairs)
    found = components(links)
    # buckets of three and more that the stars left apart
    members = written(apart(buckets, found, "doc_id"), "open")
    forget(buckets)
    if not members.isEmpty():
        groups = cells(members, "doc_id", BLOCK).join(sig.join(sets, "doc_id"), "doc_id")
        more = written(groups.groupBy("bucket", "i", "j").applyInPandas(between(threshold_percent, limits), "a bigint, b bigint"), "links")
        found = components(links.union(more))
        forget(more)
    forget(links, members, sets, reps)
    return labelled(signed, classes, found)


def labelled(signed: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Each document takes its class's component."""
    of_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("n", "digest", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "digest").join(of_class, ["n", "digest"], "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
