"""Repeated passages: MinHash bands over paragraphs, exact Jaccard, components; and runs of words inside and over lines.

A paragraph is a line (\\n) of at least min_words words. Its set holds its 5-word shingles, A-Z in lower
case. Bands are tuned: the fewest that find a pair at the threshold with probability RECALL, of rows that
bring together unrelated paragraphs (5 % alike) at most FALSE. Equal paragraphs form a class; classes in
a bucket are paired with its smallest and, where that leaves several components, with each other in
blocks; pairs are confirmed on their full sets. Of each component the first paragraph (by document,
then place) stays and all others are removed.

Passages that do not fill lines are runs of words, within a line or over several. The least hash of the
GRAM-word runs of a window of SPAN words is its print; a place where a repeated print stands is an
anchor. Around it stand paragraphs of KEY words, STEP words apart, so that any two equal windows of SPAN words
have an equal one of them. Equal ones (by hashes of all their words) are extended word by word, by less
than STEP words at each end, and joined to runs; runs of SPAN words and more count, and those of KEY words
and more that stand in more than two places. So every run of SPAN words that stands twice is
found, but for less than STEP words at an end that the first place of the outermost paragraph does not share. The first place (one outside removed lines before others, then by document and place) stays, also
where a text repeats itself. Of a run that removed lines cover already, less than min_words words that
are no short line of their own stay.

Null and empty texts have no paragraphs. Null ids take no part. A document is an id with a text: rows
that repeat both are one, rows of one id with other texts are others. Very long texts are whole. Ties
cannot occur: (doc_id, text's hash, place) is unique. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kernelweave.llm import textarrays as ta
from kernelweave.llm.common import components, forget, unlike, written
from kernelweave.llm.neardup import apart, between, cells

WIDTH, MIN_WORDS, THRESHOLD_PERCENT, RECALL, FALSE, BLOCK = 5, 20, 80, 0.999, 0.02, 300
#: Words of a window that counts wherever it stands, and of the runs that its print is taken from.
SPAN, GRAM = 50, 25
#: Words between the paragraphs around an anchor, and in each of them: windows that start up to STEP - 1 words before it hold it.
STEP = 9
KEY = SPAN - STEP + 1


def tuned(threshold: float) -> tuple[int, int]:
    """(bands, rows in each)."""
    plans = []
    for rows in range(1, 9):
        bands = next(b for b in range(1, 1000) if 1 - (1 - threshold**rows) ** b >= RECALL)
        if 1 - (1 - 0.05**rows) ** bands <= FALSE:
            plans.append((bands, rows))
    return min(plans)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of all lines, the text of each)."""
    breaks = np.flatnonzero(data == 10) + 1
    every = np.concatenate([offsets[:-1], breaks])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks - 1, "right") - 1])
    # the empty line after a text's last break begins where the next text does
    order = np.lexsort((owner, every))
    return np.append(every[order], offsets[-1]), owner[order]


def _of_batch(texts: pa.Array, min_words: int):
    """Of each text's long lines: (text, place, first word, words, shingles, where each's begin)."""
    data, offs = ta.utf8(texts)
    lines, owner = cut(data, offs)
    starts, ends, first = ta.words(data, lines)
    n = np.diff(first)
    head = np.searchsorted(owner, owner)
    long = np.flatnonzero(n >= min_words)
    shingles, at = ta.shingles(ta.word_hashes(data, starts, ends), first, WIDTH)
    size = np.diff(at)[long]
    upto = np.concatenate([[0], np.cumsum(size)])
    mine = shingles[np.repeat(at[long] - upto[:-1], size) + np.arange(upto[-1])]
    return owner[long], (np.arange(len(owner)) - head)[long], (first[:-1] - first[head])[long], n[long], mine, upto


def _digests(shingles: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits of each paragraph's shingles in order."""
    return [hashlib.blake2b(shingles[a:b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _banded(bands: int, rows: int, min_words: int):
    rng = np.random.default_rng(23)
    mult = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in ta.slices(batch.column(2)):
                owner, place, word, n, shingles, at = _of_batch(part, min_words)
                ids, of_text = (batch.column(c).slice(done, len(part)).take(pa.array(owner)) for c in (0, 1))
                done += len(part)
                if not len(owner):
                    continue
                keys = []
                for b in range(bands):
                    key = np.full(len(n), b + 1, np.uint64)
                    for r in range(rows):
                        key = ta.mix(key + np.minimum.reduceat(ta.mix(shingles * mult[b * rows + r]), at[:-1]))
                    keys.append(key.view(np.int64))
                flat = pa.array(np.stack(keys, 1).ravel())
                ints = [pa.array(x.astype(np.int32)) for x in (place, word, n)]
                yield pa.RecordBatch.from_arrays(
                    [ids, of_text, *ints, pa.array(_digests(shingles, at), pa.binary()), pa.FixedSizeListArray.from_arrays(flat, bands).cast(pa.list_(pa.int64()))],
                    ["doc_id", "of_text", "place", "word", "words", "digest", "bands"],
                )

    return run


def _sets(min_words: int):
    """Sets of chosen paragraphs: the batch has each text with the places wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in ta.slices(batch.column(0)):
                owner, place, _, n, shingles, at = _of_batch(part, min_words)
                wanted = batch.column(1).slice(done, len(part)).to_pylist()
                done += len(part)
                by = {(o, p): i for i, (o, p) in enumerate(zip(owner.tolist(), place.tolist(), strict=True))}
                digests, sets = [], []
                for o, some in enumerate(wanted):
                    for w in some:
                        i = by[o, w["place"]]
                        digests.append(w["digest"])
                        sets.append(np.unique(shingles[at[i] : at[i + 1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["digest", "shingles"])

    return run


def _runs(texts: pa.Array):
    """Words of all texts, and the hashes of their runs of GRAM words: bytes, text offsets, word starts and ends, each text's first word, the words' hashes, the runs'."""
    data, offs = ta.utf8(texts)
    starts, ends, first = ta.words(data, offs)
    hashes = ta.word_hashes(data, starts, ends)
    at = np.arange(max(len(hashes) - GRAM + 1, 0))
    return data, offs, starts, ends, first, hashes, ta.span_hashes(hashes, at, at + GRAM)


def _lines_of(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each word the line, from 0 in each text."""
    breaks = np.flatnonzero(data == 10)
    return np.searchsorted(breaks, starts) - np.repeat(np.searchsorted(breaks, offs[:-1]), np.diff(first))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text of SPAN words and more its prints: (print, line: that its windows lie in, -1 over several, p0, p1: the first and last of them)."""
    kind = pa.struct([("print", pa.int64()), ("line", pa.int32()), ("p0", pa.int32()), ("p1", pa.int32())])
    for batch in batches:
        done = 0
        for part in ta.slices(batch.column(2)):
            data, offs, starts, _, first, _, low = _runs(part)
            ids, of_text = (batch.column(c).slice(done, len(part)) for c in (0, 1))
            done += len(part)
            many = np.maximum(np.diff(first) - SPAN + 1, 0)
            if not many.any():
                continue
            size, wide = 1, SPAN - GRAM + 1
            while size < wide:
                step = min(size, wide - size)
                low, size = np.minimum(low[:-step], low[step:]), size + step
            owner = np.repeat(np.arange(len(part)), many)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pos = place + first[:-1][owner]
            prints, line = low[pos], _lines_of(data, offs, starts, first)
            line = np.where(line[pos] == line[pos + SPAN - 1], line[pos], -1)
            order = np.lexsort((pos, line, prints, owner))
            o, f, n, p = owner[order], prints[order], line[order], place[order]
            head = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (f[1:] != f[:-1]) | (n[1:] != n[:-1])]))
            tail = np.append(head[1:], len(p)) - 1
            ints = [pa.array(x.astype(np.int32)) for x in (n[head], p[head], p[tail])]
            at = np.searchsorted(o[head], np.arange(len(part) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(f[head].view(np.int64)), *ints], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([ids, of_text, lists], ["doc_id", "of_text", "prints"])


def _anchored(min_words: int):
    """The paragraphs of KEY words around each place of a wanted print, but for those in removed lines altogether.

    before and after hold the words next to them, the nearest first; beyond a text's ends stands what no other document has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in ta.slices(batch.column(2)):
                data, offs, starts, _, first, hashes, runs = _runs(part)
                ids, of_text, wanted, gone = (batch.column(c).slice(done, len(part)) for c in (0, 1, 3, 4))
                done += len(part)
                line = _lines_of(data, offs, starts, first)
                left, short, picked = np.ones(len(starts), bool), np.zeros(len(starts), bool), []
                for t in range(len(part)):
                    lo, hi = int(first[t]), int(first[t + 1])
                    left[lo:hi] = ~np.isin(line[lo:hi], gone[t].as_py() or [])
                    short[lo:hi] = left[lo:hi] & (np.bincount(line[lo:hi])[line[lo:hi]] < min_words)
                    want = wanted[t].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    anchors = lo + np.flatnonzero(np.isin(runs[lo : hi - GRAM + 1], want))
                    some = np.unique((anchors[:, None] - np.arange(0, SPAN - GRAM + 1, STEP)).ravel())
                    picked.append(some[(some >= lo) & (some + KEY <= hi)])
                u, v = (np.concatenate([[0], np.cumsum(x)]) for x in (left, short))
                owner = np.repeat(np.arange(len(part)), [len(x) for x in picked])
                some = np.concatenate(picked)
                open_ = u[some + KEY] > u[some]
                some, owner = some[open_], owner[open_]
                if not len(some):
                    continue
                lo, hi = first[:-1][owner], first[1:][owner]
                edge = ta.mix(ids.to_numpy().astype(np.uint64)[owner] + np.uint64(1))
                near = []
                for base, sign in ((some - 1, -1), (some + KEY, 1)):
                    words = []
                    for k in range(STEP - 1):
                        at = base + sign * k
                        words.append(np.where((at >= lo) & (at < hi), hashes[np.clip(at, 0, len(hashes) - 1)], edge + np.uint64(k)) & np.uint64(0xFFFFFFFF))
                    flat = pa.array(np.stack(words, 1).astype(np.uint32).view(np.int32).ravel())
                    near.append(pa.FixedSizeListArray.from_arrays(flat, STEP - 1).cast(pa.list_(pa.int32())))
                ints = [some - lo, line[some], u[some] - u[lo], u[some + KEY] - u[lo]]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner)), of_text.take(pa.array(owner)), pa.array(ta.span_hashes(hashes, some, some + KEY).view(np.int64)), *[pa.array(x.astype(np.int32)) for x in ints],
                     pa.array(u[some + KEY] - u[some] < KEY), pa.array(v[some + KEY] > v[some]), *near],
                    ["doc_id", "of_text", "key", "pos", "place", "left0", "left1", "masked", "short", "before", "after"],
                )

    return run


def _alike(a: str, b: str) -> Column:
    """How many of the first elements of two arrays of STEP - 1 are the same."""
    out = F.lit(STEP - 1)
    for k in reversed(range(STEP - 1)):
        out = F.when(F.col(a)[k] != F.col(b)[k], k).otherwise(out)
    return out


def _firsts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.min(F.struct("masked", "doc_id", "of_text", "pos", "place", "before", "after")).alias("first"), F.count("*").alias("copies")).where("copies > 1")


def _hits(keys: DataFrame, firsts: DataFrame) -> DataFrame:
    """Paragraphs with the first place of their key, b: the words before that are alike; the SPAN words from the first one of the same text are part of it."""
    elsewhere, room = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("of_text") != F.col("first.of_text")), F.col("pos") - F.col("first.pos") - SPAN
    return keys.join(firsts, "key").where(elsewhere | (room >= 0)).withColumn("b", F.least(_alike("before", "first.before"), F.when(~elsewhere, room)))


def _spans(docs: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """Rows of repeated_passages for repeated runs of words; lines: its rows of paragraphs."""
    prints = docs.mapInArrow(_prints, "doc_id bigint, of_text bigint, prints array<struct<print:bigint,line:int,p0:int,p1:int>>")
    gone = written(lines.where("removed").groupBy("doc_id", "of_text").agg(F.collect_set("place").alias("gone")), "gone")
    # windows in removed lines go with these, so they make no other window a repeated one
    prints = prints.join(gone, ["doc_id", "of_text"], "left").select("doc_id", "of_text", "gone", F.explode("prints").alias("p"))
    prints = prints.where(F.col("gone").isNull() | ~F.array_contains("gone", F.col("p.line"))).select("doc_id", "of_text", "p.print", "p.p0", "p.p1")
    prints = written(prints, "prints")
    d = F.xxhash64("doc_id", "of_text")
    shared = prints.groupBy("print").agg(F.min(d).alias("d0"), F.max(d).alias("d1"), F.min("p0").alias("p0"), F.max("p1").alias("p1")).where(f"d0 < d1 or p1 - p0 > {SPAN - GRAM}").select("print")
    wanted = prints.select("doc_id", "of_text", "print").join(shared, "print", "left_semi").groupBy("doc_id", "of_text").agg(F.collect_set("print").alias("wanted"))
    asked = docs.join(wanted.join(gone, ["doc_id", "of_text"], "left").hint("merge"), ["doc_id", "of_text"]).select("doc_id", "of_text", "text", "wanted", "gone")
    schema = "doc_id bigint, of_text bigint, key bigint, pos int, place int, left0 int, left1 int, masked boolean, short boolean, before array<int>, after array<int>"
    keys = written(asked.mapInArrow(_anchored(min_words), schema), "keys")
    forget(prints, gone)
    hits = _hits(keys, _firsts(keys))
    hits = hits.select("doc_id", "of_text", "pos", "place", "left0", "left1", "short", "copies", "key", F.col("first.doc_id").alias("f"), F.col("first.place").alias("g"), "b", _alike("after", "first.after").alias("a"))
    order = W.partitionBy("doc_id", "of_text").orderBy("pos")
    to = F.max(F.col("pos") + KEY + F.col("a")).over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce(F.col("pos") - F.col("b") > to, F.lit(True))
    hits = hits.withColumn("begins", begins.cast("int")).withColumn("k", F.sum("begins").over(order))
    lo, hi = F.min(F.col("pos") - F.col("b")), F.max(F.col("pos") + KEY + F.col("a"))
    spans = hits.groupBy("doc_id", "of_text", "k").agg(
        lo.alias("word"), (hi - lo).alias("words"), (F.max(F.col("left1") + F.col("a")) - F.min(F.col("left0") - F.col("b"))).alias("left"), F.max("short").alias("short"),
        F.max("copies").alias("copies"), F.min(F.struct("pos", "key", "f", "g", "place")).alias("head"), F.min("f").alias("f0"), F.max("f").alias("f1"),
    )
    spans = spans.where((F.col("words") >= SPAN) | (F.col("copies") > 2) | (F.col("f0") < F.col("f1"))).where((F.col("left") >= min_words) | F.col("short"))
    return spans.select(
        "doc_id", "of_text", F.lit(True).alias("span"), F.col("head.place").alias("place"), "word", "words", F.hex(F.col("head.key")).alias("component"),
        F.col("head.f").alias("first_doc_id"), F.col("head.g").alias("first_place"), "copies", F.lit(True).alias("removed"),
    )


def _cut(texts: Column, gone: Column, cuts: Column) -> Column:
    """texts without the lines gone and the words cut (word: the first, words: how many); a line of which only white space is left goes."""

    @F.arrow_udf("string")
    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, gone, cuts in batches:
            out = []
            for t, g, c in zip(texts.to_pylist(), gone.to_pylist(), cuts.to_pylist(), strict=True):
                if t is None:
                    out.append(t)
                    continue
                raw, g = t.encode(), set(g or [])
                data = np.frombuffer(raw, np.uint8)
                starts, ends, _ = ta.words(data, np.array([0, len(data)]))
                keep, left, at = np.ones(len(raw), bool), [], 0
                for x in c or []:
                    keep[starts[x["word"]] : ends[x["word"] + x["words"] - 1]] = False
                for k, line in enumerate(raw.split(b"\n")):
                    if k not in g:
                        rest = data[at : at + len(line)][keep[at : at + len(line)]].tobytes()
                        if rest.strip() or not line.strip():
                            left.append(rest)
                    at += len(line) + 1
                out.append(b"\n".join(left).decode())
            yield pa.array(out, pa.string())

    # else Spark copies the call into a filter on its result, and each task holds two Python workers
    return of.asNondeterministic()(texts, gone, cuts)


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row for each paragraph that has a like one, and for each run of words that an earlier place has.

    (doc_id, of_text: the hash of the document's text, span: whether it is a run of words, place: line from 0
    in which it begins, word: its first word, from 0 in the text, words: how many, component, first_doc_id,
    first_place, copies: paragraphs in the component, removed)
    """
    bands, rows = tuned(threshold_percent / 100)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("of_text"), F.col(text).alias("text")).where("doc_id is not null")
    paragraphs = written(docs.mapInArrow(_banded(bands, rows, min_words), "doc_id bigint, of_text bigint, place int, word int, words int, digest binary, bands array<bigint>"), "paragraphs")
    classes = written(paragraphs.groupBy("digest").agg(F.min(F.struct("doc_id", "of_text", "place")).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("digest", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("digest").alias("lead"), F.count("*").alias("m")).where("m > 1")
    buckets = written(buckets.join(shared, "bucket"), "buckets")
    # sets of all members of such buckets
    some = buckets.select("digest").distinct().join(classes, "digest").groupBy("first.doc_id", "first.of_text").agg(F.collect_list(F.struct(F.col("first.place").alias("place"), "digest")).alias("wanted"))
    # texts meet their ids by a shuffle at any size
    sets = docs.join(some.hint("merge"), ["doc_id", "of_text"]).select("text", "wanted").mapInArrow(_sets(min_words), "digest binary, shingles array<bigint>")
    # written without repeated rows, so that nothing stands between the joins' shuffles and a hot digest can be split
    sets = written(sets.dropDuplicates(["digest"]), "sets")
    stars = buckets.where("digest <> lead").select(F.col("lead").alias("a"), F.col("digest").alias("b")).distinct()
    both = stars.join(sets.withColumnsRenamed({"digest": "b", "shingles": "sb"}), "b").join(sets.withColumnsRenamed({"digest": "a", "shingles": "sa"}), "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = written(both.where(100 * common >= threshold_percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "links")
    found = components(links)
    # buckets of three and more that the stars left apart
    members = written(apart(buckets, found, "digest"), "open")
    forget(buckets)
    if not members.isEmpty():
        more = written(cells(members, "digest", BLOCK).join(sets, "digest").groupBy("bucket", "i", "j").applyInPandas(between(threshold_percent, key="digest"), "a binary, b binary"), "links")
        found = components(links.union(more))
        forget(more)
    forget(links, members, sets)
    of_class = classes.select("digest", "first", "copies").join(found.withColumnRenamed("id", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    groups = of_class.groupBy("component").agg(F.min("first").alias("first"), F.sum("copies").alias("copies")).where("copies > 1")
    of_class = of_class.select("digest", "component").join(groups, "component")
    out = paragraphs.drop("bands").join(of_class, "digest")
    removed = ~F.struct("doc_id", "of_text", "place").eqNullSafe(F.col("first"))
    out = out.select("doc_id", "of_text", F.lit(False).alias("span"), "place", "word", "words", F.hex("component").alias("component"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.place").alias("first_place"), "copies", removed.alias("removed"))
    out = written(out, "lines")
    forget(paragraphs, classes)
    return out.unionByName(_spans(docs, out, min_words))


def without(docs: DataFrame, passages: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the removed passages' lines and runs of words; a document of which only white space is left goes, others stay."""
    gone = F.collect_set(F.when(~F.col("span"), F.col("place"))).alias("gone")
    cuts = F.collect_list(F.when(F.col("span"), F.struct("word", "words"))).alias("cuts")
    what = passages.where("removed").groupBy("doc_id", "of_text").agg(gone, cuts).select(F.struct("doc_id", "of_text", "gone", "cuts").alias(unlike(docs, "what")))
    what, w = what, F.col(unlike(docs, "what"))
    rest = unlike(docs, "rest")
    out = docs.join(what, (docs[doc_id] == w["doc_id"]) & (F.xxhash64(docs[text]) == w["of_text"]), "left")
    # texts without removals stay in the JVM
    out = out.withColumn(rest, _cut(F.when(w.isNotNull(), docs[text]), w["gone"], w["cuts"]))
    out = out.where(w.isNull() | F.col(rest).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.coalesce(F.col(rest), docs[text]).alias(text) if c == text else docs[c] for c in docs.columns])
