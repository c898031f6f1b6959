import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kernelweave.llm import media, mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def levels(sizes, weights, total, most):
    """Brute force: clamp one round after the other."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * left / w > most * sizes[i]}
        if not over:
            for i in free:
                target[i] = weights[i] * left / w
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        free -= over
    return target


def test_mix(spark, odd):
    got = mixing.mix(odd, [1, 2, 3]).collect()
    rows = odd.collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    want = dict(zip(names, levels([sizes[s] for s in names], [1, 2, 3, 1, 2, 3], sum(sizes.values()), 3.0), strict=False))
    by_id = {r["doc_id"]: r["source"] for r in rows}
    for r in got:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"]
    again = mixing.mix(odd.repartition(7), [1, 2, 3]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_no_range_holds_what_has_no_id(spark):
    """Rows without id and one repeated row are most of a source, and are ordered in many ranges all the same."""
    rows = [(None, f"w{i} " * (1 + i % 9), "a") for i in range(3000)] + [(7, "same row here", "a")] * 3000 + [(i, "x " * (i % 5), "b") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = []
        real = mixing.written

        def spy(df, name):
            out = real(df, name)
            if name == "ranges":
                seen.append([r["count"] for r in out.groupBy("source", "range").count().collect()])
            return out

        mixing.written = spy
        first = mixing.mix(docs, [1, 2, 3]).collect()
        again = mixing.mix(docs.repartition(11), [1, 2, 3]).collect()
    finally:
        mixing.written = real
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(seen[0]) < 1000 and sorted(map(str, first)) == sorted(map(str, again))
    by = {}
    for r in first:
        by.setdefault(r["source_size"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - k) <= 10 for t, k in by.values())


def test_sums_come_near(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(n), "abc"[int(i % 20 > 15) + int(i % 20 > 18)]) for i, n in enumerate(rng.integers(0, 60, 6000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, [1, 2, 3])
    s = got.groupBy("source_size").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert len(s) == 3 and all(abs(r["k"] - r["t"]) <= 30 for r in s)
    out = mixing.repeated(docs, got)
    assert out.columns == docs.columns and out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_empty(spark, none):
    assert mixing.mix(none, [1, 2, 3]).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(nothing, [1]).collect()] == [0, 0]


def test_media(odd, none):
    got = odd.withColumn("m", media.media(F.col("text"))).select("text", "m.*").collect()
    for r in got:
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(payload) + 44)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(media.wav(payload)).hexdigest() and media.samples(media.wav(payload)) == payload
    assert none.select(media.media(F.col("text"))).count() == 0
    stored = odd.select("text", media.media_bytes(F.col("text")).alias("w")).first()
    assert media.samples(bytes(stored["w"])).decode().rstrip(" ") == (stored["text"] or "").rstrip(" ")


def test_equal_texts_have_equal_prints_wherever_they_stand():
    rng = np.random.default_rng(2)
    t = ["".join(rng.choice(list("abcdef ghij.\n"), int(n))) for n in rng.integers(1, 4000, 40)]
    one = media.features(pa.array(t)).field("fingerprints").to_pylist()
    for shift in (1, 3):
        other = media.features(pa.array(t[shift:] + t[:shift])).field("fingerprints").to_pylist()
        assert other[-shift:] + other[:-shift] == one
    assert len({str(x) for x in one if len(x) > 4}) == sum(len(x) > 4 for x in one)
    assert all(x == sorted(x) for x in one)


def test_tone_has_its_peak():
    x = (128 + 100 * np.sin(2 * np.pi * 24 * np.arange(1920) / 192)).astype(np.uint8)
    lv, owner, _ = media.spectra(x, np.array([0, 1920]))
    assert (lv[:, 3:].argmax(1) + 3 == 24).all() and len(owner) == 19


def test_mix_takes_rows_without_id_and_repeated_rows(spark):
    import corpus_pipeline

    rows = [(1, "a b c", "en", "x", 5)] * 3 + [(None, "d e f g", "en", "x", 7), (None, "h i", "en", "x", 3), (2, "j k l", "en", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # one source: its target is its size, so each row is taken once
    assert sorted(map(str, corpus_pipeline.mix_sources(spark, docs, "").collect())) == sorted(map(str, docs.collect()))
    twice = mixing.mixed(docs, [1], total_share=2.0)
    assert twice.columns == docs.columns and sorted(map(str, twice.collect())) == sorted(map(str, docs.collect() * 2))
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r["text"] for r in kept) == ["a b c", "d e f g", "h i", "j k l"]
