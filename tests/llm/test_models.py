import math
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kernelweave.llm import langid, toxicity
from kernelweave.llm.queries import op4_langid, op10_toxicity

SF = "/root/testdata/sf0.01"


class Naive:
    """Interpolated Kneser-Ney over strings, by its definition; "|" stands outside a text."""

    def __init__(self, texts, alphabet):
        self.alphabet, n = alphabet, langid.ORDER
        runs = ["|" * (n - 1) + t + "|" for t in texts]
        self.count = {}
        for r in runs:
            for i in range(n - 1, len(r)):
                g = r[i - n + 1 : i + 1]
                self.count[g] = self.count.get(g, 0) + 1
        self.left = [{} for _ in range(n)]  # of each order below n the characters before an n-gram
        for k in range(1, n):
            for g in self.count:
                self.left[k].setdefault(g[-k:], set()).add(g[-k - 1 :])

    def p(self, char, context):
        """Of a character after a context of up to ORDER - 1 characters."""
        k = len(context) + 1
        each = self.count if k == langid.ORDER else {g: len(x) for g, x in self.left[k].items()}
        lower = self.p(char, context[1:]) if context else 1 / self.alphabet
        after = [c for g, c in each.items() if g[:-1] == context]
        if not after:
            return lower
        return (max(each.get(context + char, 0) - langid.DISCOUNT, 0) + langid.DISCOUNT * len(after) * lower) / sum(after)


def learned(texts):
    cols = {n: [] for n in langid._NAMES}
    for batch in langid._count(iter([pa.RecordBatch.from_arrays([pa.array([g for g, _ in texts]), pa.array([t for _, t in texts])], ["lang", "text"])])):
        for n in langid._NAMES:
            cols[n] += batch.column(n).to_pylist()
    df = pd.DataFrame(cols)
    for c in langid._NAMES[1:-1]:
        df[c] = df[c].to_numpy(np.int64).view(np.uint64)
    df = df.groupby(langid._NAMES[:-1], as_index=False)["count"].sum()
    return langid.built(df, sorted({g for g, _ in texts}))


def test_probabilities_are_kneser_ney():
    texts = {"x": ["abracadabra", "abc cab bac", "a", "cabbage soup"], "y": ["zebra zoo", "ooze", "bazaar"]}
    m = learned([(g, t) for g, many in texts.items() for t in many])
    spaced = {g: ["".join(chr(v - 2) if v > 1 else " " for v in langid.letters(pa.array([t]))[0][:-1].tolist()) for t in many] for g, many in texts.items()}
    alphabet = {c for many in spaced.values() for t in many for c in t} | {"|"}
    assert m.alphabet == len(alphabet) + 1
    naive = [Naive(spaced[g], m.alphabet) for g in "xy"]
    for model in naive:
        for context in ["", "a", "|||", "||a", "abr", "zzz", "q"]:
            assert sum(model.p(c, context) for c in [*alphabet, "?"]) == pytest.approx(1, abs=1e-9)
    for text in ["abracadabra", "zoo", "bac zebra", "quiz", "a"]:
        c, _, _ = langid.letters(pa.array([text]))
        run = "|||" + "".join("|" if v == 0 else chr(v - 2) if v > 1 else " " for v in c.tolist())
        grams, contexts = langid.gram_hashes(c)
        got = m.log_probs(grams, contexts, np.arange(len(c)))
        want = [[np.log2(model.p(run[i], run[i - 3 : i])) for model in naive] for i in range(3, len(run))]
        assert np.allclose(got, want, atol=1e-9)
        bits, _ = m.entropies(pa.array(["other text", text, "x"]))
        assert np.allclose(bits[1], -np.mean(want, 0), atol=1e-9)  # nothing of its neighbours


def test_letters():
    c, at, n = langid.letters(pa.array(["Ab, c!", None, "", "12", "Éé"]))
    assert n.tolist() == [3, 0, 0, 0, 2] and len(at) == 6 and at[-1] == len(c)


def test_held_out_languages(spark):
    got = op4_langid(spark, SF).toPandas()
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    assert len(got) == len(truth) and ((got["score"] >= 0) & (got["score"] <= 1)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["doc_id"].map(truth)).mean() > 0.98 and got["rejected"].mean() < 0.01


def test_odd_documents(spark, odd, none):
    models = langid.fit(odd)
    got = odd.withColumn("t", langid.identify(F.col("text"), models, spark)).select("doc_id", "text", "n", "t.*").collect()
    assert len(got) == odd.count()
    for r in got:
        empty = not any(ch.isalpha() for ch in r["text"] or "")
        assert (r["lang_pred"] == "und") == empty and (r["lang_pred"] in ("en", "fr", "und"))
    assert langid.fit(none) is None
    assert none.withColumn("t", langid.identify(F.col("text"), None, spark)).count() == 0
    assert odd.select(langid.identify(F.col("text"), None, spark).alias("t")).where("t.lang_pred <> 'und'").count() == 0


def test_pooling_is_brute_force():
    rows = [("one two bad three", 1, "en"), ("one two three four", 0, "en"), ("bad", 1, "en"), ("", 0, "en")] * 6
    m = toxicity.train(rows, epochs=2, least_steps=5)
    texts = ["one two bad three", "", "bad bad", "x", "two one"]
    buckets, first = toxicity.word_buckets(pa.array(texts))
    got, _ = m.pooled(buckets, first)
    for i, t in enumerate(texts):
        e = [m.table[a] + m.table[b] for a, b in buckets[first[i] : first[i + 1]]]
        want = []
        for w, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for s in range(len(e)):
                    v = m.bias[w * toxicity.FILTERS + f] + sum(float(e[s + o] @ m.filters[w][o][:, f]) for o in range(width) if s + o < len(e))
                    best = max(best, v)
                want.append(best)
        assert np.allclose(got[i], want, atol=1e-5)


def test_toxicity_learns(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        w = rng.choice([f"word{k}" for k in range(200)], 60).tolist()
        if i % 6 == 0:
            w[int(rng.integers(60))] = ["vileun", "vilexa", "nasty"][i % 3]
        rows.append((i, " ".join(w), "en" if i % 2 else "fr", int(i % 6 == 0)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    train = F.col("doc_id") % 4 != 0
    model = toxicity.fit(docs.where(train), labels.where(train))
    got = docs.select("doc_id", toxicity.score(F.col("text"), model, spark).alias("s")).toPandas()
    held = got[got["doc_id"] % 4 == 0]
    truth = held["doc_id"] % 6 == 0
    assert ((held["s"] >= 0.5) == truth).mean() > 0.97


def test_toxicity_learns_from_every_labelled_row(spark):
    n = 7200
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("common word"), F.col("id") % 50, F.when(F.col("id") % 40 == 0, " vile").otherwise("")).alias("text"), F.lit("en").alias("lang"))
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 40 == 0).cast("int").alias("toxic")))
    table = model.language_table[:, 0].astype(float)
    (common, _), (never, _) = toxicity.word_buckets(pa.array(["common never-seen"]))[0][:2]
    assert np.exp(table[common] - table[never]) - 1 == pytest.approx(n, rel=1e-3)
    assert (model.scores(pa.array(["common word3", "common word3 vile"])) >= 0.5).tolist() == [False, True]


def test_toxicity_learns_in_shards(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 500)
    test_toxicity_learns(spark)


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = odd.select("doc_id", toxicity.score(F.col("text"), model, spark).alias("s")).collect()
    assert len(got) == odd.count() and all(0 <= r["s"] <= 1 for r in got)
    assert toxicity.fit(none, labels) is None and toxicity.fit(odd, labels.where("toxic = 1")) is None
    assert none.select(toxicity.score(F.col("text"), None, spark)).count() == 0
    assert op10_toxicity(spark, SF).count() == 1000


def test_best_cut():
    z, y = np.array([0.0, 1, 2, 10, 11]), np.array([0, 0, 0, 1, 1])
    assert toxicity.best_cut(z, y) == 6 and math.isfinite(toxicity.best_cut(z, np.zeros(5)))
