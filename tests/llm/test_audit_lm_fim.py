import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelweave.llm import audit, fim, lmscore
from kernelweave.llm import textarrays as ta
from kernelweave.llm.queries import held_out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---- filter audit


def failing(rows):
    """The letters that each (id, text, part) fails, by brute force."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t, w = t or "", words(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        out.append({k for k, x in f.items() if x})
    return out


def steps(rows, good, toxic):
    fails, out = failing(rows), {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(f, i) for f, (i, _, p) in zip(fails, rows, strict=True) if (p or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, letter in enumerate(order, 1):
                gone = [(f, i) for f, i in left if letter in f]
                left = [x for x in left if letter not in x[0]]
                share[letter] += len(gone)
                redundant = sum(letter in f for f, _ in mine) - len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), redundant, sum(f == {letter} for f, _ in mine), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(share[order[k - 1]])
    return out


def test_audit(spark, odd):
    extra = [(200 + i, t, None, s) for i, (t, s) in enumerate([("A B " * 150, "s1"), ("a # b " * 120, None), ("A B " * 150, "s2"), ("", ""), ("x " * 199, ""), (" ".join(map(str, range(200))), "s1"), (" ".join(map(str, range(200))), "s1")])]
    docs = odd.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"))
    labels = spark.createDataFrame([(i, i % 3 == 0, i % 5 == 0) for i in [*range(60), 100, 101, 202, 203, 206]] + [(7, True, None), (7, None, True), (None, True, True)], "doc_id long, quality boolean, toxic boolean")
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"), F.lit("clash").alias("text"))
    marks = audit.marked(docs, labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    got = audit.audit(marks, audit.FILTERS, {"good": "good_lost", "toxic": "toxic_lost"}).collect()
    seen = labels.collect()
    want = steps([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], {r[0] for r in seen if r[0] is not None and r[1] == 1}, {r[0] for r in seen if r[0] is not None and r[2] == 1})
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == want and len(got) == len(want)
    assert sum(v[6] for v in want.values()) > 0 and any(v[2] for v in want.values())


def test_audit_of_three_filters_and_nothing(spark, none):
    marks = spark.createDataFrame([("p", 0, True)] * 3 + [("p", 5, False), ("p", 4, True), ("p", 7, True)], "part string, mask int, x boolean")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["x_lost"], r["shapley"]) for r in audit.audit(marks, "XYZ", {"x": "x_lost"}).collect()}
    assert len(got) == 18 and got["XYZ", 1] == (4, 2, 0, 1, got["XYZ", 1][4]) and got["ZXY", 2][:3] == (3, 0, 2)
    assert sum(got["XYZ", k][4] for k in (1, 2, 3)) == 6 * 3
    empty = audit.marked(none, spark.createDataFrame([], "doc_id long, quality int"), {"good": F.col("quality") == 1})
    assert audit.audit(empty, audit.FILTERS, {"good": "good_lost"}).count() == 0


# ---- language model


def trained(texts, order):
    """n-gram counts of lists of tokens, None for the end token."""
    counts = {}
    for t in texts:
        seq = [None, *words(lower(t)), None]
        for k in range(1, order + 1):
            for i in range(k - 1 if k > 1 else 1, len(seq)):
                g = tuple(seq[i - k + 1 : i + 1])
                counts[g] = counts.get(g, 0) + 1
    return counts


def by_hand(text, counts, order):
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    meant = lambda g: lmscore.MEANING[np.searchsorted(lmscore.LEVELS, counts.get(g, 0), "right")]
    seq, base, total, known = [None, *words(lower(text)), None], 0.0, 0.0, 0
    for i in range(1, len(seq)):
        c = counts.get((seq[i],), 0)
        known += c > 0
        base += np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        p = min((meant((seq[i],)) + 0.5) / (n + 0.5 * (v + 1)), 1.0)
        for k in range(2, min(order, i + 1) + 1):
            g = tuple(seq[i - k + 1 : i + 1])
            context = meant(g[:-1])
            a, b = lmscore.HEAPS[k - 2]
            if context:
                p = (min(meant(g), context, meant(g[1:])) + a * context**b * p) / (context + a * context**b)
        total += np.log10(p)
    return len(seq) - 1, known, n, base, total


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, odd, monkeypatch, order):
    monkeypatch.setattr(lmscore, "HEAD", 6)
    monkeypatch.setattr(lmscore, "TOKENS_PER_BLOCK", 40)
    monkeypatch.setattr(lmscore, "SHARD_BYTES", 1 << 13)
    docs = odd.withColumn("lm", F.lit("clash"))
    learned = docs.where(~held_out(5, 1))
    model = lmscore.fit(learned, order=order)
    assert len(model.shards) > 2 and 0 < len(model.head.value) <= 7 and model.tail.count() > 3
    got = lmscore.score(docs, model).collect()
    counts, rows = trained([r["text"] for r in learned.collect()], order), docs.collect()
    assert len(got) == len(rows) and got[0].__fields__[:4] == ["doc_id", "lang", "source", "size"]
    want = {}
    for r in rows:
        want.setdefault(r["doc_id"], []).append(by_hand(r["text"], counts, order))
    for r in got:
        m = r["lm_"]
        n, known, tokens, base, total = want[r["doc_id"]][0]
        assert (m["n_tokens"], m["n_known"], model.tokens) == (n, known, tokens) and m["base_score"] == pytest.approx(base, rel=1e-9)
        # a false item of the filter moves few tokens, and little
        assert abs(m["score"] - total) <= 0.05 * n + 0.5, (m, total)
    assert sum(r["lm_"]["score"] for r in got) == pytest.approx(sum(x[4] * len(v) for v in want.values() for x in v[:1]), rel=0.02)


def test_nothing_to_learn_from(spark, odd, none):
    got = lmscore.score(odd, lmscore.fit(none)).collect()
    assert len(got) == odd.count() and all(r["lm"]["base_score"] == 0 and r["lm"]["n_known"] == 0 and r["lm"]["score"] == 0 for r in got)
    assert lmscore.score(none, lmscore.fit(odd)).count() == 0


def test_filter_keeps_levels():
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 1 << 40, 30_000).astype(np.uint64))
    count = np.floor(rng.pareto(0.7, len(key)) + 1).clip(max=1e9).astype(np.int64)
    bits, n_bits = lmscore.filter_bits(key, count)
    shard = lmscore.Shard(5, np.array([1]), np.array([n_bits], np.uint64), np.frombuffer(b"\0" + bits, np.uint8))
    cell, level = key | np.uint64(5 << 40), np.zeros(len(key), np.int64)
    shard.levels(cell, level)
    true = np.searchsorted(lmscore.LEVELS, count, "right")
    assert (level >= true).all() and (level == true).mean() > 0.95
    unseen = np.setdiff1d(rng.integers(0, 1 << 40, 30_000).astype(np.uint64), key)
    level = np.zeros(len(unseen), np.int64)
    shard.levels(unseen | np.uint64(5 << 40), level)
    assert (level == 0).mean() > 0.95
    level = np.zeros(len(key), np.int64)
    shard.levels(key | np.uint64(6 << 40), level)
    assert not level.any()
    assert np.all(np.abs(np.log(lmscore.MEANING[true] / count)) < 0.25)


def test_grams_stay_inside_texts():
    end = lmscore._END[0]
    h = np.concatenate([lmscore._END, ta.mix(np.arange(1, 4, dtype=np.uint64)), lmscore._END, ta.mix(np.arange(1, 4, dtype=np.uint64)), lmscore._END])
    one, two, three = lmscore.grams(h, 3)
    assert (one[1:4] == one[5:8]).all() and (two[1:5] == two[5:9]).all() and (three[2:5] == three[6:9]).all()
    assert three[1] == 0 and three[5] == 0 and two[0] == 0 and (h == end).sum() == 3


# ---- fill in the middle


def cut(text, doc_id):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim(spark, odd, none):
    more = [(300 + i, t) for i, t in enumerate(["a<\nS>b\nM><", "x\r\ny z\n\n\n", "\n", "no break", "has <P> in it\nline", "<\n<P\n<S\n<M\n>", "😀\n日本\né\n" * 50, "\n" * 5_000, "q" * 200_000 + "\n" + "r"])]
    docs = odd.select("doc_id", "text", F.lit("clash").alias("fim"), "n").unionByName(spark.createDataFrame(more * 2, "doc_id long, text string").withColumns({"fim": F.lit(""), "n": F.lit(2)}))
    out = fim.fim(docs)
    assert out.columns == ["doc_id", "text", "fim", "n", "fim_"]
    rows = out.withColumn("again", fim.restore(F.col("fim_.output"), F.col("fim_.form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r["fim_"]) == cut(r["text"], r["doc_id"]) and r["again"] == (r["text"] or "")
    assert {r["fim_"]["form"] for r in rows} == {"psm", "spm", "plain"} and fim.fim(none).count() == 0


def test_fim_rates_and_units(spark):
    docs = spark.createDataFrame([(i, "one two  three four") for i in range(400)], "doc_id long, text string")
    forms = {r[0]: r[1] for r in fim.fim(docs, rate_percent=40, spm_percent=25, pattern=r"\s*\S+").groupBy("fim.form").count().collect()}
    assert 190 < forms["plain"] < 290 and 20 < forms["spm"] < 70 and 80 < forms["psm"] < 160
    assert fim.fim(docs, pattern=r"\s*\S+").agg(F.max("fim.n")).first()[0] == 4
