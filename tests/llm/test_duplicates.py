import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kernelweave.llm import forest, neardup, passages, textarrays
from kernelweave.llm.common import components


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def united(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (101, 102), (7, 7), (None, 3), (100, 102)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == got[102] == 100 and len(got) == 34
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(9)
    rows = []
    for base in range(30):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 200))]
        for _ in range(rng.randint(1, 12)):
            w = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    rows += [None, "", "   ", "one", "ONE", "one two"]
    return spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(rows)], "doc_id long, text string")


@pytest.mark.parametrize("percent,block", [(85, 1000), (80, 4)])
def test_near_duplicates_are_brute_force(copies, monkeypatch, percent, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = copies.collect()
    sets = [shingle_set(r["text"]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    roots = united(len(rows), pairs)
    least = {}
    for i, r in enumerate(rows):
        least[roots[i]] = min(least.get(roots[i], r["doc_id"]), r["doc_id"])
    got = {r["doc_id"]: r for r in neardup.near_duplicates(copies, threshold_percent=percent).collect()}
    for i, r in enumerate(rows):
        g = got[r["doc_id"]]
        assert (g["n_shingles"], g["component_id"], g["kept"]) == (len(sets[i]), least[roots[i]], least[roots[i]] == r["doc_id"])


def test_near_duplicates_odd(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and sum(r["doc_id"] is None for r in got) == 1
    assert neardup.near_duplicates(none).count() == 0


def test_pruning_bounds():
    for seen, least in neardup.bounds(0.85):
        assert neardup.posterior(least, seen, 0.85) >= neardup.MISS and (least == 0 or neardup.posterior(least - 1, seen, 0.85) < neardup.MISS)
    b, r = passages.tuned(0.8)
    assert 1 - (1 - 0.8**r) ** b >= passages.RECALL


@pytest.mark.parametrize("block", [300, 3])
def test_passages_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(3)
    shared = [[f"p{k}_{i}" for i in range(rng.randint(20, 80))] for k in range(6)]
    docs = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 4)):
            p = list(rng.choice(shared)) if rng.random() < 0.5 else [f"u{rng.randrange(10**7)}" for _ in range(rng.randint(1, 60))]
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = f"e{rng.randrange(10**6)}"
            lines.append(" ".join(p))
        docs.append((i, "\n".join(lines) if i != 40 else None))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    places = [(i, k, shingle_set(line)) for i, t in docs for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= 20]
    roots = united(len(places), [(a, b) for a in range(len(places)) for b in range(a) if 100 * len(places[a][2] & places[b][2]) >= 80 * len(places[a][2] | places[b][2])])
    groups = {}
    for r, p in zip(roots, places, strict=True):
        groups.setdefault(r, []).append(p[:2])
    want = {(*p, *min(g), len(g), p != min(g)) for g in groups.values() if len(g) > 1 for p in g}
    found = passages.repeated_passages(df)
    got = {(r["doc_id"], r["place"], r["first_doc_id"], r["first_place"], r["copies"], r["removed"]) for r in found.collect()}
    assert got == want
    texts = {r["doc_id"]: r["text"] for r in passages.without(df, found).collect()}
    for i, t in docs:
        left = None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in {w[:2] for w in want if w[5]})
        changed = any(w[0] == i and w[5] for w in want)
        assert texts.get(i, "gone") == ("gone" if changed and not left.strip() else left)


def test_passages_odd(odd, none):
    assert passages.repeated_passages(odd).where("doc_id is null").count() == 0
    assert passages.repeated_passages(none).count() == 0 and passages.without(none, passages.repeated_passages(none)).count() == 0


@pytest.mark.parametrize("block", [1000, 20])
def test_forest_finds_all_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "LEAF_ROWS", 40)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    near = np.repeat(base[:20], 12, axis=0) + 0.1 * rng.normal(size=(240, 16))
    x = np.concatenate([base, near, base[:5], base[:5] * 2])
    rows = [(i * 2, v.tolist(), i % 3) for i, v in enumerate(x)]
    n = 2 * len(x)
    rows += [(n + 1, None, 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [1.0], 0), (n + 6, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    roots = united(len(u), list(zip(*np.nonzero(links), strict=True)))
    got = {r["vec_id"]: r for r in forest.near_embeddings(df).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.99 * links.sum() and all(got[2 * i]["n_links"] <= links[i].sum() for i in range(len(u)))
    if found == links.sum():
        for i in range(len(u)):
            assert got[2 * i]["component_id"] == 2 * min(j for j in range(len(u)) if roots[j] == roots[i])
    assert all(got[n + k]["n_links"] == 0 and got[n + k]["kept"] for k in range(1, 7)) and len(got) == len(rows)
    assert forest.near_embeddings(df.limit(0)).count() == 0 and forest.near_embeddings(df.where(F.col("vec_id") > n)).count() == 6


@pytest.mark.parametrize("block", [1000, 20])
def test_forest_keeps_chains_together(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows, ids = [], rng.permutation(240).tolist()
    for k in range(40):
        plane = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        # each is near the next (25 degrees) and no other
        rows += [(ids[6 * k + i], (np.cos(t) * plane[0] + np.sin(t) * plane[1]).tolist()) for i, t in enumerate(np.radians(25.0 * np.arange(6)))]
    want = {i: min(ids[6 * k : 6 * k + 6]) for k in range(40) for i in ids[6 * k : 6 * k + 6]}
    got = forest.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r["n_links"] for r in got) == 40 * 10
    assert {r["vec_id"]: r["component_id"] for r in got} == want and sum(r["kept"] for r in got) == 40


def test_passages_inside_lines_and_over_short_lines(spark):
    rng = random.Random(6)

    def some(n):
        return [f"u{rng.randrange(10**9)}" for _ in range(n)]

    a, b, c, d, e = some(60), some(60), some(50), some(49), some(70)
    wrapped = "\n".join(" ".join(b[i : i + 12]) for i in range(0, 60, 12))
    mixed = ["\n".join(" ".join(e[i:j]) for i, j in ((0, 15), (15, 40), (40, 55), (55, 70)))] * 2
    docs = [
        " ".join(some(40) + a + some(40)), " ".join(some(70) + a + some(20)), wrapped, " ".join(some(5)) + "\n" + wrapped + "\nend of it",
        " ".join(some(60) + c), " ".join(c + some(60)), " ".join(some(60) + d), " ".join(d + some(60)), *mixed, " ".join(some(30) + ["again"] * 130),
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    found = passages.repeated_passages(df)
    got = {r["doc_id"]: r["text"].split() for r in passages.without(df, found).collect()}
    want = {i: t.split() for i, t in enumerate(docs)}
    want[1] = want[1][:70] + want[1][130:]
    want[3] = want[3][:5] + ["end", "of", "it"]
    want[5] = want[5][50:]
    del want[9]
    want[10] = want[10][:80]
    assert got == want
    rows = [r for r in found.collect() if r["of_text"] is not None]
    assert {(r["doc_id"], r["first_doc_id"], r["words"]) for r in rows} >= {(1, 0, 60), (3, 2, 60), (5, 4, 50), (9, 8, 70)}


def doubled(n):
    """Two different words of n letters that a hash modulo 2^64 does not tell apart."""
    s, c = "a", "b"
    while len(s) < n:
        s, c = s + c, c + s
    return s, c


@pytest.mark.parametrize("n", [1024, 8192])
def test_doubling_words_are_told_apart(spark, n):
    a, b = doubled(n)
    tail = " ".join(f"w{i}" for i in range(24))
    df = spark.createDataFrame([(0, a), (1, b), (2, f"{a} {tail}"), (3, f"{b} {tail}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).where("doc_id < 2").collect()} == {0: 0, 1: 1}
    rows = [(i, " ".join([w] * 30)) for i, w in enumerate((a, b))]
    assert passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_runs_of_words_are_brute_force(spark):
    rng = random.Random(12)
    shared = [[f"p{k}_{i}" for i in range(rng.randint(50, 160))] for k in range(12)]
    docs = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 3)):
            words += [f"u{rng.randrange(10**9)}" for _ in range(rng.randint(0, 90))]
            p = rng.choice(shared)
            lo = rng.randint(0, len(p) - 50)
            words += p[lo : rng.randint(lo + 50, len(p))]
        words += [f"u{rng.randrange(10**9)}" for _ in range(rng.randint(0, 30))]
        docs.append((i, "".join(w + rng.choice([" ", " ", " ", "\n", " \t"]) for w in words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    # windows of 50 words, their first places, and of which words an earlier place has one
    first, covered = {}, {i: set() for i, _ in docs}
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), (i, k)) != (i, k):
                covered[i] |= set(range(k, k + 50))
    found = passages.repeated_passages(df, min_words=1000).where("span").collect()
    got = {i: set() for i, _ in docs}
    for r in found:
        assert r["words"] >= passages.KEY
        got[r["doc_id"]] |= set(range(r["word"], r["word"] + r["words"]))
    # all runs are found; where the first place of a paragraph shares less of a run, up to STEP - 1 words at its ends stay
    assert all(bool(covered[i]) <= bool(got[i]) for i in got)
    assert sum(len(covered[i] - got[i]) for i in got) <= 0.05 * sum(map(len, covered.values()))
    for i in got:
        for k in covered[i] - got[i]:
            assert got[i] & set(range(k - passages.STEP + 1, k + passages.STEP))
    # what is left holds every shared word once at least, and nothing of one document alone is lost
    left = " ".join(r["text"] or "" for r in passages.without(df, passages.repeated_passages(df)).collect()).split()
    assert set(left) == {w for _, t in docs for w in t.split()}


def test_passages_of_repeated_ids_and_clashing_columns(spark):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a\n" + p, 0), (2, "x\ny\n" + p, 1), (2, p + "\nz", 2), (None, p, 3), (3, "x " + p, 4), (3, "x " + p, 5)]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, n int, what int, rest string")
    out = passages.without(df, passages.repeated_passages(df))
    assert out.columns == df.columns
    assert {(r["n"], r["text"]) for r in out.collect()} == {(0, "a\n" + p), (1, "x\ny"), (2, "z"), (3, p)}


def test_passages_are_cut_out_of_a_text_once(spark):
    """A second call, copied into the filter on its result, is twice the work and two Python workers for each task."""
    p = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, p), (2, "x\n" + p), (3, p)], "doc_id long, text string")
    out = passages.without(df, passages.repeated_passages(df))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(1, p), (2, "x")}


def test_lines_of_texts_that_end_with_a_break():
    data, offs = textarrays.utf8(pa.array(["a b\n", "", "\n", "c\n\nd"]))
    lines, owner = passages.cut(data, offs)
    assert [(o, bytes(data[i:j]).strip()) for o, i, j in zip(owner.tolist(), lines, lines[1:], strict=False)] == [
        (0, b"a b"), (0, b""), (1, b""), (2, b""), (2, b""), (3, b"c"), (3, b""), (3, b"d"),
    ]


def planted(n, d=64):
    """n unit vectors, the second half each 0.9 to 1 alike to one of the first."""
    rng = np.random.default_rng(n)
    base, noise = (rng.normal(size=(n // 2, d)) for _ in range(2))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise -= (noise * base).sum(1, keepdims=True) * base
    c = rng.uniform(0.9, 1, n // 2)[:, None]
    return np.concatenate([base, c * base + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise, axis=1, keepdims=True)])


@pytest.mark.parametrize("n,most", [(2_000, 1.0), (50_000, 0.1)])
def test_forest_recall_and_work(n, most):
    x = planted(n)
    points = x[np.random.default_rng(0).permutation(n)[: forest.SAMPLE]]
    met, work = np.zeros(n // 2, bool), 0
    for t in range(forest.TREES):
        row, leaf = forest.Tree(points, n, t).places(x)
        work += (np.bincount(leaf).astype(float) ** 2).sum() / 2
        pairs = np.isin(row[row >= n // 2] - n // 2 << 32 | leaf[row >= n // 2], row[row < n // 2] << 32 | leaf[row < n // 2])
        met[row[row >= n // 2][pairs] - n // 2] = True
    assert met.mean() >= 0.99 and work <= most * n * n / 2


def test_forest_cuts_on_where_the_sample_ends(monkeypatch):
    monkeypatch.setattr(forest, "MIN_NODE", 500)
    x = planted(4_000)
    tree = forest.Tree(x[:1000], 4_000, 1)
    row, leaf = tree.places(x)
    assert set(row.tolist()) == set(range(4_000)) and leaf.max() < tree.leaves_used and np.bincount(leaf).max() < 400 and (tree.pack_blocks == 1).all()


def test_forest_links_vectors_of_each_length(spark):
    rows = [(i, [1.0, 2.0]) for i in range(4)] + [(10 + i, [3.0, 1.0, 2.0 + i / 100]) for i in range(3)] + [(20, [1e200, 1e200]), (21, [1e200, 1.1e200]), (22, [5.0]), (None, [1.0, 2.0]), (23, [])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == (5, 0) for i in (0, 1, 2, 3, 20, 21))
    assert all(got[i] == (2, 10) for i in (10, 11, 12)) and got[22] == (0, 22) and got[23] == (0, 23) and got[None] == (0, None)


def test_shuffle_files_go_with_the_table_written(spark):
    from kernelweave.llm.common import _CLEANUP, written

    def files():
        dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
        return {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}

    before, was = files(), spark.conf.get(_CLEANUP, None)
    table = written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "some")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(_CLEANUP, None) == was and table.agg(F.sum("count")).first()[0] == 10_000
