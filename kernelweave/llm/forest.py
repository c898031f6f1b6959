"""Near-duplicate embeddings: a forest of random-projection trees with spill, compared inside leaves.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and keep
their row; vectors of different lengths never link, and each length has trees of its own. Equal vectors
form a class, of which one row, with the number of copies, goes on. Repeated ids are classes of their own
vectors, of which the id takes the most links and the least component. A null id keeps its row.

Trees are drawn on a bounded sample of each length's classes (SAMPLE rows, chosen by hash: a documented
limit; all classes are put into all trees). A node takes, of TRIES random directions, that of the largest
spread, and cuts at the sample's median along it; vectors within SPILL of the cut go to both sides. A
node that would hardly get smaller, for most of it lies in the spill, is left whole. Where the sample
ends before leaves are small enough, cuts go on at the whole sample's medians. Small leaves that stand
side by side are one group's work (a pack); a large leaf is dealt out in pairs of blocks, each one group.

What leaves a group is, for each vector, its number of links, and a spanning forest of the group's
links (fewer edges than members), so that components are those of all links. A pair that meets in more
than one leaf counts in the first they share: trees are the same everywhere, so a group tells the leaves
of a linked vector from the vector itself.

Links are checked in double precision on the full vectors, so none below the threshold is kept.
Missed are only pairs that no tree leaves together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelweave.llm import textarrays as ta
from kernelweave.llm.common import components, forget, fraction, written

TREES, SAMPLE, LEAF_ROWS, SPILL, BLOCK, TRIES = 8, 16_384, 100, 0.015, 1_500, 3
#: Rows of small neighbouring leaves that one group takes together.
PACK_ROWS = 6_000
#: Links that a group holds before it counts them.
MAX_PAIRS = 500_000
#: A node with fewer sample rows than MIN_NODE is cut at the whole sample's medians; no path is longer than DEPTH.
MIN_NODE, DEPTH = 32, 40


class Tree:
    """Nodes of (direction, cut, left, right), or (None, levels, rows, first leaf) at the ends; packs are ranges of leaves."""

    def __init__(self, points: np.ndarray, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.axes = rng.normal(size=(points.shape[1], DEPTH + 24))
        self.axes /= np.sqrt((self.axes**2).sum(0))
        self.nodes: list[tuple] = []
        self.leaves: dict[int, tuple[int, int]] = {}  # of each node, as a range
        self.leaves_used = 0
        along = points @ self.axes
        self.medians = np.median(along, 0)
        self._grow(along, np.arange(len(points)), rows / len(points), 0, rng)
        starts, blocks, held = [], [], np.inf
        for _, levels, mine, leaf in sorted((n for n in self.nodes if n[0] is None), key=lambda n: n[3]):
            each = mine / 2**levels
            many = int(np.ceil(each / BLOCK))
            for k in range(leaf, leaf + (1 << levels)):
                if many > 1 or held + each > PACK_ROWS:
                    starts.append(k)
                    blocks.append(many)
                    held = 0
                held += np.inf if many > 1 else each
        self.pack_starts, self.pack_blocks = np.array(starts), np.array(blocks)

    def _grow(self, along: np.ndarray, mine: np.ndarray, share: float, depth: int, rng) -> int:
        at, begin = len(self.nodes), self.leaves_used
        self.nodes.append(())
        rows = len(mine) * share
        if rows > LEAF_ROWS and len(mine) >= MIN_NODE and depth < DEPTH:
            some = rng.choice(self.axes.shape[1], TRIES, replace=False)
            k = int(some[along[np.ix_(mine, some)].std(0).argmax()])
            cut = float(np.median(along[mine, k]))
            left, right = mine[along[mine, k] <= cut + SPILL], mine[along[mine, k] >= cut - SPILL]
            if len(left) + len(right) <= 1.6 * len(mine):
                self.nodes[at] = (k, cut, self._grow(along, left, share, depth + 1, rng), self._grow(along, right, share, depth + 1, rng))
                self.leaves[at] = (begin, self.leaves_used)
                return at
            levels = 0
        else:
            levels = int(np.ceil(np.log2(max(rows / LEAF_ROWS, 1)))) if len(mine) < MIN_NODE else 0
        self.nodes[at] = (None, levels, max(rows, 1), self.leaves_used)
        self.leaves_used += 1 << levels
        self.leaves[at] = (begin, self.leaves_used)
        return at

    def places(self, points: np.ndarray, lo: int = 0, hi: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf from lo to hi that a point is in."""
        along, stack, out = points @ self.axes, [(0, np.arange(len(points)))], [np.zeros((2, 0), np.int64)]
        while stack:
            node, rows = stack.pop()
            if not len(rows) or self.leaves[node][0] >= hi or self.leaves[node][1] <= lo:
                continue
            k, cut, left, right = self.nodes[node]
            if k is not None:
                stack += [(left, rows[along[rows, k] <= cut + SPILL]), (right, rows[along[rows, k] >= cut - SPILL])]
                continue
            leaf = np.full(len(rows), right)
            for k in range(cut):
                low, high = along[rows, k] <= self.medians[k] + SPILL, along[rows, k] >= self.medians[k] - SPILL
                rows, leaf = np.concatenate([rows[low], rows[high]]), np.concatenate([leaf[low], leaf[high] + (1 << k)])
            ok = (leaf >= lo) & (leaf < hi)
            out.append(np.array([rows[ok], leaf[ok]]))
        return tuple(np.concatenate(out, 1))

    def cells(self, points: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, pack, i, j, side) once for each pack that a point is in, and each pair of its blocks; keys deal points to blocks."""
        row, leaf = self.places(points)
        pack = np.searchsorted(self.pack_starts, leaf, "right") - 1
        row, pack = np.unique(np.stack([row, pack]), axis=1)
        blocks = self.pack_blocks[pack]
        mine = (ta.mix(keys[row].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        other = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        row, pack, mine = np.repeat(row, blocks), np.repeat(pack, blocks), np.repeat(mine, blocks)
        return row, pack, np.minimum(mine, other), np.maximum(mine, other), np.where(mine == other, 0, np.where(mine < other, 1, 2))


def units(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def sound(df: DataFrame, vector: str) -> DataFrame:
    """Rows that may link: finite components, none null, not all zero."""
    v = F.col(vector)
    ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(ok, F.lit(False)))


def _packed(kind: str):
    """Vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy().astype(kind)
            size = lists.value_lengths().to_numpy() if len(lists) else np.zeros(0, np.int64)
            to = np.cumsum(size)
            raw = pa.array([flat[b - n : b].tobytes() for n, b in zip(size.tolist(), to.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), raw], ["vec_id", "copies", "d", "v"])

    return run


def _joining(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges a-b join components of root (the least member of each), at most one for each join; root is updated."""
    out = [np.zeros(0, np.int64)]
    at = np.flatnonzero(root[a] != root[b])
    while len(at):
        lo, hi = np.minimum(root[a[at]], root[b[at]]), np.maximum(root[a[at]], root[b[at]])
        # each component hangs itself on a smaller one by its first edge, so no circle closes
        hung, first = np.unique(hi, return_index=True)
        up = np.arange(len(root))
        up[hung] = lo[first]
        out.append(at[first])
        while (up[up] != up).any():
            up = up[up]
        root[:] = up[root]
        at = at[root[a[at]] != root[b[at]]]
    return np.concatenate(out)


def _share(tree: Tree, x: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | int) -> np.ndarray:
    """Which pairs a, b of rows share a leaf of the tree below this one."""
    row, leaf = tree.places(x)
    order = np.lexsort((leaf, row))
    row, leaf = row[order], leaf[order]
    homes = row << 40 | leaf
    begin, end = np.searchsorted(row, a), np.searchsorted(row, a, "right")
    n = end - begin
    pair = np.repeat(np.arange(len(a)), n)
    mine = leaf[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    want = b[pair] << 40 | mine
    at = np.minimum(np.searchsorted(homes, want), len(homes) - 1)
    out = np.zeros(len(a), bool)
    out[pair[(homes[at] == want) & (mine < (below[pair] if isinstance(below, np.ndarray) else below))]] = True
    return out


def _compare(threshold: float, kind: str, forests):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        ids, copies, side = group["vec_id"].to_numpy(), group["copies"].to_numpy(), group["side"].to_numpy()
        x, d, t, pack = units(group["v"].tolist(), kind), *group[["d", "tree", "pack"]].iloc[0].tolist()
        trees, alone = forests.value[d], bool((side == 0).all())
        starts = trees[t].pack_starts
        row, leaf = trees[t].places(x, starts[pack], starts[pack + 1] if pack + 1 < len(starts) else trees[t].leaves_used)
        order = np.lexsort((row, leaf))
        row, leaf = row[order], leaf[order]
        edges = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]]))
        count, root, ends, pairs, held = np.zeros(len(ids), np.int64), np.arange(len(ids)), [], [], 0

        def counted() -> None:
            if not pairs:
                return
            a, b, at = np.concatenate(pairs, 1)
            joins = _joining(root, a, b)
            ends.append(np.stack([ids[a[joins]], ids[b[joins]]]))
            for k in range(t + 1):  # a pair counts in the first leaf of the first tree that it shares
                some, to = np.unique(np.concatenate([a, b]), return_inverse=True)
                new = ~_share(trees[k], x[some], to[: len(a)], to[len(a) :], at if k == t else 1 << 40)
                a, b, at = a[new], b[new], at[new]
                if not len(a):
                    break
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            pairs.clear()

        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = row[lo:hi]
            left, right = (rows, rows) if alone else (rows[side[rows] == 1], rows[side[rows] == 2])
            y = x[right].T
            for k in range(0, len(left), 128):
                some = left[k : k + 128]
                a, b = np.nonzero(x[some] @ y >= threshold - 1e-9)
                a, b = some[a], right[b]
                keep = (a < b) if alone else np.ones(len(a), bool)
                a, b = a[keep], b[keep]
                if len(a):
                    exact = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                    pairs.append(np.stack([a[exact], b[exact], np.full(exact.sum(), leaf[lo])]))
                    held += len(a)
                if held > MAX_PAIRS:
                    counted()
                    held = 0
        counted()
        # counts, each with its own id beside it, then edges
        has, links = count > 0, np.concatenate([np.zeros((2, 0), np.int64), *ends], 1)
        return pd.DataFrame({"vec_id": np.concatenate([ids[has], links[0]]), "links": np.concatenate([count[has], np.zeros(links.shape[1], np.int64)]), "near": np.concatenate([ids[has], links[1]])})

    return links


def _sample(classes: DataFrame, kind: str) -> dict[int, tuple[int, np.ndarray]]:
    """Of each length the number of classes and about SAMPLE of their unit vectors."""
    counts = {r["d"]: r["count"] for r in classes.groupBy("d").count().collect()}
    if not counts:
        return {}
    part = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, min(1.0, SAMPLE / n + 64 / n))])
    some = classes.where(fraction(F.lit("forest"), "vec_id") <= part[F.col("d")]).select("d", "vec_id", "v").toArrow().sort_by("vec_id")
    lengths, vectors = some.column("d").to_numpy(), some.column("v").to_pylist()
    return {d: (n, units([vectors[i] for i in np.flatnonzero(lengths == d).tolist()], kind)) for d, n in counts.items() if (lengths == d).any()}


def near_embeddings(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", threshold: float = 0.9, trees: int = TREES, seed: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of df."""
    spark = df.sparkSession
    single = dict(df.dtypes)[vector] == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    good = sound(rows.where("vec_id is not null"), "v")
    classes = written(good.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "vectors")
    packed = classes.select("vec_id", "copies", "v").mapInArrow(_packed(kind), "vec_id bigint, copies bigint, d int, v binary")
    # lengths with one class have no pairs
    sample = {d: (n, points) for d, (n, points) in _sample(packed, kind).items() if n > 1}
    grown = {d: [Tree(points, n, seed * 1000 + t) for t in range(trees)] for d, (n, points) in sample.items()}
    forests = spark.sparkContext.broadcast(grown)  # as many nodes as the sample allows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, ids, vectors = batch.column(2).to_numpy(), batch.column(0).to_numpy(), batch.column(3)
            for d in np.intersect1d(of, list(forests.value)).tolist():
                mine = np.flatnonzero(of == d)
                some = vectors.take(pa.array(mine))
                x = units(some.to_pylist(), kind)
                for t, tree in enumerate(forests.value[d]):
                    row, *cell = tree.cells(x, ids[mine])
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(mine)).take(at), batch.column(1).take(pa.array(mine)).take(at), some.take(at), *[pa.array(c.astype(np.int64)) for c in (np.full(len(at), d), np.full(len(at), t), *cell)]],
                        ["vec_id", "copies", "v", "d", "tree", "pack", "i", "j", "side"],
                    )

    cells = packed.mapInArrow(place, "vec_id bigint, copies bigint, v binary, d bigint, tree bigint, pack bigint, i bigint, j bigint, side bigint")
    found = cells.groupBy("d", "tree", "pack", "i", "j").applyInPandas(_compare(threshold, kind, forests), "vec_id bigint, links bigint, near bigint")
    found = written(found, "links")
    links = written(found.groupBy("vec_id").agg(F.sum("links").alias("links")), "counts")
    label = components(found.where("near <> vec_id").select(F.col("vec_id").alias("a"), F.col("near").alias("b")))
    forget(found)
    of_class = classes.join(links, "vec_id", "left").join(label.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    of_class = of_class.select(
        F.col("v").alias("_v"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"),
        F.coalesce("component", "vec_id").alias("component"),
    )
    ids = good.join(of_class, good["v"] == of_class["_v"]).select("vec_id", "links", "component")
    out = rows.select("vec_id").join(ids.groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component")), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
