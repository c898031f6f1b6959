"""How filters interact: what each would remove in every order, from one table of mask counts.

Every document gets a mask of the filters it fails. Per part only the counts of masks are kept (2^filters
numbers, and as many for each label); a subset-zeta transform turns them into the survivors of every
subset of filters. A step of an order is the difference between two neighbouring subsets, so no order
reads a document again.

A null text is empty and a null part is the empty string, in one part with empty parts. Empty texts equal one another; rows without id
are never copies and have no labels, and rows of one id are no copies of each other. Every row counts, repeated ones too. Of
repeated ids in the labels one mark of 1 is enough. No documents give no rows. Other columns take no part.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.llm.common import written

#: The filters by bit: four of `text_mask`, and E, a copy of a document with a smaller id.
FILTERS = "ABCDE"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: under 200 words; under half of them distinct; over 2 % A-Z; holds one of # $ % & * |."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # the array is made once and both its sizes are taken from it
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return F.transform(
        F.array(sizes),
        lambda s: (s["all"] < 200).cast("int")
        + (100 * s["distinct"] < 50 * s["all"]).cast("int") * 2
        + (100 * capitals > 2 * F.length(text)).cast("int") * 4
        + text.rlike(r"[#$%&*|]").cast("int") * 8,
    )[0]


def marked(docs: DataFrame, labels: DataFrame, flags: dict[str, Column], doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, a boolean for each flag) of each row of docs; flags are conditions on labels.

    Copies are told by the smallest id of each text's digest. Rows join it by digest and id together, and the labels
    by id, so that a large group of copies is no hot key.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text_mask(whole).alias("mask"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    rows = written(rows, "masks")
    firsts = rows.where("id is not null").groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"))
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("l")).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f) for f, c in flags.items()])
    ids = rows.where("id is not null").join(firsts, (F.col("digest") == F.col("d")) & (F.col("id") == F.col("first")), "left").join(known, F.col("id") == F.col("l"), "left")
    copy = F.col("first").isNull().cast("int") * 16
    ids = ids.select("part", (F.col("mask") + copy).alias("mask"), *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])
    return ids.union(rows.where("id is null").select("part", "mask", *[F.lit(False) for _ in flags]))


def _dense(counts: str, full: int) -> Column:
    """The array 0 to full of a map's values."""
    return F.transform(F.sequence(F.lit(0), F.lit(full)), lambda s: F.coalesce(F.col(counts)[s], F.lit(0).cast("long")))


def _zeta(sums: str, bit: int) -> Column:
    """One step of the subset-zeta transform: subsets with the bit take in those without it."""
    return F.transform(sums, lambda x, s: F.when(s.bitwiseAND(bit) > 0, x + F.get(F.col(sums), s - bit)).otherwise(x))


def _sum_of(shares: list[tuple[int, int]], bit: int) -> Column:
    """Of (subset, weight) the weighted sum of what the bit's filter removes after the subset."""
    terms = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(k).alias("k")) for s, k in shares])
    return F.aggregate(terms, F.lit(0).cast("long"), lambda x, t: x + t["k"] * (F.get("n", t["s"]) - F.get("n", t["s"] + bit)))


def survivors(marks: DataFrame, bits: int, flags: Sequence[str]) -> DataFrame:
    """Of each part an array for all rows ("n") and for each flag: at index s, the rows that fail no filter of the subset s."""
    full = (1 << bits) - 1
    counts = marks.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in flags])
    # at most 2^bits masks a part
    parts = counts.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in ("n", *flags)])
    parts = parts.select("part", *[_dense(c, full).alias(c) for c in ("n", *flags)])
    for b in range(bits):
        parts = parts.select("part", *[_zeta(c, 1 << b).alias(c) for c in ("n", *flags)])
    # who fails nothing of s has a mask inside the complement of s
    return parts.select("part", *[F.reverse(c).alias(c) for c in ("n", *flags)])


@functools.cache
def _steps(filters: str) -> str:
    """All orders and steps as JSON: the order, the step, its filter's bit, the subsets before and after it."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, bit in enumerate(order, 1):
            out.append({"o": "".join(filters[b] for b in order), "s": step, "b": bit, "p": before, "q": before | 1 << bit})
            before |= 1 << bit
    return json.dumps(out)


def audit(marks: DataFrame, filters: str, lost: dict[str, str]) -> DataFrame:
    """One row per part, order of the filters and step; lost: names of the columns that count a flag's rows removed.

    shapley sums what the step's filter removes over all orders: each subset without it precedes it in
    |subset|! (filters - 1 - |subset|)! of them.
    """
    n, full = len(filters), (1 << len(filters)) - 1
    at = survivors(marks, n, list(lost))
    shares = [[(s, math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())) for s in range(full + 1) if not s >> b & 1] for b in range(n)]
    sums = [_sum_of(own, 1 << b) for b, own in enumerate(shares)]
    at = at.withColumn("shares", F.array(*sums))
    steps = F.inline(F.from_json(F.lit(_steps(filters)), "array<struct<o:string,s:int,b:int,p:int,q:int>>"))
    rows = at.select("part", "n", "shares", *lost, steps)
    one = F.element_at(F.array(*[F.lit(1 << b) for b in range(n)]), F.col("b") + 1)
    removed = F.col("n")[F.col("p")] - F.col("n")[F.col("q")]
    return rows.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"), F.col("n")[F.col("q")].alias("kept"), removed.alias("removed"),
        (F.col("n")[0] - F.col("n")[one] - removed).alias("redundant"), (F.col("n")[F.lit(full) - one] - F.col("n")[full]).alias("unique_fails"),
        *[(F.col(f)[F.col("p")] - F.col(f)[F.col("q")]).alias(name) for f, name in lost.items()], F.col("shares")[F.col("b")].alias("shapley"),
    )
