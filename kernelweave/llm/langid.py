"""Language identification: interpolated Kneser-Ney character models, one per language.

A text is its letters in lower case, with one blank for each run of anything else. Models of
order 1 to ORDER are counted (below ORDER an n-gram counts the different characters before it; order 1 backs
off to equal shares of all characters), distributed, on a bounded sample of labelled rows (at most
max_docs for each language and half of the use: a documented limit; all rows are predicted,
whole) and stored as sorted hash arrays: for each n-gram its discounted probability and for each
context its back-off weight, in all languages. The prediction is the language of the lowest
cross-entropy per character; score is its share against the others. The other half of the
sample calibrates rejection: a text is rejected if its cross-entropy lies above its
language's mean by more than any calibration text's, with room, wider for short texts.

Null texts and texts without a letter are `und` with score 0 and are rejected. Ties go to the
first language by name. Rows without a language teach nothing; without any labelled row all are
`und`. Columns are added; rows, and repeated rows, stay.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.llm import textarrays as ta
from kernelweave.llm.common import fraction, written

ORDER, DISCOUNT, MAX_DOCS = 4, 0.75, 400
BLANK, OUTSIDE = np.uint64(1), np.uint64(0)


@functools.cache
def _folded() -> np.ndarray:
    """For each code point its lower-case letter + 2, else BLANK; OUTSIDE between texts."""
    letters = np.flatnonzero(ta.point_classes() == ta.LETTER)
    out = np.full(ta.EDGE_POINT + 1, BLANK, np.uint64)
    out[letters] = [ord(chr(p).lower()[0]) + 2 for p in letters.tolist()]
    out[ta.EDGE_POINT] = OUTSIDE
    return out


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters with a blank before and after each text, where each begins, letters in each)."""
    points, at = ta.code_points([t or "" for t in texts.to_pylist()])
    c = _folded()[points]
    # the mark between texts is kept as a blank on both sides of the border
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > BLANK) | (c[:-1] > BLANK)
    keep[at[1:] - 1] = True
    keep[at[:-1]] |= c[at[:-1]] > BLANK
    n = np.diff(np.concatenate([[0], np.cumsum(c > BLANK)])[at])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], kept[at], n


def gram_hashes(c: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order k = 1.. the hash of the k characters that end at each place, and of the k - 1 before it (order 1: 0).

    Before a text's first character stands OUTSIDE, as often as an order needs; no n-gram sees another text.
    """
    mult, one = np.uint64(0x9E3779B97F4A7C15), np.ones(1, np.uint64)
    edge, before = c == OUTSIDE, np.zeros(len(c), np.uint64)
    start = np.zeros(1, np.uint64)  # of as many OUTSIDEs as before has characters
    grams, contexts = [], []
    for _ in range(ORDER):
        h = ta.mix(before * mult + c + np.uint64(1))
        grams.append(h)
        contexts.append(before)
        start = ta.mix(start * mult + OUTSIDE + one)
        before = np.concatenate([start, np.where(edge, start, h)[:-1]])
    return grams, contexts


@dataclass
class Models:
    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted hashes, discounted probability by language
    contexts: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted hashes, back-off weight by language
    mean: np.ndarray
    spread: np.ndarray
    alphabet: int  # characters that any language has, and one for all others
    room: float = 6.0

    def log_probs(self, grams: list[np.ndarray], contexts: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        """log2 of the probability, by language, of the characters at some places given those before."""
        p = np.full((len(some), len(self.languages)), 1.0 / self.alphabet)
        for k in range(ORDER):
            p *= _found(*self.contexts[k], contexts[k][some], 1.0)
            p += _found(*self.grams[k], grams[k][some], 0.0)
        return np.log2(p)

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character by language, letters) of each whole text."""
        out, count = [np.zeros((0, len(self.languages)))], [np.zeros(0, np.int64)]
        for part in ta.slices(texts):
            c, at, n = letters(part)
            grams, contexts = gram_hashes(c)
            codes, distinct = pd.factorize(grams[-1])
            where = np.zeros(len(distinct), np.int64)
            where[codes] = np.arange(len(codes))
            lp = self.log_probs(grams, contexts, where)
            size = np.diff(at)  # at least 1: the border
            sums = np.stack([np.add.reduceat(lp[:, j][codes], at[:-1]) for j in range(len(self.languages))], 1)
            out.append(-sums / size[:, None])
            count.append(n)
        return np.concatenate(out), np.concatenate(count)

    def predict(self, texts: pa.Array) -> pa.StructArray:
        bits, n = self.entropies(texts)
        none = (n == 0) | np.asarray(texts.is_null())
        best = bits.argmin(1)
        low = bits[np.arange(len(bits)), best]
        share = np.exp2(-np.minimum((bits - low[:, None]) * (n + 1)[:, None], 1000.0))
        score = np.where(none, 0.0, 1.0 / share.sum(1))
        limit = self.mean[best] + self.room * self.spread[best] * np.sqrt(1 + 200.0 / np.maximum(n, 1))
        rejected = none | (low > limit)
        names = np.array([*self.languages, "und"], object)[np.where(none, len(self.languages), best)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(np.where(none, np.nan, low), from_pandas=True), pa.array(rejected)], ["lang_pred", "score", "bits", "rejected"])


def _found(keys: np.ndarray, values: np.ndarray, hashes: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where((keys[at] == hashes)[:, None], values[at], missing)


def built(counts: pd.DataFrame, languages: list[str]) -> Models:
    """From counts of the longest n-grams: language, h1..hORDER of its endings, p2..pORDER of their contexts, count."""
    grams, contexts = [], []
    for k in range(1, ORDER + 1):
        if k == ORDER:
            each = counts.groupby(["lang", f"h{k}", f"p{k}"], sort=False)["count"].sum().rename("c").reset_index()
        else:
            # below the longest order an n-gram counts the different characters before it
            longer = counts.drop_duplicates(["lang", f"h{k + 1}"])
            each = longer.groupby(["lang", f"h{k}", f"p{k}"], sort=False).size().rename("c").reset_index()
        total = each.groupby(["lang", f"p{k}"])["c"].agg(["sum", "size"]).reset_index()
        each = each.merge(total, on=["lang", f"p{k}"])
        each["p"] = np.maximum(each["c"] - DISCOUNT, 0) / each["sum"]
        total["weight"] = DISCOUNT * total["size"] / total["sum"]
        for df, key, value, fill, into in ((each, f"h{k}", "p", 0.0, grams), (total, f"p{k}", "weight", 1.0, contexts)):
            keys = np.unique(df[key].to_numpy(np.uint64))
            table = np.full((len(keys), len(languages)), fill)
            table[np.searchsorted(keys, df[key].to_numpy(np.uint64)), df["lang"].map(languages.index)] = df[value]
            into.append((keys, table))
    return Models(languages, grams, contexts, np.zeros(len(languages)), np.ones(len(languages)), len(grams[0][0]) + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of each row's text: language, hash and context of each order as signed numbers, count."""
    for batch in batches:
        for lang in set(batch.column(0).to_pylist()):
            c, _, _ = letters(batch.column(1).filter(pa.compute.equal(batch.column(0), lang)))
            grams, contexts = gram_hashes(c)
            codes, distinct = pd.factorize(grams[-1])
            where = np.zeros(len(distinct), np.int64)
            where[codes] = np.arange(len(codes))
            cols = [x[where].view(np.int64) for x in (*grams, *contexts)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), *map(pa.array, cols), pa.array(np.bincount(codes))], _NAMES)


_NAMES = ["lang", *[f"h{k}" for k in range(1, ORDER + 1)], *[f"p{k}" for k in range(1, ORDER + 1)], "count"]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = MAX_DOCS) -> Models | None:
    """Learns from at most about max_docs documents for each language, chosen by a hash of key."""
    import pyarrow.compute  # noqa: F401

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), fraction(F.lit("langid"), F.col(key), F.when(F.col(key).isNull(), F.col(text))).alias("u"))
    counts = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("least")).collect()}
    if not counts:
        return None
    part = F.create_map(*[F.lit(x) for g, (n, _) in counts.items() for x in (g, min(1.0, max_docs / n))])
    least = F.create_map(*[F.lit(x) for g, (_, u) in counts.items() for x in (g, u)])
    # of few documents the first by hash is learned from, so that each language is known
    learned = (F.col("u") <= part[F.col("lang")] * 0.6) | (F.col("u") == least[F.col("lang")])
    sample = written(rows.where((F.col("u") <= part[F.col("lang")]) | (F.col("u") == least[F.col("lang")])).withColumn("half", F.when(learned, 0).otherwise(1)), "langid")
    schema = ", ".join(f"{n} {'string' if n == 'lang' else 'bigint'}" for n in _NAMES)
    grams = sample.where("half = 0").select("lang", "text").mapInArrow(_count, schema).groupBy(*_NAMES[:-1]).agg(F.sum("count").alias("count")).toPandas()
    if not len(grams):
        return None
    for c in _NAMES[1:-1]:
        grams[c] = grams[c].to_numpy(np.int64).view(np.uint64)
    models = built(grams, sorted(grams["lang"].unique()))
    aside = sample.where("half = 1").select("lang", "text").collect()
    bits, n = models.entropies(pa.array([r["text"] for r in aside], pa.string()))
    worst = 0.0
    for j, g in enumerate(models.languages):
        mine = np.array([r["lang"] == g for r in aside], bool) & (n > 0)
        if mine.any():
            x = bits[mine, j]
            # the median and its deviation, which a few junk rows do not move
            models.mean[j], models.spread[j] = np.median(x), max(1.4826 * np.median(np.abs(x - np.median(x))), 0.1)
            worst = max(worst, float(np.quantile((x - models.mean[j]) / models.spread[j] / np.sqrt(1 + 200.0 / n[mine]), 0.995)))
        else:
            # without texts aside: as far as the others
            models.mean[j] = np.nan
    models.mean = np.where(np.isnan(models.mean), np.nanmedian(models.mean) if not np.isnan(models.mean).all() else 0.0, models.mean)
    models.room = max(6.0, 1.5 * worst)
    return models


def identify(texts: Column, models: Models | None, spark) -> Column:
    """struct<lang_pred, score, bits, rejected> for each whole text."""
    kind = "struct<lang_pred:string,score:double,bits:double,rejected:boolean>"
    if models is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))
    shared = spark.sparkContext.broadcast(models)  # bounded by the sample

    @F.arrow_udf(kind)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield shared.value.predict(texts)

    return of(texts)
