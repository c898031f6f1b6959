"""Fill-in-middle: texts cut at unit borders into prefix, middle and suffix, and put together in another order.

A Split pre-tokenizer of the tokenizers library, which no training precedes, isolates the matches of a pattern. The
code-point offsets that it gives are all that Python does: their number is the number of units, the offsets at two
ranks are the cuts, and Spark slices the text there. The ranks come from a hash of the id, so reruns agree.

Null texts are empty and stay plain; so do texts that hold a sentinel. A null id hashes as no digits. Repeated rows give
repeated rows; equal ids with unlike texts share their draws alone. Columns of other names stay as they are; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.llm.common import unlike

#: Lines with their break.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def unit_ends(text: Column, pattern: str = LINES) -> Column:
    """array<int>: the code point at which each unit of the whole text ends. pattern must match all of a text."""

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        split = Split(Regex(pattern), "isolated")
        for texts in batches:
            yield pa.array([[end for _, (_, end) in split.pre_tokenize_str(t.as_py())] if t.as_py() else [] for t in texts], pa.list_(pa.int32()))

    return of(text)


def draws(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """Unsigned numbers of 32 bits: the first groups of 8 digits of the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def fim(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, rate_percent: int = 100, spm_percent: int = 50, pattern: str = LINES) -> DataFrame:
    """docs with a column fim: struct<n, form, prefix_chars, middle_chars, output>.

    form psm puts the prefix first, spm the suffix; plain leaves the text as it is.
    """
    out, step = unlike(docs, "fim"), unlike(docs, "fim_step")
    whole, (h1, h2, h3, h4) = F.coalesce(F.col(text), F.lit("")), draws(F.col(doc_id), seed)
    df = docs.withColumn(step, F.struct(whole.alias("text"), unit_ends(whole, pattern).alias("ends")))
    ends, whole = F.col(step)["ends"], F.col(step)["text"]
    n = F.size(ends).cast("long")
    at = lambda rank: F.when(rank == 0, 0).otherwise(F.element_at(ends, F.greatest(rank, F.lit(1)).cast("int")))
    r1, r2 = h1 % (n + 1), h2 % (n + 1)
    sentinel = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    form = F.when((whole == "") | sentinel | (h3 % 100 >= rate_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    df = df.withColumn(step, F.struct(whole.alias("text"), n.alias("n"), form.alias("form"), at(F.least(r1, r2)).alias("a"), at(F.greatest(r1, r2)).alias("b")))
    s = F.col(step)
    prefix, middle = F.substring(s["text"], F.lit(1), s["a"]), F.substring(s["text"], s["a"] + 1, s["b"] - s["a"])
    suffix = F.substring(s["text"], s["b"] + 1, F.length(s["text"]))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(s["form"] == "psm", psm).when(s["form"] == "spm", spm).otherwise(s["text"])
    cut = s["form"] != "plain"
    made = F.struct(s["n"], s["form"], F.when(cut, s["a"].cast("long")).alias("prefix_chars"), F.when(cut, (s["b"] - s["a"]).cast("long")).alias("middle_chars"), output.alias("output"))
    return df.withColumn(out, made).drop(step)


def restore(output: Column, form: Column) -> Column:
    """The text that `fim` made output from. No part holds a sentinel, and none can arise where a part ends, as each begins with `<`."""
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    body, size = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output)), F.lit(len(PREFIX))
    i, j = F.position(first, body), F.position(second, body)
    one, two = F.substring(body, F.lit(1), i - 1), F.substring(body, i + size, j - i - size)
    middle = F.substring(body, j + size, F.length(body))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)
