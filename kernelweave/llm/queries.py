"""The registered queries of the operators and of the pipeline; DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm import audit, bpe, fim, forest, html, langid, lmscore, media, mixing, neardup, passages, toxicity, wavelet
from kernelweave.llm.common import table

END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out(modulus: int, remainder: int) -> F.Column:
    """Whether the id's crc32 leaves this remainder; an id that is null is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and what they decode to, as digests. Null texts are empty; repeated rows give repeated rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("both", bpe.round_trip(F.col("text"), tokenizer_path())).select("doc_id", "both.*")
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes. Null texts have size 0, null sources are one source."""
    plan = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"), [1, 2, 3])
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and fingerprints of every text stored as sound. Null texts are empty; equal texts have equal values."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("m", media.media(F.col("text"))).select("doc_id", "m.*")
    prints = F.col("fingerprints")
    feature = F.concat(F.size(prints).cast("string"), F.lit(":"), F.sha2(F.concat_ws(",", prints.cast("array<string>")), 256))
    return docs.withColumn("feature", feature).drop("fingerprints")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text by models of the documents not held out. Null ids are not held out; texts without letters are und."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    models = langid.fit(docs.where(~held_out(3, 1)))
    told = docs.withColumn("t", langid.identify(F.col("text"), models, spark))
    return told.select("doc_id", held_out(3, 1).alias("held_out"), "t.lang_pred", "t.score", "t.bits", "t.rejected")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and runs of words of all documents. Null texts and null ids give no rows."""
    return passages.repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages over all documents."""
    from kernelweave.llm import pipeline as stages

    return stages.run(spark, sf_dir)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document stands in the token files, read back from these. Null texts hold the end id alone."""
    path = wavelet.new_path(spark)
    wavelet.write(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), path, END_ID)
    return wavelet.documents(spark, path)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null pages have an empty text."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return pages.select("page_id", "url", html.extract(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents. Null texts and null ids link with nothing and keep their row."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), threshold_percent=85)


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors. Null, zero and non-finite vectors link with nothing and keep their row."""
    return forest.near_embeddings(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), threshold=0.9)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a model of the labelled documents not held out. Null texts are empty; null ids are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs.where(~held_out(5, 0)), labels.where(~held_out(5, 0)))
    scored = docs.select("doc_id", held_out(5, 0).alias("held_out"), toxicity.score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, by source. Null texts and null sources are empty; rows without id are no copies."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    marks = audit.marked(docs, labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return audit.audit(marks, audit.FILTERS, {"good": "good_lost", "toxic": "toxic_lost"})


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text by counts of the documents not held out. Null texts are empty; null ids are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = lmscore.fit(docs.where(~held_out(5, 1)))
    scored = lmscore.score(docs, model)
    return scored.select("doc_id", held_out(5, 1).alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut into lines and put together for fill-in-middle, as digests. Null texts are empty and plain; a null id hashes as no digits."""
    docs = fim.fim(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "fim.*")
    restored = F.sha2(fim.restore(F.col("output"), F.col("form")), 256)
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored.alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_mixing": op2_mixing,
        "op3_media": op3_media,
        "op4_langid": op4_langid,
        "op5_passages": op5_passages,
        "op6_token_files": op6_token_files,
        "op7_html": op7_html,
        "op8_minhash": op8_minhash,
        "op9_forest": op9_forest,
        "op10_toxicity": op10_toxicity,
        "op11_audit": op11_audit,
        "op12_lm": op12_lm,
        "op13_fim": op13_fim,
        "pipeline": pipeline,
    }


#: the smallest id that links reach, from link(a, b) in both directions and node(id)
_COMPONENTS = "reach(id, c) AS (SELECT id, id FROM node UNION SELECT l.a, r.c FROM reach r JOIN link l ON l.b = r.id AND r.c < l.a), least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"

_OP8 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), few AS (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN few USING (shingle) JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 link AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)), node AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON least.id = d.doc_id"""

_OP9 = f"""WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
 link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9), node AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
 SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = vec_id) AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN least ON least.id = vec_id"""


_OP11 = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
 f AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
 w AS (SELECT t.*, list_filter(regexp_split_to_array(t.text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, t.doc_id > f.first AS copy FROM t JOIN f USING (text)),
 l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
   + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(copy, false) AS INT) AS mask,
   coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
 c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY ALL),
 s AS (SELECT part, CAST(sub AS INT) AS sub, sum(CASE WHEN mask & sub = 0 THEN n ELSE 0 END) AS n, sum(CASE WHEN mask & sub = 0 THEN good ELSE 0 END) AS good, sum(CASE WHEN mask & sub = 0 THEN toxic ELSE 0 END) AS toxic FROM c, range(32) r(sub) GROUP BY ALL),
 b AS (SELECT k, CAST(1 << k AS INT) AS bit, chr(CAST(65 + k AS INT)) AS letter FROM range(5) r(k)),
 o AS (SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits FROM b v, b w, b x, b y, b z WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31),
 p AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, CAST(list_sum(bits[1:step]) AS INT) AS q FROM o, range(1, 6) r(step)),
 r AS (SELECT x.part, p.filter_order, p.step, p.bit, y.n AS kept, x.n - y.n AS removed, x.good - y.good AS good_lost, x.toxic - y.toxic AS toxic_lost FROM p JOIN s x ON x.sub = p.q - p.bit JOIN s y ON y.sub = p.q AND y.part = x.part),
 h AS (SELECT part, bit, sum(removed) AS shapley FROM r GROUP BY ALL),
 u AS (SELECT part, mask, n FROM c)
SELECT r.part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(a.n - o.n - removed AS BIGINT) AS redundant, CAST(coalesce(u.n, 0) AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM r JOIN h ON h.part = r.part AND h.bit = r.bit JOIN s a ON a.part = r.part AND a.sub = 0 JOIN s o ON o.part = r.part AND o.sub = r.bit LEFT JOIN u ON u.part = r.part AND u.mask = r.bit"""

_OP13 = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 d AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
 r AS (SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
 s AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM s"""


def oracle_sql() -> dict[str, str]:
    return {"op8_minhash": _OP8, "op9_forest": _OP9, "op11_audit": _OP11, "op13_fim": _OP13}
