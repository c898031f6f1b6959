import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kernelweave.llm import html
from kernelweave.llm.common import table

PAGES = [
    (None, ""),
    ("", ""),
    ("<p>one", "one"),
    ("a &lt;b&gt; &eacute;&nbsp;c", "a <b> é c"),
    ("<main><p>x<script>if (a < b) { '</p>' }</script> y<!-- <p>no --> z</main>", "x\ny z"),
    ("<nav>menu</nav><article><h1>T</h1><p><b>one <i>two</i>\n three<br><p>four</p></article><footer>f</footer>", "T\none two three\nfour"),
    ("<article><p>a</p><aside>b</aside><div class='advert box'>c</div><form>d</form><p>e", "a\ne"),
    ('<div id="content"><p>text</p></div><div class="comments"><p>bad</p></div>', "text"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
]


SILENT_PAGES = [
    ("<article><p>a<embed src=x><p>b</article>", "a\nb"),
    *[(f"<article><p>a<{e} id='x' /><p>b</article>", "a\nb") for e in ("svg", "iframe", "canvas", "object")],
    ("<article><p>a<svg/><p>b<svg><text>no</text></svg><p>c</article>", "a\nb\nc"),
    ("<article><p>a<object data=x><p>b<button>c</article>", "a\nbc"),
    ("<article><p>a<script/>x = 1", "a"),
    ("<article><p>a<iframe src=x></iframe><p>b", "a\nb"),
]
NAMED_PAGES = [
    *[(f"<div class='{c}'><nav>n</nav><article><p>text</article><div class='sidebar'>s</div></div>", "text") for c in ("layout has-sidebar", "no-sidebar", "with-header", "page-widget")],
    ("<div id='page' class='search-off'><main><p>text</main><footer>f</footer></div>", "text"),
    ("<div class='page-widget'><div class='related'><article>card</article></div><article><p>text</article></div>", "text"),
    ("<div class='layout has-sidebar'><p>text</div>", "text"),
    ("<div id='content'><p>text</div><div class='related'><article>card</article></div>", "text"),
    ("<p>some longer text<div class='related'><article>card</article></div>", "some longer text"),
    ("<article><p>text</article><div class='comments'><article>reader</article></div>", "text"),
    ("<nav><article>n</article></nav><div role='navigation'><article>m</article></div>", ""),
]


PARTS_PAGES = [
    *[(f"<article><p>text<div class='{c}'><p>bad</div><p>more</article>", "text\nmore") for c in ("post-comments", "main-nav", "content-sidebar", "story-related", "entry_share", "ad")],
    *[(f"<div id='content'><p>text<div class='{c}'><p>bad</div></div>", "text") for c in ("post-comments", "main-nav", "content-sidebar", "story-related")],
    ("<article><p>text<p class='cookie-notice'>bad<p class='lead'>more</article>", "text\nmore"),
    ("<article><p>text<figure><img src=x><figcaption>what it shows</figcaption></figure></article>", "text\nwhat it shows"),
    ("<article><div class='entry-header'><h1>Title</h1></div><p>text</article>", "Title\ntext"),
    ("<div class='article ads-enabled'><p>text</div><p>other", "text"),
]


@pytest.mark.parametrize("page,want", PARTS_PAGES)
def test_parts_of_articles_that_are_none(page, want):
    assert html.main_text(page) == want


def test_surge_and_dive_are_the_block_model():
    rng = random.Random(2)
    for _ in range(300):
        size = [rng.choice([0, 0, 0, 5, 40, 90, 300]) for _ in range(rng.randrange(30))]
        for least in (1, html.SURGE):
            lo, hi = html.surge_to_dive(size, least)
            window = [sum(size[i : i + html.WINDOW]) for i in range(len(size))]
            top = min(least, max(window, default=0))
            kept = [i for i in range(len(size)) if size[i] and lo <= i < hi]
            begins = [i for i in range(len(size)) if size[i] and window[i] >= top]
            # a line is text if one like this stands before it (or is it) and one after, or no window without text lies between
            want = [i for i in range(len(size)) if size[i] and begins and begins[0] <= i and (i <= begins[-1] or all(window[j] for j in range(begins[-1], i + 1)))]
            assert kept == want


def test_pages_without_an_article():
    text = ["word " * 20 + "one.", "Short.", "word " * 30 + "two."]
    body = "".join(f"<div>{t}</div>" for t in text)
    far = "<div><a href=x>a link</a></div>" * 4
    page = f"<div>Top</div>{far}{body}{far}<div>All rights reserved</div>"
    assert html.main_text(page) == "\n".join(text)
    assert html.main_text(f"{body}{far}{body}") == "\n".join(text + text)
    assert html.main_text(f"<div>one</div>{far}<div>a longer line</div>") == "a longer line"


@pytest.mark.parametrize("page,want", SILENT_PAGES)
def test_silent_elements_without_an_end(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("page,want", NAMED_PAGES)
def test_names_do_not_hide_the_article(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("page,want", PAGES)
def test_pages(page, want):
    assert html.main_text(page) == want


def test_surge_and_dive():
    body = "".join(f"<p>{'word ' * 30}</p>" for _ in range(4))
    page = "<div><a href=x>link one</a></div>" * 8 + body + "<div><a href=y>link</a></div>" * 8
    assert html.main_text(page) == "\n".join(["word " * 29 + "word"] * 4)


def test_column(spark):
    df = spark.createDataFrame([(i, p, "x") for i, (p, _) in enumerate(PAGES)] * 2, "page_id long, html string, text string")
    got = df.withColumn("main", html.extract(F.col("html"))).collect()
    assert len(got) == 2 * len(PAGES) and all(r["main"] == PAGES[r["page_id"]][1] and r["text"] == "x" for r in got)
    assert df.limit(0).select(html.extract(F.col("html"))).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, sf)
        if name != "bpe_ids":
            assert out.columns == docs.columns
        rows = out.collect()
        if name == "language_id":
            assert len(rows) >= 0.98 * docs.count()
        if name == "near_dedup":
            assert len({r["text"] for r in rows}) == len(rows)
        if name == "bpe_ids":
            assert all(r["round_trip"] for r in rows)
        else:
            seen = spark.createDataFrame(rows, out.schema)
    n = duckdb.sql(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]
    assert 0 < len(rows) <= 3 * n


def test_pipeline_stages_take_odd_documents(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, "/root/testdata/sf0.001").count() <= 3 * 100


def test_stages_give_the_rows_they_should(spark):
    """Null ids, repeated rows, one id with two texts and columns of clashing names, row by row."""
    text = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, text[0]), (1, text[0]), (2, text[1]), (2, text[2]), (None, text[3]), (None, text[3]), (3, text[0] + " end"), (4, p + "\n" + text[4]), (5, text[5] + "\n" + p), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, k, "c", "c") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, plan int, told string, what string")
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near_dedup"](spark, docs, "").collect()
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in near)
    assert got == sorted([(1, text[0]), (2, text[1]), (2, text[2]), (0, text[3]), (0, text[3]), (4, p + "\n" + text[4]), (5, text[5] + "\n" + p), (6, ""), (7, "")])
    cut = stages["substring_dedup"](spark, spark.createDataFrame(near, docs.schema), "")
    assert cut.columns == docs.columns
    rows = cut.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted([(1, text[0]), (2, text[1]), (2, text[2]), (0, text[3]), (0, text[3]), (4, p + "\n" + text[4]), (5, text[5]), (6, ""), (7, "")])
    mixed = stages["mix_sources"](spark, cut, "").collect()
    # one source of all words: each document once
    assert sorted(r["plan"] for r in mixed) == sorted(r["plan"] for r in rows)
    ids = stages["bpe_ids"](spark, spark.createDataFrame(mixed, docs.schema), "").collect()
    assert len(ids) == len(rows) and all(r["round_trip"] for r in ids)
    told = stages["language_id"](spark, docs, "")
    assert told.columns == docs.columns and {r["doc_id"] for r in told.collect()}.isdisjoint({6, 7})
