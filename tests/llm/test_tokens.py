import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kernelweave.llm import bpe, textarrays, wavelet
from kernelweave.llm.queries import tokenizer_path
from tokenizers import Tokenizer

PATH = tokenizer_path()
LIB = Tokenizer.from_file(PATH)
ODD = ["", "don't we'll 'tis I'm 's 're\n's  'll they'd've", "<|endoftext|> x <|endoftext|>", "a" * 3000, " " * 77 + "x", "\r\n\r\n", "　  é", "12³Ⅷ٣"]


def ids_of(texts):
    v = bpe.vocabulary(PATH)
    return bpe.encode_texts(pa.array(texts, pa.string()), v.special, bpe.remembered(PATH)).to_pylist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_encodes_as_the_library(texts):
    assert ids_of(texts) == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_texts():
    assert ids_of(ODD) == [LIB.encode(t, add_special_tokens=False).ids for t in ODD] and ids_of([None]) == [[]]


def test_pairs_are_stable_iff_encoding_keeps_them():
    v, rng = bpe.vocabulary(PATH), random.Random(3)
    pairs = [(rng.randrange(50_000), rng.randrange(50_000)) for _ in range(3000)] + [(rng.randrange(256, 900), rng.randrange(256, 900)) for _ in range(3000)]
    ok = v.stable(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), good in zip(pairs, ok, strict=True):
        ids, counts = v.merged([v.bytes[a] + v.bytes[b]])
        assert good == (ids.tolist() == [a, b])


def test_decodes_any_ids():
    rng = random.Random(5)
    ids = [[rng.randrange(50_257) for _ in range(rng.randrange(40))] for _ in range(200)]
    got = bpe.decode_ids(pa.array(ids, pa.list_(pa.int32())), bpe.vocabulary(PATH)).to_pylist()
    assert got == [LIB.decode(i, skip_special_tokens=False) for i in ids]
    assert bpe.decode_ids(pa.array([None, [10**8, 64]], pa.list_(pa.int64())), bpe.vocabulary(PATH)).to_pylist() == ["", LIB.decode([64])]


def test_columns(odd, none):
    both = odd.withColumn("both", bpe.round_trip(F.col("text"), PATH)).select("text", "n", "both.*").collect()
    assert len(both) == odd.count() and all(r["decoded"] == (r["text"] or "") and r["n"] == 1 for r in both)
    assert bpe.with_text(bpe.with_ids(odd, PATH), PATH).where("coalesce(text, '') <> decoded").count() == 0
    assert bpe.with_ids(none, PATH).count() == 0


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_REMEMBERED", 10)
    texts = [f"w{i} é{i * i}" for i in range(300)]
    assert ids_of(texts) == [LIB.encode(t).ids for t in texts]


@pytest.mark.parametrize("n,top", [(0, 5), (1, 5), (513, 300), (5000, 50_257)])
def test_wavelet_matrix(n, top):
    x = np.random.default_rng(n).integers(0, top, n)
    m = wavelet.WaveletMatrix.of(x, 16)
    assert m.tokens().tolist() == x.tolist()
    for i in range(0, n, max(1, n // 20)):
        assert m.access(i) == x[i]
        at = np.flatnonzero(x == x[i])
        assert m.count(int(x[i])) == len(at) and m.count(int(x[i]), 0, i) == (at < i).sum()
        assert m.occurrence(int(x[i]), len(at) - 1) == at[-1] and m.occurrence(int(x[i]), len(at)) == -1
    assert m.count(1 << 20) == 0


def test_files(spark, odd, none, tmp_path):
    docs = odd.where("doc_id is not null and doc_id <> 0")
    wavelet.write(docs, PATH, str(tmp_path / "a"), 2)
    got = wavelet.documents(spark, str(tmp_path / "a")).orderBy("doc_id").collect()
    start = 0
    for r, (text, doc_id) in zip(got, sorted(((r["text"] or "", r["doc_id"]) for r in docs.collect()), key=lambda x: x[1]), strict=True):
        ids = [*LIB.encode(text, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert wavelet.occurrences(spark, str(tmp_path / "a"), 2).agg(F.sum("n")).first()[0] >= len(got)
    wavelet.write(none, PATH, str(tmp_path / "b"), 2)
    assert wavelet.documents(spark, str(tmp_path / "b")).count() == 0


def test_query_digests(spark, sf):
    from kernelweave.llm.queries import op1_bpe

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_bpe(spark, sf).collect():
        ids = LIB.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_words_and_shingles():
    data, offs = textarrays.utf8(pa.array(["a B\tc", None, "", "x"]))
    s, e, first = textarrays.words(data, offs)
    assert [bytes(data[i:j]) for i, j in zip(s, e, strict=True)] == [b"a", b"B", b"c", b"x"] and first.tolist() == [0, 3, 3, 3, 4]
    up, low = (textarrays.word_hashes(*(lambda d, o: (d, *textarrays.words(d, o)[:2]))(*textarrays.utf8(pa.array([t])))) for t in ("ABC é", "abc é"))
    assert (up == low).all() and len(set(up.tolist())) == 2


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_words_of_equal_polynomials(n):
    s, c = "a", "b"
    while len(s) < n:
        s, c = s + c, c + s
    assert ids_of([s, c, s + " " + c]) == [LIB.encode(t, add_special_tokens=False).ids for t in (s, c, s + " " + c)]


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(textarrays, "span_hashes", lambda values, starts, ends: (ends - starts).astype(np.uint64))
    memory, v = bpe.Remembered(bpe.vocabulary(PATH).encode_words), bpe.vocabulary(PATH)
    for texts in (["one two six", "ten the and"], ["ten owl one", "abc"]):
        assert bpe.encode_texts(pa.array(texts), v.special, memory).to_pylist() == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_known_pretokens_are_not_cut_out_again(monkeypatch):
    memory, v, cut, whole = bpe.Remembered(bpe.vocabulary(PATH).encode_words), bpe.vocabulary(PATH), [], textarrays.span_bytes
    first = bpe.encode_texts(pa.array(ODD), v.special, memory).to_pylist()
    monkeypatch.setattr(textarrays, "span_bytes", lambda points, starts, ends: cut.extend(starts) or whole(points, starts, ends))
    assert bpe.encode_texts(pa.array(ODD[::-1]), v.special, memory).to_pylist() == first[::-1] and not cut


def test_memory_of_long_pretokens_starts_anew():
    memory, rng = bpe.Remembered(bpe.vocabulary(PATH).encode_words, 1000), random.Random(2)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abcdeé", k=500)) for _ in range(10))]
        assert bpe.encode_texts(pa.array(texts), {}, memory).to_pylist() == [LIB.encode(t, add_special_tokens=False).ids for t in texts]
    assert memory.points.n < 32 * 1000 + 2 * 5010
