import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vsearch.functions.text import chunks, strip, tokenize
from vsearch.operators.chunking import chunk_documents
from vsearch.types import ChunkError


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_tokenize(spark):
    texts = ["Hello, World! snake_case x2", "", "   ", "!!!", None, "Straße ÉTÉ 東京 İx"]
    assert column(spark, texts, tokenize) == [["hello", "world", "snake_case", "x2"], [], [], [], [], ["straße", "été", "東京", "i", "x"]]


def test_strip(spark):
    assert column(spark, ["  a ", "\u3000b\n", "\x1cc\x1f", "", None], strip) == ["a", "b", "c", "", None]


def windows(text, size, overlap):
    return [c for c in (text[i : i + size] for i in range(0, len(text), size - overlap)) if c.strip()]


def packed(text, size, overlap, sep):
    out, now = [], ""
    for seg in filter(None, (s.strip() for s in text.split(sep))):
        joined = (now + sep + seg).strip() if now else seg
        if not now or len(joined) <= size:
            now = joined
        else:
            out.append(now)
            now = now[-overlap:] + sep + seg if overlap else seg
    return out + [now] if now else out


def want(text, size, overlap, sep=None):
    if text is None or not text.strip():
        return []
    if len(text) <= size:
        return [text]
    return packed(text, size, overlap, sep) if sep else windows(text, size, overlap)


TEXTS = ["a" * 100, "abcdefghijklmnopqrstuvwxyz", "one\ntwo\n\nthree and four\nfive", "", "  ", None, "x" * 31 + " " * 40 + "y", "日本語" * 20, "\\E a|b|c|d" * 9]


@pytest.mark.parametrize("size,overlap", [(30, 0), (10, 3), (7, 6), (1, 0), (1000, 10)])
@pytest.mark.parametrize("sep", [None, "\n", "|", " and ", "\\E"])
def test_chunks(spark, size, overlap, sep):
    assert column(spark, TEXTS, lambda t: chunks(t, size, overlap, sep)) == [want(t, size, overlap, sep) for t in TEXTS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.é", max_size=60), min_size=20, max_size=20), st.integers(2, 20), st.integers(0, 9))
def test_chunks_random(spark, texts, size, overlap):
    overlap = min(overlap, size - 1)
    for sep in (None, "\n"):
        assert column(spark, texts, lambda t: chunks(t, size, overlap, sep)) == [want(t, size, overlap, sep) for t in texts]


@pytest.mark.parametrize("size,overlap", [(0, 0), (-1, 0), (10, -1), (10, 10)])
def test_bad_sizes(spark, size, overlap):
    with pytest.raises(ChunkError):
        chunks(F.lit("x"), size, overlap)


def test_chunk_documents(spark):
    rows = [("paper", "x" * 25, '{"lang": "en", "chunk_index": 99}'), ("bad", "y" * 5, '{"lang": '), ("none", "z", None), ("blank", " ", "{}"), ("list", "l", "[1]")]
    df = spark.createDataFrame(rows, "doc_id string, text string, metadata string")
    got = {r["doc_id"]: r for r in chunk_documents(df, 10, 0).collect()}
    assert sorted(got) == ["bad_chunk_0", "list_chunk_0", "none_chunk_0", "paper_chunk_0", "paper_chunk_1", "paper_chunk_2"]
    import json

    assert json.loads(got["paper_chunk_2"]["metadata"]) == {"lang": "en", "chunk_index": 2, "total_chunks": 3, "source_doc": "paper"}
    assert json.loads(got["bad_chunk_0"]["metadata"]) == {"chunk_index": 0, "total_chunks": 1, "source_doc": "bad"}
    assert json.loads(got["list_chunk_0"]["metadata"]) == {"chunk_index": 0, "total_chunks": 1, "source_doc": "list"}
