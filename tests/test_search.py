import math
from collections import Counter

import pytest

from vsearch.operators import lexical
from vsearch.operators.fusion import rrf
from vsearch.plans import search as plans
from vsearch.types import RequestError

TEXTS = ["Python is a language", "Rust is a fast systems language language", "machine learning in python", "", None, "SQLite is a database"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"d{i}", t, [1.0 - i / 10, i / 10], '{"even": %s}' % ("true" if i % 2 == 0 else "false"), i != 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "slot long, doc_id string, text string, vector array<float>, metadata string, active boolean")


def by_hand(query, texts, k1=1.5, b=0.75):
    toks = [(t or "").lower().split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    out = {}
    for i, ts in enumerate(toks):
        tf = Counter(ts)
        s = 0.0
        for q in query.lower().split():
            df = sum(q in t for t in toks)
            if tf[q]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[q] * (k1 + 1) / (tf[q] + k1 * (1 - b + b * len(ts) / avg))
        if s:
            out[i] = s
    return out


@pytest.mark.parametrize("query", ["python language", "language language rust", "is", "zzz", ""])
def test_bm25_values(docs, query):
    got = {r["slot"]: r["score"] for r in lexical.bm25(docs, query, 10).collect()}
    assert got == pytest.approx(by_hand(query, TEXTS))


def test_bm25_ties_by_slot_and_allow_list_keeps_statistics(spark, docs):
    twice = spark.createDataFrame([(5, "same text"), (3, "same text"), (4, "other")], "slot long, text string")
    assert [r["slot"] for r in lexical.bm25(twice, "same", 5).orderBy("rank").collect()] == [3, 5]
    allow = docs.filter("slot = 2").select("slot")
    got = lexical.bm25(docs, "python", 5, allow=allow).collect()
    assert {r["slot"]: r["score"] for r in got} == pytest.approx({2: by_hand("python", TEXTS)[2]})


def test_bm25_batch_is_single_by_single(spark, docs):
    qs = [(1, "python"), (2, "language is"), (3, " "), (4, None)]
    asked = spark.createDataFrame(qs, "query_id long, query_text string")
    got = {}
    for r in lexical.bm25_batch(docs, asked, 2).collect():
        got.setdefault(r["query_id"], {})[r["slot"]] = r["score"]
    for i, q in qs:
        assert got.get(i, {}) == pytest.approx({r["slot"]: r["score"] for r in lexical.bm25(docs, q, 2).collect()})


def test_bm25_empty_corpus(docs):
    assert lexical.bm25(docs.limit(0), "python", 5).count() == 0


def test_rrf(spark):
    rank = lambda xs: spark.createDataFrame([(0, s, i + 1) for i, s in enumerate(xs)], "query_id int, slot long, rank int")
    got = rrf(rank([1, 2]), rank([3, 1]), 0.5, 10).orderBy("rank").collect()
    assert [(r["slot"], round(r["score"], 9)) for r in got] == [(1, round(0.5 / 61 + 0.5 / 62, 9)), (3, round(0.5 / 61, 9)), (2, round(0.5 / 62, 9))]
    # on a tie the dense ranking goes first; weights of 0 keep a document with score 0
    assert [r["slot"] for r in rrf(rank([1]), rank([3]), 0.5, 10).orderBy("rank").collect()] == [1, 3]
    assert [(r["slot"], r["score"] > 0) for r in rrf(rank([1]), rank([3]), 1.0, 10).orderBy("rank").collect()] == [(1, True), (3, False)]
    for alpha in (-0.1, 1.1):
        with pytest.raises(RequestError):
            rrf(rank([1]), rank([3]), alpha, 1)


def test_plans(docs):
    hit = plans.search(docs, [1.0, 0.0], 2).collect()
    assert [(r["doc_id"], r["score"]) for r in hit] == [("d0", 1.0), ("d1", 0.993884)]
    assert [r["doc_id"] for r in plans.search(docs, [1.0, 0.0], 2, {"even": False}).collect()] == ["d1", "d3"]
    # a deleted document is never found, nor does it count in the keyword statistics
    assert "d5" not in {r["doc_id"] for r in plans.search(docs, [0.0, 1.0], 10).collect()}
    assert plans.keyword_search(docs, "database").count() == 0
    assert [r["doc_id"] for r in plans.keyword_search(docs, "python", filters={"even": True}).collect()] == ["d0", "d2"]
    assert plans.hybrid_search(docs, "rust", [1.0, 0.0], 1).first()["doc_id"] == "d1"
    with pytest.raises(RequestError):
        plans.hybrid_search(docs, " ", [1.0, 0.0])
    with pytest.raises(RequestError):
        plans.hybrid_search(docs, "x", [1.0, 0.0], alpha=2)


def test_filter_then_search_is_search_over_the_filtered(docs):
    q = [0.6, 0.4]
    a = plans.search(docs, q, 3, {"even": True}).select("doc_id", "score").collect()
    b = plans.search(docs.filter("slot % 2 = 0"), q, 3).select("doc_id", "score").collect()
    assert a == b


def test_written_index(spark, docs, tmp_path):
    index = lexical.Lexicon(str(tmp_path / "index"), buckets=4).build(docs.filter("slot < 3"))
    index.add(docs.filter("slot >= 3"))
    for query in ("python language", "language language rust", "zzz", ""):
        got = {r["slot"]: r["score"] for r in index.search(spark, query).collect()}
        assert got == pytest.approx(by_hand(query, TEXTS))
    index.remove(docs.filter("slot IN (0, 5)").select("slot"))
    kept = {i: t for i, t in enumerate(TEXTS) if i not in (0, 5)}
    want = dict(zip(kept, range(len(kept))))
    hand = by_hand("python", list(kept.values()))
    assert {r["slot"]: r["score"] for r in index.search(spark, "python").collect()} == pytest.approx({i: hand[n] for i, n in want.items() if n in hand})
    plan = index.postings(spark, ["python"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
