import numpy as np
import pytest
from pyspark.sql import functions as F

from vsearch.operators import ann, graph
from vsearch.operators.knn import knn, knn_batch
from vsearch.types import RequestError, VectorError


def frame(spark, x):
    return spark.createDataFrame([(i, f"d{i}", [float(a) for a in v], "even" if i % 2 == 0 else "odd") for i, v in enumerate(x)], "slot long, doc_id string, vector array<float>, kind string")


def asking(spark, x, step=20):
    return spark.createDataFrame([(i, [float(a) for a in x[i]]) for i in range(0, len(x), step)], "query_id long, query_vector array<double>")


@pytest.mark.parametrize("n", [1, 2, 40, 513, 4000])
def test_graph(n):
    x = np.random.default_rng(n).normal(size=(n, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = graph.LayeredGraph(x)
    assert g.levels()[0] == n and g.levels() == sorted(g.levels(), reverse=True) and (n <= graph.TOP_NODES) == (len(g.levels()) == 1)
    ids, sims = g.search(x, 50)
    assert (ids[:, 0] == np.arange(n)).mean() > 0.99
    k = min(10, n)
    want = np.argsort(-(x @ x.T), axis=1)[:, :k]
    assert sum(len(set(a) & set(b)) for a, b in zip(ids, want)) >= 0.95 * n * k
    for row in ids:
        real = row[row != g.n]
        assert len(set(real)) == len(real)


def test_many_copies_do_not_cut_off_the_rest():
    x = np.random.default_rng(1).normal(size=(1600, 16)).astype(np.float32)
    x[:1000] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = graph.LayeredGraph(x).search(x[1000:], 50)
    assert (ids[:, 0] == np.arange(1000, 1600)).mean() > 0.95


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall_over_shards(spark, metric):
    x = np.random.default_rng(42).normal(size=(2500, 16)) * np.random.default_rng(1).uniform(0.5, 2, size=(2500, 1))
    df, asked = frame(spark, x), asking(spark, x)
    index = graph.build_graph(df, metric, shard_rows=700)
    assert index.shards == 4 and len(index) == 2500 and "GraphIndex" in repr(index)
    exact = knn_batch(df, asked, 10, metric)
    found = graph.graph_search_batch(index, asked, 10)
    assert ann.recall(found, exact).first()[0] >= 0.95
    scores = {(r["query_id"], r["slot"]): r["score"] for r in exact.collect()}
    assert all(r["score"] == pytest.approx(scores[r["query_id"], r["slot"]], abs=1e-6) for r in found.collect() if (r["query_id"], r["slot"]) in scores)
    for mask in (F.col("kind") == "odd", F.col("slot") < 7, F.col("slot") < 300, F.lit(False)):
        got = graph.graph_search_batch(index, asked, 10, mask=df.filter(mask).select("slot"))
        want = knn_batch(df, asked, 10, metric, mask)
        n = want.count()
        assert got.count() == n and (not n or ann.recall(got, want).first()[0] >= 0.95)
    one = [r["id"] for r in graph.graph_search(index, df, list(x[5]), 3).orderBy("rank").collect()]
    assert one == [r["id"] for r in knn(df, list(x[5]), 3, metric).orderBy("rank").collect()]


def test_odd_vectors_and_requests(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 2.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "slot long, vector array<float>")
    index = graph.build_graph(df)
    assert index.dimension == 2 and len(index) == 4
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "query_id long, query_vector array<double>")
    assert [(r["query_id"], r["slot"], r["score"]) for r in graph.graph_search_batch(index, asked, 9).orderBy("rank").collect()] == [(1, 0, 1.0), (1, 7, 1.0), (1, 1, 0.0), (1, 6, 0.0)]
    assert graph.graph_search_batch(index, asked.limit(0), 9).count() == 0
    with pytest.raises(VectorError):
        graph.build_graph(df.limit(0))
    with pytest.raises(VectorError):
        graph.build_graph(df, m=1)
    with pytest.raises(RequestError):
        graph.graph_search_batch(index, asked, 0)
