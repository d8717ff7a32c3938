import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vsearch.functions import vector as V
from vsearch.operators import ann
from vsearch.operators.knn import knn, knn_batch, knn_batch_native
from vsearch.types import RequestError, VectorError

DOCS = [(0, "d1", [1.0, 0.0, 0.0, 0.0], "animals"), (1, "d2", [0.9, 0.1, 0.0, 0.0], "animals"), (2, "d3", [0.8, 0.2, 0.0, 0.0], "vehicles"), (3, "d4", [0.7, 0.3, 0.0, 0.0], "vehicles")]
Q = [1.0, 0.0, 0.0, 0.0]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "slot long, doc_id string, vector array<float>, category string")


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_cosine_order(docs):
    assert ids(knn(docs, Q, 3)) == ["d1", "d2", "d3"]


def test_l2_distance_is_not_squared(spark):
    df = spark.createDataFrame([(0, "a", [0.0, 0.0]), (1, "b", [3.0, 4.0])], "slot long, doc_id string, vector array<float>")
    got = knn(df, [0.0, 0.0], 2, "l2").orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [("a", 0.0), ("b", 5.0)]


def test_mask_applies_before_the_search(docs):
    assert ids(knn(docs, Q, 2, mask=F.col("category") == "vehicles")) == ["d3", "d4"]
    assert ids(knn(docs, Q, 2, mask=F.lit(False))) == []


def test_k_beyond_n_ties_and_zero_vectors(spark):
    df = spark.createDataFrame([(2, "z", [0.0, 0.0]), (1, "a", [1.0, 0.0]), (0, "b", [1.0, 0.0])], "slot long, doc_id string, vector array<float>")
    got = knn(df, [1.0, 0.0], 10).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [("b", 1.0), ("a", 1.0), ("z", 0.0)]
    assert [r["score"] for r in knn(df, [0.0, 0.0], 10).collect()] == [0.0, 0.0, 0.0]


def test_null_short_and_empty_vectors_are_no_candidates(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "b", [1.0]), (2, "c", []), (3, "d", [1.0, 1.0])], "slot long, doc_id string, vector array<float>")
    assert ids(knn(df, [1.0, 0.0], 5)) == ["d"]
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, query_vector array<double>")
    assert [(r["query_id"], r["slot"]) for r in knn_batch(df, asked, 5).collect()] == [(7, 3)]


@pytest.mark.parametrize("metric", V.METRICS)
def test_scores_that_are_not_finite(spark, metric):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, "a", [nan, 1.0]), (1, "b", [inf, 1.0]), (2, "c", [1.0, 1.0])], "slot long, doc_id string, vector array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query_vector array<double>")
    assert ids(knn(df, [1.0, 0.0], 5, metric)) == ["c"]
    for run in (knn_batch, knn_batch_native):
        assert [r["slot"] for r in run(df, asked, 5, metric).collect()] == [2]


def test_bad_requests(docs):
    for k in (0, -1, 1.5):
        with pytest.raises(RequestError):
            knn(docs, Q, k)
    with pytest.raises(VectorError):
        knn(docs, Q, 1, "dot")
    with pytest.raises(VectorError):
        knn(docs, [], 1)


def test_empty_table(spark, docs):
    none = docs.limit(0)
    asked = spark.createDataFrame([(1, Q)], "query_id long, query_vector array<double>")
    assert knn(none, Q, 3).count() == 0
    assert knn_batch(none, asked, 3).count() == 0
    assert knn_batch(docs, asked.limit(0), 3).count() == 0


@pytest.mark.parametrize("metric", V.METRICS)
def test_batch_is_single_by_single(spark, docs, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[7] = x[3]
    df = spark.createDataFrame([(i, f"d{i}", [float(a) for a in v]) for i, v in enumerate(x)], "slot long, doc_id string, vector array<float>").repartition(5)
    qs = [(i, [float(a) for a in x[i * 3]]) for i in range(4)]
    asked = spark.createDataFrame(qs, "query_id long, query_vector array<double>")
    for run in (knn_batch, knn_batch_native):
        got = {(r["query_id"], r["rank"]): (r["slot"], round(r["score"], 9)) for r in run(df, asked, 5, metric).collect()}
        for i, q in qs:
            for r in knn(df, q, 5, metric).collect():
                assert got[i, r["rank"]] == (r["slot"], pytest.approx(r["score"], abs=1e-8))


def test_columns(spark):
    r = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>").select(
        V.dot(F.col("a"), F.col("b")), V.norm(F.col("a")), V.cosine(F.col("a"), F.col("b")), V.l2(F.col("a"), F.col("b"))
    ).first()
    assert list(r) == pytest.approx([24.0, 5.0, 0.96, math.sqrt(2)])


def test_top_k_plan(docs):
    plan = knn(docs, Q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("metric", V.METRICS)
def test_cells(spark, metric, tmp_path):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(400, 16))
    df = spark.createDataFrame([(i, f"d{i}", [float(a) for a in v]) for i, v in enumerate(x)], "slot long, doc_id string, vector array<float>")
    asked = spark.createDataFrame([(i, [float(a) for a in x[i]]) for i in range(0, 400, 20)], "query_id long, query_vector array<double>")
    index = ann.build_cells(df, 8, metric, path=str(tmp_path / "index"))
    exact = knn_batch(df, asked, 10, metric)
    assert ann.recall(ann.cell_search_batch(index, asked, 10, 8), exact).first()[0] == 1.0
    assert ann.recall(ann.cell_search_batch(index, asked, 10, 5), exact).first()[0] >= 0.9
    assert ids(ann.cell_search(index, list(x[5]), 3, 8)) == ids(knn(df, list(x[5]), 3, metric))
    few = F.col("slot") < 20  # few eligible rows: exact, whatever nprobe
    assert ids(ann.cell_search(index, list(x[5]), 3, 1, few)) == ids(knn(df, list(x[5]), 3, metric, few))
    plan = ann.cell_search(index, list(x[5]), 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_cells_need_vectors(spark, docs):
    with pytest.raises(VectorError):
        ann.build_cells(docs.limit(0))


def test_the_cells_dimension_is_that_of_most(spark):
    rows = [(i, f"d{i}", [1.0] if i < 4 else [float(i), 1.0]) for i in range(30)]
    index = ann.build_cells(spark.createDataFrame(rows, "slot long, doc_id string, vector array<float>"))
    assert index.centroids.shape == (16, 2) and index.rows.filter("cell < 0").count() == 4
    assert ids(ann.cell_search(index, [9.0, 1.0], 1, 4, exact_rows=0)) != []


def test_groups_and_flags_of_a_batch(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(a) for a in rng.normal(size=4)], [None, "a", "b", "c"][i % 4], [True, i % 3 == 0]) for i in range(90)]
    df = spark.createDataFrame(rows, "slot long, vector array<float>, g string, flags array<boolean>").repartition(3)
    asked = spark.createDataFrame([(q, [float(a) for a in rng.normal(size=4)], ["a", "b", "zz", None][q % 4], q % 2) for q in range(8)], "query_id long, query_vector array<double>, g string, f int")
    got = knn_batch(df, asked, 4, group_col="g", query_group="g", flags_col="flags", query_flag="f").collect()
    for r in asked.collect():
        want = [] if r["g"] is None else knn(df, r["query_vector"], 4, mask=(F.col("g") == r["g"]) & F.col("flags")[r["f"]], id_col="slot").orderBy("rank").collect()
        assert sorted((x["rank"], x["slot"]) for x in got if x["query_id"] == r["query_id"]) == [(x["rank"], x["slot"]) for x in want]
