import json

import pytest
from oracle import check
from pyspark.sql import functions as F

from vsearch import queries as core
from vsearch.plans import search as plans
from vsearch.store import Store
from vsearch.types import RequestError, StoreError

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    check(spark, sf_dir, core.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert core.queries()[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(core.queries())


def test_flagship(spark, sf_dir):
    import __spark_entry__ as entry

    assert core.hybrid_batch(spark, sf_dir).count() > 0
    assert set(core.queries()) <= set(entry.queries())


@pytest.mark.parametrize("damage", [("metadata", "'{}'"), ("vector", "reverse(vector)"), ("text", "CAST(NULL AS STRING)")])
def test_roundtrip_goes_through_the_store_and_compares_all_values(spark, sf_dir, monkeypatch, damage):
    load = Store.load
    monkeypatch.setattr(Store, "load", lambda self: load(self).withColumn(damage[0], F.expr(damage[1])))
    with pytest.raises(StoreError):
        core.snapshot_roundtrip(spark, sf_dir).count()


def test_roundtrip_misses_no_row(spark, sf_dir, monkeypatch):
    load = Store.load
    monkeypatch.setattr(Store, "load", lambda self: load(self).filter("slot > 0"))
    with pytest.raises(StoreError):
        core.snapshot_roundtrip(spark, sf_dir).count()


def test_filters_are_worked_through_in_blocks(spark, sf_dir, monkeypatch):
    whole = sorted(map(tuple, core.hybrid_batch(spark, sf_dir).collect()))
    seen = []
    run = plans.hybrid_batch
    monkeypatch.setattr(plans, "hybrid_batch", lambda docs, asked, filters: seen.append(len(filters)) or run(docs, asked, filters))
    monkeypatch.setattr(core, "FILTER_BLOCK", 3)
    assert sorted(map(tuple, core.hybrid_batch(spark, sf_dir).collect())) == whole
    assert seen == [0, 3, 1]


def test_more_filters_than_a_block(spark, sf_dir):
    """1,500 different filters: all are answered, and no table of allowed rows is made."""
    some = core.search_queries(spark, sf_dir).filter("trim(query_text) <> ''").limit(1).drop("filter_json", "query_id")
    many = spark.range(1500).select(F.col("id").alias("query_id"), F.format_string('{"lang": {"$ne": "x%d"}}', "id").alias("filter_json")).crossJoin(F.broadcast(some))
    rows = core.docs(spark, sf_dir)
    names = [r[0] for r in many.select("filter_json").collect()]
    found = [plans.hybrid_batch(rows, many.filter(F.col("filter_json").isin(block)), {t: json.loads(t) for t in block}) for block in (names[:1000], names[1000:])]
    want = found[0].filter("query_id = 0").count()
    assert want > 0 and all(f.groupBy("query_id").count().filter(F.col("count") == want).count() == n for f, n in zip(found, (1000, 500)))
    plan = found[0]._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan


def test_a_query_whose_filter_is_lacking_is_an_error(spark, sf_dir):
    with pytest.raises(RequestError):
        plans.hybrid_batch(core.docs(spark, sf_dir), core.search_queries(spark, sf_dir), {}).count()
