import random

import pytest
from pyspark.sql import functions as F

from vsearch.operators import mutate
from vsearch.operators.numbering import dense_number
from vsearch.types import DOCS, LOG, StoreError

START = [(0, "a", "ta", [1.0], "{}", True), (1, "b", "tb", [1.0], "{}", False), (4, "c", "tc", [1.0], "{}", True)]


def state(df):
    return sorted((r["slot"], r["doc_id"], r["text"], r["active"]) for r in df.collect())


def fold(ops, revive, start=START):
    """One entry after the other."""
    docs = {d: [s, t, on] for s, d, t, _, _, on in start}
    last = max(s for s, *_ in docs.values())
    for _, op, d, text in sorted(ops):
        there = d in docs
        if op == "insert" and (not there or revive and not docs[d][2]) or op == "update":
            if there:
                docs[d][1:] = [text, True]
            else:
                last += 1
                docs[d] = [last, text, True]
        elif op == "delete" and there:
            docs[d][2] = False
    return sorted((s, d, t, on) for d, (s, t, on) in docs.items())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(START, DOCS).cache()


def log(spark, ops):
    return spark.createDataFrame([(i, op, d, t, None, None) for i, op, d, t in ops], LOG)


@pytest.mark.parametrize("revive", [False, True])
def test_replay_is_the_fold_in_order(spark, revive):
    """Hundreds of documents with random histories at once, and one that takes a third of all entries."""
    rng = random.Random(5)
    start = [(i, f"d{i:03}", f"t{i}", [1.0], "{}", rng.random() < 0.6) for i in range(150)]
    ids = [f"d{i:03}" for i in range(400)]
    ops = []
    for i in range(1800):
        op = rng.choice(["insert", "update", "delete"]) if rng.random() < 0.5 else rng.choice(["insert", "delete"])
        d = "d399" if rng.random() < 0.33 else rng.choice(ids)
        ops.append((i, op, d, None if op == "delete" else f"{op}{i}"))
    got = mutate.replay(spark.createDataFrame(start, DOCS), log(spark, ops).repartition(5), revive)
    assert state(got) == fold(ops, revive, start)


def test_replay_takes_each_seq_once_and_ops_in_capitals(spark, docs):
    ops = [(1, "INSERT", "x", "tx"), (1, "INSERT", "x", "tx"), (2, " Delete ", "a", None), (3, "noop", "c", "?"), (None, "update", "c", "?"), (4, "update", None, "?")]
    assert state(mutate.replay(docs, log(spark, ops))) == [(0, "a", "ta", False), (1, "b", "tb", False), (4, "c", "tc", True), (5, "x", "tx", True)]


def test_replay_onto_nothing_and_of_nothing(spark, docs):
    none = docs.limit(0)
    assert state(mutate.replay(none, log(spark, [(1, "insert", "x", "1"), (2, "delete", "y", None)]))) == [(0, "x", "1", True)]
    assert state(mutate.replay(docs, log(spark, []))) == state(docs)


def rows(spark, data):
    return spark.createDataFrame([(i, d, t, [2.0], None) for i, d, t in data], "seq long, doc_id string, text string, vector array<float>, metadata string")


def test_add(spark, docs):
    got = state(mutate.add(docs, rows(spark, [(2, "y", "ty"), (1, "x", "tx")])))
    assert got[-2:] == [(5, "x", "tx", True), (6, "y", "ty", True)]
    for bad in ([(1, "a", "again")], [(1, "b", "deleted, but there")], [(1, "x", "1"), (2, "x", "2")]):
        with pytest.raises(StoreError):
            mutate.add(docs, rows(spark, bad))
    assert state(mutate.add(docs, rows(spark, [(1, "a", "no"), (2, "x", "yes"), (3, "x", "no")]), strict=False))[-1] == (5, "x", "yes", True)


def test_update(spark, docs):
    got = mutate.update(docs, rows(spark, [(1, "b", "old"), (2, "b", "new")]))
    assert state(got) == [(0, "a", "ta", True), (1, "b", "new", True), (4, "c", "tc", True)]
    assert got.filter("doc_id = 'b'").first()["metadata"] == "{}"
    with pytest.raises(StoreError):
        mutate.update(docs, rows(spark, [(1, "x", "?")]))


def test_upsert(spark, docs):
    got = state(mutate.upsert(docs, rows(spark, [(1, "a", "a2"), (2, "b", "b2"), (3, "x", "x2")])))
    assert got == [(0, "a", "a2", True), (4, "c", "tc", True), (5, "b", "b2", True), (6, "x", "x2", True)]


def test_delete_and_compact(spark, docs):
    gone = mutate.delete(docs, spark.createDataFrame([("a",), ("b",)], "doc_id string"))
    assert state(gone) == [(0, "a", "ta", False), (1, "b", "tb", False), (4, "c", "tc", True)]
    assert state(mutate.compact(gone)) == [(0, "c", "tc", True)]
    assert state(mutate.compact(docs.limit(0))) == []
    with pytest.raises(StoreError):
        mutate.delete(docs, spark.createDataFrame([("x",)], "doc_id string"))
    assert list(mutate.collection_info(gone).first()) == [3, 1, 2, 1]


def test_dense_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    got = sorted((r["k"], r["n"]) for r in dense_number(df, ["k"], "n", 10).collect())
    assert [n for _, n in got] == list(range(10, 1010))
