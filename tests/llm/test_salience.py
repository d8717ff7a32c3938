from collections import Counter

import numpy as np
import pytest

from vsearch.llm import salience
from vsearch.llm.entries import terms


def by_hand(texts, weight=salience.RECORD_WEIGHT):
    cf = Counter(t for x in texts.values() for t in terms(x))
    total, out = sum(cf.values()), {}
    for i, x in texts.items():
        tf = Counter(terms(x))
        p = {t: n / sum(tf.values()) for t, n in tf.items()}
        for _ in range(2000):
            e = {t: n * weight * p[t] / ((1 - weight) * cf[t] / total + weight * p[t]) for t, n in tf.items()}
            s = sum(e.values())
            q = {t: v / s for t, v in e.items()}
            done = max(abs(q[t] - p[t]) for t in q) < salience.TOLERANCE
            p = q
            if done:
                break
        for t, v in p.items():
            out[i, t] = (tf[t], sum(t in terms(y) for y in texts.values()), cf[t], v)
    return out


TEXTS = {1: "the cat sat on the mat", 2: "The dog the dog the dog barks", 3: "the the the", 4: "unique zebra zebra zebra in the field", 5: "été ÉTÉ 東京 x_1", 6: "the dog"}


@pytest.mark.parametrize("heavy", [1, 3, 4096])
def test_scores(spark, monkeypatch, heavy):
    """The same, however many terms get their counts by broadcast."""
    monkeypatch.setattr(salience, "HEAVY", heavy)
    rows = [(i, t, "x", 1) for i, t in TEXTS.items()] + [(4, TEXTS[4], "y", 2), (7, None, "x", 1), (8, "", "x", 1), (9, " !? ", "x", 1), (None, "the", "x", 1)]
    df = spark.createDataFrame(rows, "seq long, text string, term string, df int").repartition(3)
    got = {(r["id"], r["term"]): (r["tf"], r["df"], r["cf"], r["score"]) for r in salience.term_scores(df).collect()}
    want = by_hand(TEXTS)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k][:3] == v[:3] and got[k][3] == pytest.approx(v[3], abs=1e-5)
    ranked = sorted((t for i, t in got if i == 4), key=lambda t: -got[4, t][3])
    assert ranked[0] == "zebra" and got[4, "the"][3] < got[4, "field"][3]


def test_probabilities_add_up(spark):
    df = spark.createDataFrame([(i, f"common words w{i % 7} w{i} w{i}") for i in range(300)], "seq long, text string")
    sums = salience.term_scores(df).groupBy("id").sum("score").collect()
    assert len(sums) == 300 and all(r[1] == pytest.approx(1) for r in sums)


def test_record_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(400))), (2, "t1 t2")], "seq long, text string")
        sums = {r[0]: r[1] for r in salience.term_scores(df).groupBy("id").sum("score").collect()}
        assert sums == pytest.approx({1: 1.0, 2: 1.0})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert salience.term_scores(spark.createDataFrame([], "seq long, text string")).count() == 0


def test_em_is_stable_for_one_term():
    assert salience.parsimonious(np.array([3.0]), np.array([1.0]), np.array([0])).tolist() == [1.0]
