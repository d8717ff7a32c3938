import os

import pytest

from vsearch.llm import mixing as X

pytestmark = pytest.mark.skipif(not os.path.exists(X.VOCABULARY), reason="no tokenizer files")
PLAN = "plan_id int, source string, target_weight double, max_repeats int, total_tokens long"


def docs(spark, counts):
    rows = [(f"{s}-{i}", s) for s, n in counts.items() for i in range(n)]
    return spark.createDataFrame([(k, " ".join(["token"] * (1 + k % 7)), s, "x") for k, (_, s) in enumerate(rows)], "doc_id long, text string, source string, copies string").repartition(4)


def test_counts():
    assert X.count_tokens("") == 0
    for text in ("hello world " * 9000, "don't <|endoftext|> stop 12345 été 東京" * 20, "x" * 50_000, "a b\n\n c " * 9000):
        assert X.count_tokens(text) == len(X._encoding(X.VOCABULARY).encode_ordinary(text))


@pytest.mark.parametrize("stretch", [20, 10**6])
def test_shares_and_repeats(spark, monkeypatch, stretch):
    monkeypatch.setattr(X, "STRETCH_ROWS", stretch)
    d = docs(spark, {"big": 900, "mid": 300, "Small ": 40, "unasked": 50})
    t = spark.createDataFrame([(1, "big", 2.0, 1, 1200), (1, "mid", 1.0, 3, 1200), (1, "small", 1.0, 2, 1200), (2, "SMALL", 1.0, 50, 3000), (3, "absent", 1.0, 5, 100), (4, "big", 0.0, 1, 100), (4, "mid", None, 1, 100)], PLAN)
    selection, report = X.mix(d, t)
    rep = {(r["plan_id"], r["source"]): r for r in report.collect()}
    assert len(rep) == 7
    big, mid, small = (rep[1, s] for s in ("big", "mid", "small"))
    assert abs(big["actual_tokens"] - 600) < 30 and abs(mid["actual_tokens"] - 300) < 30
    # too small for its share of 300: each document twice, and no more
    assert small["actual_tokens"] == 2 * small["source_tokens"] < 330 and small["most_copies"] == 2 or small["expected"] <= 2
    assert sum(rep[1, s]["actual_share"] for s in ("big", "mid", "small")) == pytest.approx(1)
    assert abs(rep[2, "small"]["actual_tokens"] - 3000) < 200
    assert rep[3, "absent"]["actual_tokens"] == 0 and rep[4, "big"]["actual_tokens"] == 0
    rows = selection.collect()
    assert all(1 <= r["copies"] <= -(-rep[r["plan_id"], r["source"]]["expected"] // 1) for r in rows)
    assert all(r["copies"] <= rep[r["plan_id"], r["source"]]["max_repeats"] for r in rows)
    for (plan, source), r in rep.items():
        mine = [x for x in rows if (x["plan_id"], x["source"]) == (plan, source)]
        n = {"big": 900, "mid": 300, "small": 40}.get(source, 0)
        # copies are the whole numbers crossed by a prefix sum of n equal steps
        assert abs(sum(x["copies"] for x in mine) - n * r["expected"]) < 1
        assert sum(x["copies"] * x["n_tokens"] for x in mine) == r["actual_tokens"]
    again = X.mix(d, t)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    other = X.mix(d, t, seed=1)[0].collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, rows))


def test_nulls_blanks_and_double_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, " ", "s"), (4, "x", None), (None, "x", "s"), (5, "d e", " S")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([(1, "s", 1.0, 9, 16), (1, "S ", 1.0, 2, 16)], PLAN)
    selection, report = X.mix(d, t)
    assert sorted((r["id"], r["copies"]) for r in selection.collect()) == [(1, 2), (1, 2), (5, 2)]
    r = report.collect()
    assert len(r) == 1 and r[0]["max_repeats"] == 2 and r[0]["target_share"] == 1.0


def test_empty(spark):
    d = docs(spark, {"a": 3})
    t = spark.createDataFrame([(1, "a", 1.0, 1, 5)], PLAN)
    for x, y in ((d.limit(0), t), (d, t.limit(0))):
        selection, report = X.mix(x, y)
        assert selection.count() == 0 and report.count() == y.count()
