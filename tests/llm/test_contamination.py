import random

import pytest

from vsearch.llm.contamination import SuffixAutomaton, leaks, without_spans
from vsearch.llm.entries import terms


def leaked(doc, item, run=12):
    d, i = terms(doc), terms(item)
    n = min(run, len(i))
    grams = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if i else set()
    return any(tuple(d[k : k + n]) in grams for k in range(len(d) - n + 1))


@pytest.mark.parametrize("run", [1, 3, 12])
def test_automaton_against_all_grams(run):
    rng = random.Random(run)
    for _ in range(150):
        word = lambda n: " ".join(rng.choices("abc", k=n))
        items = [(k, word(rng.randint(0, 9 if run < 12 else 30))) for k in range(5)]
        a = SuffixAutomaton([(k, terms(t)) for k, t in items], run)
        doc = word(rng.randint(0, 40)) + " zz " + rng.choice(items)[1]
        found, spans = a.scan(terms(doc))
        assert found == {k for k, t in items if leaked(doc, t, run)}
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:])) and bool(spans) == bool(found)


ITEM = "What is the name of the only river that flows both north and south of the equator line"
SHORT = "Tiny item"


def test_documents(spark):
    words = ITEM.split()
    docs = [
        (1, f"before {ITEM.upper()}! after", "x"), (2, "intro " + " ".join(words[3:15]) + " rest", "x"), (3, " ".join(words[3:14]), "x"), (4, "a TINY, item here", "x"),
        (5, None, "x"), (6, "", "x"), (7, "İ " + ITEM, "x"), (8, ITEM, "x"), (8, ITEM, "x"), (None, ITEM, "x"), (9, "word " * 50_000 + ITEM, "x"),
    ]
    items = [(10, ITEM), (11, SHORT), (12, None), (13, ""), (14, ITEM), (15, "...")]
    d = spark.createDataFrame(docs, "doc_id long, text string, items string").repartition(3)
    e = spark.createDataFrame(items, "item_id long, text string")
    found = leaks(d, e)
    got = sorted((r["id"], tuple(r["items"])) for r in found.collect())
    assert got == [(1, (10, 14)), (2, (10, 14)), (4, (11,)), (7, (10, 14)), (8, (10, 14)), (9, (10, 14))]
    spans = {r["id"]: [docs[0][1][s["start_pos"] : s["end_pos"]] for s in r["spans"]] for r in found.filter("id = 1").collect()}
    assert spans[1] == [ITEM.upper()]
    cut = {r["id"]: (r["action"], r["text"]) for r in without_spans(d.filter("doc_id IN (1, 2, 4, 7)"), found.filter("id IN (1, 2, 4, 7)"), most_covered=0.87).collect()}
    assert cut == {1: ("drop", None), 2: ("cut", "intro  rest"), 4: ("cut", "a  here"), 7: ("drop", None)}


def test_positions_are_exact_where_lower_case_changes_lengths(spark):
    text = "İİ ΟΔΟΣ İstanbul " + ITEM.replace("river", "RİVER") + " ΣΑΣ İ end " + "other " * 60
    item = ITEM.replace("river", "rİver")
    d, e = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    found = leaks(d, e)
    (span,) = found.first()["spans"]
    assert text[span["start_pos"] : span["end_pos"]] == ITEM.replace("river", "RİVER")
    assert without_spans(d, found).first()["text"] == text.replace(ITEM.replace("river", "RİVER"), "")


def rows(found):
    return sorted((r["id"], r["items"], [tuple(x) for x in r["spans"]], round(r["covered"], 9)) for r in found.collect())


@pytest.mark.parametrize("chars,scan", [(40, 1 << 28), (40, 1), (5_000, 1 << 28)])
def test_many_automata_agree_with_one(spark, monkeypatch, chars, scan):
    from vsearch.llm import contamination

    docs = spark.createDataFrame([(i, f"item number {i} has exactly these words in it and number {i + 3} has them too") for i in range(30)] + [(99, None)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"number {i} has") for i in range(0, 30, 3)] + [(50, "has exactly these words"), (51, "these words in it")], "item_id long, text string")
    one = rows(leaks(docs, items))
    assert len(one) == 30 and one[0][1] == [0, 3, 50, 51]
    monkeypatch.setattr(contamination, "AUTOMATON_CHARS", chars)
    monkeypatch.setattr(contamination, "SCAN_BYTES", scan)
    assert rows(leaks(docs, items)) == one


def test_many_automata_agree_on_the_tables(spark, sf_dir, monkeypatch):
    from vsearch.llm import contamination

    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "eval_items"))
    monkeypatch.setattr(contamination, "AUTOMATON_CHARS", 4_000_000)
    one = rows(leaks(docs, items))
    monkeypatch.setattr(contamination, "AUTOMATON_CHARS", 5_000)
    assert rows(leaks(docs, items)) == one and one


def test_empty(spark):
    d, e = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks(d, e).count() == 0
    assert leaks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), e).count() == 0
    assert leaks(d, spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0
