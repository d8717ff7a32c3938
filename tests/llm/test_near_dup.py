import random

import numpy as np
import pytest

from vsearch.llm import near_dup as N
from vsearch.llm.components import components
from vsearch.llm.entries import terms


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        i = rng.randrange(len(w))
        rng.choice([lambda: w.insert(i, f"n{rng.randrange(999)}"), lambda: w.__setitem__(i, f"s{rng.randrange(999)}"), lambda: w.pop(i)])()
    return w


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for g in range(60):
        base = rng.choices(vocab, k=rng.randint(20, 120))
        out += [" ".join(edited(rng, base, rng.randint(0, 1 + len(base) // 14))) for _ in range(rng.randint(1, 5))]
    boiler = " ".join(rng.choices(vocab, k=60))  # half of it is shared by many otherwise different texts
    out += [boiler + " " + " ".join(rng.choices(vocab, k=60)) for _ in range(40)]
    return {i * 3: t for i, t in enumerate(out)}


def sets(texts, width=3, least=20):
    return {i: {tuple(t[k : k + width]) for k in range(len(t) - width + 1)} for i, t in ((i, terms(x)) for i, x in texts.items()) if len(t) >= least}


def truth(texts, similarity=0.6, width=3):
    s = sorted(sets(texts, width).items())
    return {(a, b) for n, (a, x) in enumerate(s) for b, y in s[n + 1 :] if len(x & y) >= similarity * len(x | y)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "seq long, text string, id string, key double").repartition(3)


@pytest.mark.parametrize("similarity,width", [(0.6, 3), (0.8, 5)])
def test_against_all_pairs(spark, texts, similarity, width):
    links, classes = N.near_duplicates(frame(spark, texts.items()), similarity=similarity, width=width)
    got = {(r["a"], r["b"]) for r in N.expanded(links, classes).collect()}
    want = truth(texts, similarity, width)
    assert len(want) > 20 and got <= want and len(got) >= 0.98 * len(want)


def test_hot_variants_are_joined_in_blocks(spark, texts, monkeypatch):
    whole = {(r["a"], r["b"]) for r in N.near_duplicates(frame(spark, texts.items()))[0].collect()}
    monkeypatch.setattr(N, "BLOCK_TEXTS", 1)
    rows = N.near_duplicates(frame(spark, texts.items()))[0].collect()
    assert {(r["a"], r["b"]) for r in rows} == whole and len(rows) == len(whole)


def test_variants_meet_in_the_middle():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        common = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        a = np.unique(np.r_[common, rng.integers(0, 1 << 63, 30, dtype=np.uint64)])
        b = np.unique(np.r_[common, rng.integers(0, 1 << 63, 30, dtype=np.uint64)])
        met += bool(len(np.intersect1d(N.variants(a), N.variants(b))))
    assert met >= 290  # similarity 0.6
    tiny = np.array([1, 2, 3], np.uint64)
    for other in ([1, 2, 3, 4], [1, 2], [1, 2, 3]):
        assert len(np.intersect1d(N.variants(tiny), N.variants(np.array(other, np.uint64))))


@pytest.mark.parametrize("size,least", [(5, 300), (8, 300), (10, 300), (15, 300), (20, 294), (30, 294), (150, 296)])
def test_a_set_meets_one_that_contains_it(size, least):
    rng = np.random.default_rng(size)
    met = 0
    for _ in range(300):
        whole = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        part = np.sort(rng.permutation(whole)[: -(-size * 6 // 10)])  # similarity 0.6 or little more
        met += bool(len(np.intersect1d(N.variants(whole), N.variants(part))))
    assert met >= least


def test_copies_nulls_and_short_texts(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(i, long) for i in range(10, 15)] + [(10, long), (20, long + " tail"), (1, None), (2, ""), (3, "a b c"), (4, "x " * 19), (None, long), (30, "y " * 25), (31, "y " * 500)]
    links, classes = N.near_duplicates(frame(spark, rows))
    assert sorted((r["id"], r["rep"]) for r in classes.collect()) == [(10, 10), (11, 10), (12, 10), (13, 10), (14, 10), (20, 20), (30, 30), (31, 30)]
    want = {(a, b) for a in range(10, 15) for b in range(a + 1, 15)} | {(a, 20) for a in range(10, 15)} | {(30, 31)}
    rows = N.expanded(links, classes).collect()
    assert {(r["a"], r["b"]) for r in rows} == want and len(rows) == len(want)
    got = {r["id"]: (r["rep"], r["group_id"], r["n_links"]) for r in N.groups(links, classes).collect()}
    assert got == {**{i: (10, 10, 1) for i in range(10, 15)}, 20: (20, 10, 1), 30: (30, 30, 0), 31: (30, 30, 0)}


def test_a_hot_class_is_not_spelt_out(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(i, long) for i in range(300)] + [(1000, long + " more")]
    links, classes = N.near_duplicates(frame(spark, rows))
    got = {(r["a"], r["b"]) for r in N.expanded(links, classes).collect()}
    assert got == {(0, i) for i in range(1, 300)} | {(0, 1000)}
    assert {r["group_id"] for r in N.groups(links, classes).collect()} == {0}


@pytest.mark.parametrize("block", [N.BLOCK_TEXTS, 4])
def test_different_texts_of_one_class_are_spelt_out(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_TEXTS", block)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[:i], words[i].upper(), *words[i + 1 :]])) for i in range(30)]  # one shingle set, 30 texts
    near = [(100, " ".join([*words, "more"])), (101, " ".join([*words, "more!"])), (102, " ".join([*words, "else"]))]
    copies = [(i, rows[7][1]) for i in range(200, 225)]  # of text 7, more than EXPAND with it
    links, classes = N.near_duplicates(frame(spark, rows + near + copies))
    got = [(r["a"], r["b"]) for r in N.expanded(links, classes).collect()]
    ids = [i for i, _ in rows + near]
    assert sorted(got) == sorted([(a, b) for a in ids for b in ids if a < b] + [(7, i) for i, _ in copies])


def test_empty(spark):
    links, classes = N.near_duplicates(spark.createDataFrame([], "seq long, text string"))
    assert links.count() == 0 and N.expanded(links, classes).count() == 0 and N.groups(links, classes).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (200, 200), (5, None), (2, 1), (1, 2)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
