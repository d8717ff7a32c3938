import random
import re

import pytest

from vsearch.llm.splitting import BREAKS, split_oversized, split_text, with_specs


def check(text, size, overlap):
    pieces = split_text(text, size, overlap)
    assert "".join(text[new:end] for _, new, end, _ in pieces) == text
    at = 0
    for n, (start, new, end, forced) in enumerate(pieces):
        assert new == at and end - start <= size and end > new
        assert start == (max(0, new - overlap) if n else 0)
        if end < len(text) and not forced:
            assert text[end - 1] in BREAKS or text[end] in BREAKS or longest(text) > size - overlap
        at = end
    assert any(f for *_, f in pieces) == (len(text) > size and longest(text) > size)
    return [text[s:e] for s, _, e, _ in pieces]


def longest(text):
    return max(map(len, re.split(f"[{BREAKS}]", text)))


def words(n, seed=0, alphabet="abcdefgh"):
    rng = random.Random(seed)
    return [("".join(rng.choices(alphabet, k=rng.randint(1, 9)))) for _ in range(n)]


@pytest.mark.parametrize("size,overlap", [(60, 0), (60, 12), (200, 40), (13, 12), (1, 0)])
def test_pieces_tile_the_text(size, overlap):
    rng = random.Random(1)
    for seed in range(60):
        glue = [" ", "\n", "\n\n", ". ", "。", "\n# H\n", "\n- ", "\n```\n", "\u3000"]
        check("".join(w + rng.choice(glue) for w in words(rng.randint(0, 200), seed)), size, overlap)
        check("".join(words(80, seed)) + " x", size, overlap)
        check(" " * 300, size, overlap)


def test_natural_boundaries():
    paras = [" ".join(words(12, i)) + "." for i in range(6)]
    text = "\n\n".join(paras)
    got = check(text, max(map(len, paras)) * 2 + 4, 0)
    assert all(p.strip().endswith(".") and "\n\n" in p for p in got)  # whole paragraphs, two to a piece
    sections = "# A\none two\n\n## B\nthree\n\n# C\nfour five six"
    assert [p.strip() for p in check(sections, 28, 0)] == ["# A\none two\n\n## B\nthree", "# C\nfour five six"]
    items = "intro\n- " + "\n- ".join(" ".join(words(5, i)) for i in range(8))
    assert all(p.startswith("- ") for p in check(items, 60, 0)[1:])
    code = "before " * 8 + "\n\n```\na = 1\n\nb = 2\n```\n\n" + "after " * 8
    assert any("```\na = 1\n\nb = 2\n```" in p for p in check(code, 60, 0))
    assert check("甲乙丙。" * 30, 20, 0)[0] == "甲乙丙。" * 5


def test_sizes():
    assert split_text("abc", 3, 0) == [(0, 0, 3, False)]
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            split_text("abc", size, overlap)


def test_table(spark):
    rows = [(1, "a " * 40, "c", 50, 10, "x"), (2, None, "c", 50, 10, "x"), (3, "", "c", 50, 10, "x"), (4, "short", "c", 50, 10, "x"), (5, "b" * 200, "c", 50, None, "x"), (6, "a " * 40, "c", None, 1, "x"), (1, "a " * 40, "c", 50, 10, "x")]
    df = spark.createDataFrame(rows, "id long, text string, coll_name string, chunk_size int, overlap int, piece string")
    got = split_oversized(df).collect()
    assert {r["id"] for r in got} == {1, 5} and {r["piece_kind"] for r in got if r["id"] == 5} == {"forced"}
    one = sorted((r["piece_no"], r["piece"], r["overlap_len"]) for r in got if r["id"] == 1)
    assert len(one) == 4 and one[0] == one[1] and one[2][2] == 10  # a repeated row gives its pieces again
    assert split_oversized(df.limit(0)).count() == 0
    assert all(r["piece"] is None for r in split_oversized(df, with_text=False).collect())
    specs = spark.createDataFrame([("c", 20, 0)], "coll_name string, chunk_size int, overlap int")
    assert {r["id"] for r in split_oversized(with_specs(df, specs)).collect()} == {1, 5, 6}


def test_very_long_text():
    text = " ".join(words(200_000))
    pieces = split_text(text, 1000, 100)
    assert len(pieces) > 900 and all(e - s <= 1000 for s, _, e, _ in pieces)
