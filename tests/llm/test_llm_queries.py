import pathlib
import re

import pytest
from oracle import check

from vsearch.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    check(spark, sf_dir, llm.queries()[name], SQL[name])


COLUMNS = {"p3_found": {"seq_a", "seq_b"}, "p5_found": {"seq", "markup"}, "p8_found": {"doc_id", "end_pos"}, "p3_knn": None, "p4_groups": None, "p5_clean": None, "p6_clean": None, "p7_mix": None, "p7_report": None, "p8_sentences": None, "p1_pieces": None, "p2_term_scores": None}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_runs(spark, sf_dir, name):
    df = llm.queries()[name](spark, sf_dir)
    assert COLUMNS[name] in (None, set(df.columns))
    assert df.count() > 0


def test_names_cover_all_problems():
    assert {int(re.match(r"p(\d)_", n)[1]) for n in llm.queries()} == set(range(1, 9))


def test_nothing_else_imports_this_subpackage():
    root = pathlib.Path(llm.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "vsearch.llm" not in f.read_text(encoding="utf-8"), f
