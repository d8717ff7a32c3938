"""What the operators on log entries share: one row per entry, and terms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A term is a maximal run of letters, digits and "_" in the lower-cased text.
TERM_PATTERN = r"[\p{L}\p{N}_]+"
TERM = re.compile(r"\w+")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def entry_texts(df: DataFrame, id_col: str = "seq", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per id with its text, ids or texts that are null left out.

    Re-delivered rows agree in their text; should they not, the least one is
    taken. The result is hash-partitioned by id, which later groupings by
    (id, ...) reuse without another shuffle.
    """
    kept = [F.min(c).alias(c) for c in keep]
    return (
        df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(text_col).alias("text"), *kept)
    )
