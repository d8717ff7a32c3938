"""Problem 2: how distinctive a term is for a record.

Parsimonious language model: a record's term mass is split by expectation
maximisation between the record itself and the whole collection. Common terms
are explained by the collection and lose their mass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vsearch.llm.entries import TERM_PATTERN, entry_texts
from vsearch.runtime import partitions, stage

#: Terms in at least 1/HEAVY of all postings get their counts by broadcast. There can't be more than HEAVY of them, at any size.
HEAVY = 4096
#: Of a posting in a shuffle, about.
POSTING_BYTES = 80
RECORD_WEIGHT = 0.1
TOLERANCE = 1e-7
ROUNDS = 200


def parsimonious(tf: np.ndarray, background: np.ndarray, starts: np.ndarray, weight: float = RECORD_WEIGHT) -> np.ndarray:
    """Converged P(term | record) of consecutive records; ``starts`` holds where each begins."""
    sizes = np.diff(np.append(starts, len(tf)))
    p = tf / np.repeat(np.add.reduceat(tf, starts), sizes)
    for _ in range(ROUNDS):
        mass = tf * (weight * p) / ((1 - weight) * background + weight * p)
        q = mass / np.repeat(np.add.reduceat(mass, starts), sizes)
        done = np.abs(q - p).max() < TOLERANCE
        p = q
        if done:
            break
    return p


def _score(batches: Iterator[pa.RecordBatch], weight: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by id; a record may span batches, so the last one is held back."""
    held: list[pa.RecordBatch] = []

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows:
            ids = t["id"].to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            p = parsimonious(t["tf"].to_numpy().astype(float), t["background"].to_numpy(), starts, weight)
            yield from t.drop_columns(["background"]).append_column("score", pa.array(p)).combine_chunks().to_batches()

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= 50_000 and batch.column(0)[0] != batch.column(0)[-1]:
            t = pa.Table.from_batches(held)
            ids = t["id"].to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            yield from done(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            rows = t.num_rows - cut
    if held:
        yield from done(pa.Table.from_batches(held))


def postings(df: DataFrame, id_col: str = "seq", text_col: str = "text") -> DataFrame:
    """(id, term, tf) of every record; counted inside the partitioning by id that removes repeated rows."""
    toks = entry_texts(df, id_col, text_col).select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM_PATTERN), F.lit(0))).alias("term"))
    return toks.groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"))


def term_scores(df: DataFrame, id_col: str = "seq", text_col: str = "text", weight: float = RECORD_WEIGHT) -> DataFrame:
    """(id, term, tf, df, cf, score) for every term of every record.

    ``tf`` counts the term in the record, ``df`` the records that hold it,
    ``cf`` its occurrences in all of them; ``score`` is the converged
    probability of the term in the record. Equal texts count once per id; rows
    with a null id or text, and texts without terms, give no rows. Terms that
    tie get equal scores.

    Counts of heavy terms are broadcast (at most ``HEAVY`` rows by
    construction), so no term that most records share becomes one task; the
    rest, each below 1/``HEAVY`` of the postings, are joined by shuffle.
    """
    post = stage(postings(df, id_col, text_col), "postings")
    counts = stage(post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "terms")
    n_post, total = counts.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("cf"), F.lit(0))).first()
    least = n_post / HEAVY
    heavy = F.broadcast(counts.filter(F.col("df") >= least))
    tasks = partitions(df.sparkSession, n_post * POSTING_BYTES)
    rare = counts.filter(F.col("df") < least).repartition(tasks, "term")
    known = post.join(heavy, "term").unionByName(post.join(heavy, "term", "left_anti").repartition(tasks, "term").join(rare.hint("merge"), "term"))
    rows = (
        known.select("id", "term", "tf", "df", "cf", (F.col("cf") / F.lit(float(max(total, 1)))).alias("background"))
        .repartition(tasks, "id")
        .sortWithinPartitions("id")
    )
    return rows.mapInArrow(lambda it: _score(it, weight), "id long, term string, tf int, df long, cf long, score double")
