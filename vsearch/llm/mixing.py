"""Problem 7: mix sources to target weights by systematic sampling.

Each document of a source is expected the same number of times e. With the
documents of the source in a row and u one random offset, document i is taken
floor(i * e + u) - floor((i - 1) * e + u) times: once for every whole number
that its stretch of the prefix sum crosses.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vsearch.runtime import broadcast_if_small, ship, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the public pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Rows of one stretch of the prefix sum; a source is cut into as many stretches as it needs.
STRETCH_ROWS = 1_000_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A text is encoded in blocks of about this many characters, cut before a space that follows a letter, where no token can span.
BLOCK_CHARS = 20_000


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    enc, n, at = _encoding(path), 0, 0
    while len(text) - at > BLOCK_CHARS:
        cut = text.find(" ", at + BLOCK_CHARS)
        while cut > 0 and not (text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        n += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return n + len(enc.encode_ordinary(text[at:]))


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [count_tokens(t, path) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["id", "source", "n_tokens"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, source, n_tokens) of every document with an id, a source and a text that isn't blank. Source names are lower-cased and stripped."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.trim(source_col)).alias("source"), F.col(text_col).alias("text")).filter(
        F.col("id").isNotNull() & F.col("source").isNotNull() & F.col("text").rlike(r"\S")
    )
    return rows.mapInArrow(lambda it: _count(it, path), "id long, source string, n_tokens long")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 42, path: str = VOCABULARY, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(selection, report) for every plan in ``targets`` (plan_id, source, target_weight, max_repeats, total_tokens).

    ``selection``: (plan_id, id, source, copies, n_tokens) of the documents to
    take, copies >= 1. ``report``: for every row of ``targets`` its target
    share and tokens, the source's size, and the actual tokens and share.

    Weights count relative to the plan's sum; null or negative ones are 0. A
    source too small for its share is taken max_repeats times and no more, and
    its plan falls short of the total. A source without documents, or a plan of
    weight 0, gives a report row of 0 tokens; documents of sources without a
    target, with a null source or a blank text aren't taken. A source named
    twice in a plan, apart from case and blanks, has the sum of its weights and
    the least of its max_repeats. Repeated doc_ids are documents of their own.

    A source is numbered in stretches of hashed ids, so one that holds most
    documents is spread over tasks; only the stretches' counts are summed up.
    """
    plan = Window.partitionBy("plan_id")
    wanted = (
        targets.select("plan_id", F.lower(F.trim("source")).alias("source"), F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("w"), "max_repeats", "total_tokens")
        .groupBy("plan_id", "source")
        .agg(F.sum("w").alias("w"), F.min("max_repeats").alias("max_repeats"), F.max("total_tokens").alias("total_tokens"))
        .withColumn("target_share", F.when(F.sum("w").over(plan) > 0, F.col("w") / F.sum("w").over(plan)).otherwise(0.0))
        .withColumn("target_tokens", F.col("target_share") * F.col("total_tokens"))
    )
    wanted = stage(wanted, "targets")
    sources = broadcast_if_small(wanted.select("source").distinct())
    sizes = token_counts(docs, path=path, **columns)
    sizes = stage(sizes.join(sources, "source", "left_semi"), "token-counts")
    stretches = max(8, -(-sizes.count() // STRETCH_ROWS))
    sizes = sizes.withColumn("stretch", F.pmod(F.xxhash64("id"), F.lit(stretches)))

    per = stage(sizes.groupBy("source", "stretch").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")), "stretches")
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("source", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    totals = per.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum("tokens").alias("source_tokens"))
    rates = wanted.join(totals, "source", "left").withColumn(
        "expected", F.when(F.col("source_tokens") > 0, F.least(F.col("target_tokens") / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    )
    offset = F.pmod(F.xxhash64(F.lit(seed), "plan_id", "source"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rates = stage(rates.withColumn("u", offset), "rates")

    place = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("id", "n_tokens"))
    placed = sizes.withColumn("nth", place).join(broadcast_if_small(offsets), ["source", "stretch"]).withColumn("nth", F.col("nth") + F.col("before"))
    rate = rates.filter("expected > 0").select("plan_id", "source", "expected", "u")
    crossed = F.floor(F.col("nth") * F.col("expected") + F.col("u")) - F.floor((F.col("nth") - 1) * F.col("expected") + F.col("u"))
    selection = stage(
        placed.join(broadcast_if_small(rate), "source").select("plan_id", "id", "source", crossed.cast("int").alias("copies"), "n_tokens").filter("copies > 0"), "selection"
    )
    taken = selection.groupBy("plan_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("actual_tokens"), F.max("copies").alias("most_copies"))
    whole = F.sum("actual_tokens").over(plan)
    report = (
        rates.join(taken, ["plan_id", "source"], "left")
        .withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
        .select(
            "plan_id", "source", "target_share", "target_tokens", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), "max_repeats", "expected",
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "actual_tokens", F.when(whole > 0, F.col("actual_tokens") / whole).otherwise(0.0).alias("actual_share"),
        )
    )
    return selection, report
