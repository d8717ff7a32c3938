"""Weighted reciprocal-rank fusion of a dense and a sparse ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vsearch.runtime import broadcast_if_small
from vsearch.types import RequestError

RANK_OFFSET = 60.0


def candidate_depth(top_k):
    """How deep both rankings are read: three times top_k, at least 20. For an int or a Column."""
    return F.greatest(top_k * 3, F.lit(20)) if isinstance(top_k, Column) else max(3 * top_k, 20)


def check_alpha(alpha: float) -> None:
    if not 0 <= alpha <= 1:
        raise RequestError("alpha must be from 0 to 1")


def rrf(dense: DataFrame, sparse: DataFrame, alpha: float | Column, top_k: int | Column, params: DataFrame | None = None) -> DataFrame:
    """(query_id, slot, score, rank) from two rankings (query_id, slot, rank).

    A document in one ranking only gets nothing from the other. Ties go to the
    better dense rank, then to the better sparse rank. ``params``, one row a
    query_id, may carry the columns that ``alpha`` and ``top_k`` refer to.
    """
    if not isinstance(alpha, Column):
        check_alpha(alpha)
        alpha = F.lit(float(alpha))
    both = dense.select("query_id", "slot", F.col("rank").alias("dense_rank")).join(
        sparse.select("query_id", "slot", F.col("rank").alias("sparse_rank")), ["query_id", "slot"], "full"
    )
    if params is not None:
        both = both.join(broadcast_if_small(params), "query_id")
    leg = lambda w, r: F.coalesce(w / (RANK_OFFSET + F.col(r)), F.lit(0.0))
    fused = both.withColumn("score", leg(alpha, "dense_rank") + leg(1 - alpha, "sparse_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last())
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select("query_id", "slot", "score", "rank")
