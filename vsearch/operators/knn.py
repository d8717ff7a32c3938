"""Exact nearest neighbours, for one query vector or a table of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vsearch.functions import vector as V
from vsearch.runtime import ship
from vsearch.types import RequestError, VectorError

#: Query vectors sent to the executors at once; larger query tables are worked through in blocks of this size.
BLOCK_QUERIES = 4096


def check_metric(metric: str) -> None:
    if metric not in V.METRICS:
        raise VectorError(f"metric must be one of {V.METRICS}")


def check_k(top_k: int) -> None:
    if not isinstance(top_k, int) or top_k < 1:
        raise RequestError("top_k must be a whole number of at least 1")


def knn(
    docs: DataFrame, query: Sequence[float], top_k: int = 5, metric: str = "cosine", mask: Column | None = None, id_col: str = "doc_id", vector_col: str = "vector", slot_col: str = "slot"
) -> DataFrame:
    """(id, slot, score, rank) of the top_k rows: cosine descending or L2 ascending, ties by slot.

    ``mask`` restricts the candidates before scoring. Rows without a vector, or
    with one of another length than the query, or whose score isn't a finite
    number, are no candidates; an empty table or a mask that fits nothing gives
    no rows. Scores are not rounded.
    """
    check_metric(metric)
    check_k(top_k)
    if not len(query):
        raise VectorError("the query vector is empty")
    rows = docs if mask is None else docs.filter(mask)
    q = V.vector_literal(query)
    v = F.col(vector_col)
    score = V.cosine(v, q, norm_b=F.lit(float(np.linalg.norm(np.asarray(query, np.float64))))) if metric == "cosine" else V.l2(v, q)
    best = F.desc("score") if metric == "cosine" else F.asc("score")
    top = rows.filter(F.size(v) == len(query)).select(F.col(id_col).alias("id"), F.col(slot_col).alias("slot"), score.alias("score")).filter(_finite(F.col("score"))).orderBy(best, "slot").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(best, "slot")))


def _finite(score: Column) -> Column:
    return F.abs(score) < F.lit(float("inf"))


class TopK:
    """Running best ``k`` slots of each query, by score descending and slot."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), -np.inf)
        self.slots = np.full((queries, k), np.iinfo(np.int64).max)

    def merge(self, rows: np.ndarray, slots: np.ndarray, scores: np.ndarray) -> None:
        """Offer ``slots`` to the queries ``rows``; those whose score isn't finite are no candidates."""
        self.offer(rows, np.broadcast_to(slots, scores.shape), scores)

    def offer(self, rows: np.ndarray, slots: np.ndarray, scores: np.ndarray) -> None:
        """As :meth:`merge`, with slots of its own for each query."""
        scores = np.where(np.isfinite(scores), scores, -np.inf)
        k = self.scores.shape[1]
        s = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.slots[rows], slots], axis=1)
        key = np.round(s, 12)
        if s.shape[1] > 4 * k + 64:  # first drop what is surely below the k-th; its ties stay
            least = np.partition(key, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            width = max(int((key >= least[:, None]).sum(axis=1).max()), k)
            if width < s.shape[1] // 2:
                part = np.argpartition(-key, width - 1, axis=1)[:, :width]
                s, ids, key = (np.take_along_axis(x, part, 1) for x in (s, ids, key))
        order = np.lexsort((ids, -key), axis=1)[:, :k]
        self.scores[rows], self.slots[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)

    def batch(self, metric: str) -> pa.RecordBatch:
        q, at = np.nonzero(self.scores != -np.inf)
        value = self.scores[q, at] if metric == "cosine" else -self.scores[q, at]
        return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(self.slots[q, at]), pa.array(value)], names=["q", "slot", "score"])


def vectors_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the vectors of ``dim`` elements."""
    right = np.flatnonzero(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dim)
    x = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return right, x.reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of zeros stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n != 0)


def scored(queries: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores to be maximised: cosines, or negative distances."""
    if metric == "cosine":
        return unit(queries) @ unit(x).T
    return -np.stack([np.sqrt(((x - q) ** 2).sum(axis=1)) for q in queries])


def _blocks(
    batches: Iterator[pa.RecordBatch], queries: np.ndarray, k: np.ndarray, metric: str, groups: np.ndarray | None, names: pa.Array | None, flags: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """Running top k of every query over a partition, then one batch of results. ``groups`` are places in ``names``."""
    best, everyone = TopK(len(queries), int(k.max())), np.arange(len(queries))
    for batch in batches:
        right, x = vectors_of(batch.column(1), queries.shape[1])
        if not len(right):
            continue
        slots = batch.column(0).to_numpy()[right]
        fits = None if flags is None else np.array(batch.column(batch.num_columns - 1).take(pa.array(right)).to_pylist(), bool).reshape(len(right), -1)
        if groups is None:
            meetings = [(everyone, np.arange(len(right)))]
        else:  # a row is scored for the queries of its group only
            at = pc.index_in(batch.column(2).take(pa.array(right)), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            runs = np.split(order, np.flatnonzero(np.diff(at[order])) + 1)
            meetings = [(np.flatnonzero(groups == at[r[0]]), r) for r in runs if at[r[0]] >= 0]
        for q, r in meetings:
            s = scored(queries[q], x[r], metric)
            if fits is not None:
                s[~fits[r][:, flags[q]].T] = -np.inf
            best.merge(q, slots[r], s)
    yield best.batch(metric)


def knn_batch(
    docs: DataFrame, queries: DataFrame, top_k: int = 5, metric: str = "cosine", mask: Column | None = None, vector_col: str = "vector", slot_col: str = "slot",
    query_id: str = "query_id", query_vector: str = "query_vector", query_k: str | None = None, group_col: str | None = None, query_group: str | None = None,
    flags_col: str | None = None, query_flag: str | None = None,
) -> DataFrame:
    """(query_id, slot, score, rank): the top k rows for every query, as :func:`knn` gives them one by one.

    ``query_k`` names a column of ``queries`` with each query's own k;
    ``group_col``/``query_group`` restrict a query to the rows of its group.
    ``flags_col``, an array of booleans, and ``query_flag``, a place in it,
    restrict a query to the rows that have its flag: many filters in one scan.
    Queries without a vector get no rows; all others must have one length.
    Queries go to the executors in blocks of BLOCK_QUERIES; each partition
    returns at most k rows a query, so what is shuffled doesn't grow with docs.
    """
    check_metric(metric)
    check_k(top_k)
    rows = docs if mask is None else docs.filter(mask)
    k_col = F.col(query_k).cast("int") if query_k else F.lit(top_k)
    group = F.col(query_group) if query_group else F.lit(None).cast("string")
    flag = F.col(query_flag).cast("int") if query_flag else F.lit(0)
    asked = queries.filter(F.size(query_vector) > 0).select(
        F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v"), k_col.alias("k"), group.alias("g"), flag.alias("f")
    )
    n = asked.count()
    blocks = max(1, -(-n // BLOCK_QUERIES))
    cols = [F.col(slot_col).cast("long"), F.col(vector_col)] + ([F.col(group_col).cast("string")] if group_col else []) + ([F.col(flags_col)] if flags_col else [])
    spark = docs.sparkSession
    ship(spark)
    out = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow()
        if not block.num_rows:
            continue
        lengths = {len(v) for v in block["v"].to_pylist()}
        if len(lengths) != 1:
            raise VectorError("query vectors differ in length")
        q = np.array(block["v"].to_pylist(), np.float64)
        k = block["k"].to_numpy()
        coded = block["g"].combine_chunks().dictionary_encode() if group_col else None  # a null group is -1, which no row has
        g = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False) if group_col else None
        known = coded.dictionary if group_col else None
        f = block["f"].to_numpy() if flags_col else None
        names = spark.createDataFrame(pa.table({"q": pa.array(range(len(q)), pa.int32()), "query_id": block["query_id"], "k": pa.array(k, pa.int32())}))
        near = rows.select(*cols).mapInArrow(lambda it, q=q, k=k, g=g, known=known, f=f: _blocks(it, q, k, metric, g, known, f), "q int, slot long, score double")
        one = near.join(F.broadcast(names), "q").drop("q")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = asked.select("query_id", F.lit(0).cast("long").alias("slot"), F.lit(0.0).alias("score"), "k").limit(0)
    best = F.round("score", 12)
    w = Window.partitionBy("query_id").orderBy(best.desc() if metric == "cosine" else best.asc(), "slot")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("k")).drop("k")


def knn_batch_native(docs: DataFrame, queries: DataFrame, top_k: int = 5, metric: str = "cosine", mask: Column | None = None) -> DataFrame:
    """As :func:`knn_batch`, wholly in the JVM: for small query tables and as its cross-check."""
    check_metric(metric)
    check_k(top_k)
    rows = docs if mask is None else docs.filter(mask)
    a, b = F.col("vector"), F.col("query_vector")
    rows = rows.select("slot", "vector", V.norm(a).alias("_n"))
    asked = queries.select("query_id", "query_vector", V.norm(b).alias("_m"))
    if asked.limit(BLOCK_QUERIES + 1).count() > BLOCK_QUERIES:
        raise RequestError(f"at most {BLOCK_QUERIES} queries")
    score = V.cosine(a, b, F.col("_n"), F.col("_m")) if metric == "cosine" else V.l2(a, b)
    best = F.round("score", 12)
    w = Window.partitionBy("query_id").orderBy(best.desc() if metric == "cosine" else best.asc(), "slot")
    scored = rows.join(F.broadcast(asked), F.size("vector") == F.size("query_vector")).select("query_id", "slot", score.alias("score")).filter(_finite(F.col("score")))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
