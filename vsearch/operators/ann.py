"""Approximate search: vectors in cells by their nearest centroid, of which a query looks into the nearest few."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vsearch.functions.vector import norm
from vsearch.operators.knn import BLOCK_QUERIES, TopK, check_k, check_metric, knn, scored, unit, vectors_of
from vsearch.runtime import ship, stage
from vsearch.types import VectorError

#: Centroids are fitted on at most this many vectors, those of least hash; every vector is put into a cell.
FIT_ROWS = 50_000
#: Fewer eligible rows than this are searched exactly, unless told otherwise.
EXACT_ROWS = 1_000
#: Tasks that may write a cell, so that a large one isn't one task's work.
SPREAD = 16
#: Cells, unless their number is given: the square root of the rows, from and up to these.
LEAST_CELLS, MOST_CELLS = 16, 4_096


@dataclass
class CellIndex:
    """``rows`` are the documents with their ``cell``; ``version`` names the snapshot they come from."""

    rows: DataFrame
    centroids: np.ndarray
    metric: str
    version: str | None = None

    def __len__(self) -> int:
        return self.rows.count()

    def probes(self, query: Sequence[float], nprobe: int) -> list[int]:
        q = _prepared(np.asarray([query], np.float64), self.metric)
        d = ((self.centroids - q) ** 2).sum(axis=1)
        return [int(i) for i in np.argsort(d, kind="stable")[:nprobe]]


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    return x if metric == "l2" else unit(x)


def _kmeans(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        home = _nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(home, minlength=len(c))[:, None]
        np.add.at(sums, home, x)
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(axis=1) / 2
    return np.concatenate([(x[a : a + 8192] @ c.T - half).argmax(axis=1) for a in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, metric: str) -> Iterator[pa.RecordBatch]:
    dim = centroids.shape[1]
    for batch in batches:
        v = batch.column(batch.schema.get_field_index("vector"))
        right = np.flatnonzero(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dim)
        x = v.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        cells = np.full(batch.num_rows, -1, np.int32)  # rows without a usable vector
        cells[right] = _nearest(_prepared(np.nan_to_num(x), metric), centroids)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])


def build_cells(docs: DataFrame, cells: int | None = None, metric: str = "cosine", version: str | None = None, path: str | None = None) -> CellIndex:
    """Index over (slot, vector, ...). With ``path`` it is written there, partitioned by cell, so that a search reads only its cells' files.

    The dimension is that of most vectors of the sample; those of another
    length are in cell -1. Without ``cells`` their number follows the rows'.
    """
    check_metric(metric)
    ship(docs.sparkSession)
    if cells is not None and cells < 1:
        raise VectorError("cells must be at least 1")
    if cells is None:
        cells = int(min(MOST_CELLS, max(LEAST_CELLS, docs.count() ** 0.5)))
    sample = docs.filter(F.size("vector") > 0).orderBy(F.xxhash64("slot"), "slot").limit(FIT_ROWS).select("vector").toArrow()["vector"].combine_chunks()
    if not len(sample):
        raise VectorError("no vectors to index")
    lengths, counts = np.unique(sample.value_lengths().to_numpy(zero_copy_only=False), return_counts=True)
    _, x = vectors_of(sample, int(lengths[counts.argmax()]))
    x = x[np.isfinite(x).all(axis=1)]
    centroids = _kmeans(_prepared(x, metric), min(cells, len(x)))
    schema = T.StructType([*docs.schema.fields, T.StructField("cell", T.IntegerType())])
    rows = docs.mapInArrow(lambda it: _assign(it, centroids, metric), schema)
    if path:
        rows.repartition("cell", F.pmod(F.xxhash64("slot"), F.lit(SPREAD))).write.mode("overwrite").partitionBy("cell").parquet(path)
        rows = docs.sparkSession.read.schema(schema).parquet(path)
    else:
        rows = stage(rows, "cells")
    return CellIndex(rows, centroids, metric, version)


def cell_search(index: CellIndex, query: Sequence[float], top_k: int = 5, nprobe: int = 8, mask: Column | None = None, id_col: str = "doc_id", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """As :func:`vsearch.operators.knn.knn`, over the ``nprobe`` nearest cells.

    ``mask`` is applied before the search. If at most ``exact_rows`` rows are
    eligible, or all cells are asked for, the search is exact; 0 turns the first off.
    """
    check_k(top_k)
    eligible = index.rows if mask is None else index.rows.filter(mask)
    if nprobe < len(index.centroids) and (mask is None or eligible.limit(exact_rows + 1).count() > exact_rows):
        eligible = eligible.filter(F.col("cell").isin(index.probes(query, nprobe)))
    return knn(eligible, query, top_k, index.metric, id_col=id_col)


def _cell_blocks(batches: Iterator[pa.RecordBatch], queries: np.ndarray, asking: dict[int, np.ndarray], k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """Running top k over a partition; a row is scored for the queries that ask its cell."""
    best = TopK(len(queries), k)
    for batch in batches:
        right, x = vectors_of(batch.column(1), queries.shape[1])
        slots, cells = batch.column(0).to_numpy()[right], batch.column(2).to_numpy()[right]
        order = np.argsort(cells, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
            q = asking.get(int(cells[rows[0]])) if len(rows) else None
            if q is not None:
                best.merge(q, slots[rows], scored(queries[q], x[rows], metric))
    yield best.batch(metric)


def cell_search_batch(index: CellIndex, queries: DataFrame, top_k: int = 5, nprobe: int = 8) -> DataFrame:
    """(query_id, slot, score, rank) for every query (query_id, query_vector), over its nearest cells.

    Queries without a vector of the index's length get no rows. A document is
    scored only for queries that ask its cell; queries go out in blocks.
    """
    check_k(top_k)
    c, metric, n = index.centroids, index.metric, min(nprobe, len(index.centroids))
    asked = queries.filter(F.size("query_vector") == c.shape[1]).select("query_id", F.col("query_vector").cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    rows = index.rows.filter("cell >= 0").select(F.col("slot").cast("long"), "vector", "cell")
    out = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow()
        if not block.num_rows:
            continue
        q = np.array(block["v"].to_pylist(), np.float64)
        p = _prepared(q, metric)
        probes = np.argsort((c**2).sum(axis=1)[None, :] - 2 * p @ c.T, axis=1, kind="stable")[:, :n]
        asking = {int(cell): np.flatnonzero((probes == cell).any(axis=1)) for cell in np.unique(probes)}
        names = index.rows.sparkSession.createDataFrame(pa.table({"q": pa.array(range(len(q)), pa.int32()), "query_id": block["query_id"]}))
        wanted = rows.filter(F.col("cell").isin(sorted(asking))) if len(asking) < len(c) else rows
        near = wanted.mapInArrow(lambda it, q=q, asking=asking: _cell_blocks(it, q, asking, top_k, metric), "q int, slot long, score double")
        one = near.join(F.broadcast(names), "q").drop("q")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = asked.select("query_id", F.lit(0).cast("long").alias("slot"), F.lit(0.0).alias("score")).limit(0)
    best = F.round("score", 12)
    w = Window.partitionBy("query_id").orderBy(best.desc() if metric == "cosine" else best.asc(), "slot")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def lsh_search(docs: DataFrame, query: Sequence[float], top_k: int = 5, bucket_length: float = 0.5, tables: int = 4, seed: int = 42) -> DataFrame:
    """(slot, distance) by Spark's bucketed random projections on unit vectors."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    q = np.asarray(query, np.float64)
    unit = F.transform("vector", lambda x: x.cast("double") / F.col("_n"))
    rows = docs.filter(F.size("vector") == len(q)).withColumn("_n", norm(F.col("vector"))).filter("_n > 0").select("slot", array_to_vector(unit).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(rows)
    found = model.approxNearestNeighbors(rows, Vectors.dense(q / np.linalg.norm(q)), top_k)
    return found.select("slot", F.col("distCol").alias("distance"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (recall): the share of ``exact`` (query_id, slot) that ``found`` has too."""
    hit = exact.join(found.select("query_id", "slot", F.lit(1).alias("_hit")), ["query_id", "slot"], "left")
    return hit.agg((F.count("_hit") / F.count("*")).alias("recall"))
