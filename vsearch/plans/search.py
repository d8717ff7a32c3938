"""Search plans over a collection: dense, keyword and hybrid, with filters, single and in batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vsearch.functions.filters import compile_filters, parsed
from vsearch.functions.text import blank
from vsearch.operators import ann, graph
from vsearch.operators.fusion import candidate_depth, check_alpha, rrf
from vsearch.operators.knn import check_k, check_metric, knn, knn_batch
from vsearch.operators.lexical import bm25, bm25_batch
from vsearch.runtime import BROADCAST_ROWS
from vsearch.types import RequestError


def check_query(text: str) -> None:
    if not isinstance(text, str) or not text.strip():
        raise RequestError("the query must be a string that isn't blank")


def eligible(filters: Mapping[str, Any] | None) -> Column:
    """Active rows that meet the filters."""
    return F.col("active") & compile_filters(filters, parsed(F.col("metadata"))) if filters else F.col("active")


def _hinted(hits: DataFrame, most: int) -> DataFrame:
    """``hits``, of at most ``most`` rows, to be broadcast if that is few; the bound is known without running the search."""
    return F.broadcast(hits) if most <= BROADCAST_ROWS else hits


def hydrate(hits: DataFrame, docs: DataFrame, most: int, keys: Sequence[str] = ()) -> DataFrame:
    """Ids, texts and metadata of at most ``most`` ranked slots, fetched after the cut to top k; scores to 6 digits."""
    body = docs.filter("active").select("slot", "doc_id", "text", "metadata")
    return body.join(_hinted(hits, most), "slot").select(*keys, "rank", "doc_id", "text", F.round("score", 6).alias("score"), "metadata")


Index = ann.CellIndex | graph.GraphIndex


def nearest(docs: DataFrame, query: Sequence[float], top_k: int, metric: str, mask: Column, index: Index | None, ef: int = graph.EF_SEARCH, nprobe: int = 8) -> DataFrame:
    """The top k by an index, or exactly without one."""
    if isinstance(index, graph.GraphIndex):
        return graph.graph_search(index, docs, query, top_k, ef, mask)
    return ann.cell_search(index, query, top_k, nprobe, mask) if index is not None else knn(docs, query, top_k, metric, mask)


def search(
    docs: DataFrame, query: Sequence[float], top_k: int = 5, filters: Mapping[str, Any] | None = None, metric: str = "cosine", index: Index | None = None, ef: int = graph.EF_SEARCH, nprobe: int = 8
) -> DataFrame:
    """(rank, doc_id, text, score, metadata) of the nearest active documents that meet the filters, which apply before the search."""
    hits = nearest(docs, query, top_k, metric, eligible(filters), index, ef, nprobe)
    return hydrate(hits.drop("id"), docs, top_k).orderBy("rank")


def search_batch(docs: DataFrame, queries: DataFrame, top_k: int = 5, filters: Mapping[str, Any] | None = None, metric: str = "cosine") -> DataFrame:
    """As :func:`search` for every row of ``queries`` (query_id, query_vector), with query_id."""
    return hydrate(knn_batch(docs, queries, top_k, metric, eligible(filters)), docs, top_k * queries.count(), ["query_id"])


def keyword_search(docs: DataFrame, query: str, top_k: int = 5, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """As :func:`search`, by BM25; statistics are those of all active documents."""
    check_query(query)
    allow = docs.filter(eligible(filters)).select("slot") if filters else None
    return hydrate(bm25(docs.filter("active"), query, top_k, allow=allow), docs, top_k).orderBy("rank")


def hybrid_search(
    docs: DataFrame, text: str, vector: Sequence[float], top_k: int = 5, alpha: float = 0.5, filters: Mapping[str, Any] | None = None, metric: str = "cosine", index: Index | None = None,
    ef: int = graph.EF_SEARCH,
) -> DataFrame:
    """Dense and keyword rankings, each to max(3 * top_k, 20), fused; ``alpha`` is the weight of the dense one."""
    check_query(text)
    check_k(top_k)
    check_alpha(alpha)
    mask, depth = eligible(filters), candidate_depth(top_k)
    dense = nearest(docs, vector, depth, metric, mask, index, ef)
    allow = docs.filter(mask).select("slot") if filters else None
    sparse = bm25(docs.filter("active"), text, depth, allow=allow)
    tag = F.lit(0).alias("query_id")
    fused = rrf(dense.select(tag, "slot", "rank"), sparse.select(tag, "slot", "rank"), alpha, top_k)
    return hydrate(fused.drop("query_id"), docs, top_k).orderBy("rank")


def hybrid_batch(docs: DataFrame, queries: DataFrame, filters: Mapping[str, Mapping[str, Any]], metric: str = "cosine") -> DataFrame:
    """Hybrid search for every row of ``queries``: (query_id, query_text, query_vector, coll_name, top_k, alpha, filter_json).

    ``docs`` has ``coll_name`` too: a query searches the active documents of
    its collection, with that collection's keyword statistics. ``filters`` maps
    each filter_json that occurs to its parsed form; one that it lacks is an
    error. Queries with a blank text or an alpha outside 0..1 aren't answered.
    Returns (query_id, rank, doc_id, score).

    Each document is tested against every filter once, as an array of flags,
    so the documents are scanned once for the dense search and once for the
    keyword search, whatever the number of queries and filters.
    """
    check_metric(metric)
    place = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in filters]), F.col("filter_json")) if filters else F.lit(0), F.lit(0)).cast("int")
    asked = queries.filter(~blank(F.col("query_text")) & F.col("alpha").between(0, 1) & (F.col("top_k") >= 1))
    lacking = asked.filter(F.col("filter_json").isNotNull() & ~F.col("filter_json").isin(list(filters))).select("query_id").first()
    if lacking:
        raise RequestError(f"the filter of query {lacking[0]} isn't among those given")
    asked = asked.withColumns({"depth": candidate_depth(F.col("top_k")), "flag": place})
    meta = parsed(F.col("metadata"))
    live = docs.filter("active").withColumn("flags", F.array(F.lit(True), *[compile_filters(f, meta) for f in filters.values()]))
    dense = knn_batch(live, asked, metric=metric, query_k="depth", group_col="coll_name", query_group="coll_name", flags_col="flags", query_flag="flag").select("query_id", "slot", "rank")
    sparse = bm25_batch(live, asked, group="coll_name", query_k="depth", flags="flags", query_flag="flag").select("query_id", "slot", "rank")
    params = asked.select("query_id", "alpha", F.col("top_k").alias("k"))
    fused = rrf(dense, sparse, F.col("alpha"), F.col("k"), params)
    most = asked.agg(F.coalesce(F.sum("top_k"), F.lit(0))).first()[0]
    return docs.select("slot", "doc_id").join(_hinted(fused, most), "slot").select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))
