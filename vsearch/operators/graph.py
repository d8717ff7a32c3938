"""Approximate search by layered neighbour graphs (Malkov and Yashunin, 2016), one for each shard of a collection.

A sample of a layer's nodes, one in ``m``, makes the layer above it. A search
descends from the small layers to the one that holds all nodes, where a beam
of candidates follows the edges. Blocks of queries, or of new nodes, take each
step together, as NumPy arrays.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vsearch.operators.knn import BLOCK_QUERIES, TopK, check_k, check_metric, scored, unit, vectors_of
from vsearch.runtime import ship, stage
from vsearch.types import VectorError

#: Edges a node has in the layers above; twice as many in the lowest one.
M = 16
EF_CONSTRUCTION = 100
EF_SEARCH = 50
#: Vectors of a shard, on average. All shards answer a query; each is one task's work.
SHARD_ROWS = 50_000
#: A layer of no more nodes is searched whole: at that size a matrix product is faster than steps along edges.
TOP_NODES = 512
#: Candidates opened at each step of a beam search, and queries that take their steps together.
OPEN = 4
BLOCK = 256
#: A mask that leaves a smaller share of a shard makes the search there exact, over what it leaves.
EXACT_SHARE = 0.1


class BeamGraph:
    """Directed graph over the rows of ``x``; node ``n`` is none. The score of a node is q.x less ``half``, half the square of its length, or q.x where all have length 1."""

    def __init__(self, x: np.ndarray, degree: int, half: np.ndarray | None = None):
        self.n, self.degree = len(x), degree
        self.x = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
        self.half = None if half is None else np.append(half, 0).astype(np.float32)
        self.edges = np.full((self.n + 1, degree), self.n, np.int32)
        self.filled = np.zeros(self.n + 1, np.int32)

    def scores(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Of a row of nodes for each query."""
        near = np.matmul(self.x[nodes], q[:, :, None])[:, :, 0]
        return near if self.half is None else near - self.half[nodes]

    def closeness(self, nodes: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Minus half the square of the distance, from the scores of others for ``nodes``."""
        return scores - 1 if self.half is None else scores - self.half[nodes][:, None]

    def beam(self, q: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores, best first, of the ``width`` nodes found from ``starts`` (a row of different nodes, or none, for each query)."""
        b, steps = len(q), OPEN * self.degree
        k = starts.shape[1]
        ids = np.full((b, max(width, k)), self.n, np.int32)
        sims = np.full(ids.shape, -np.inf, np.float32)
        ids[:, :k], sims[:, :k] = starts, self.scores(q, starts)
        sims[ids == self.n] = -np.inf
        by = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        seen = np.full((b, self.n + 1), -1, np.int16)
        seen[:, self.n] = 0
        np.put_along_axis(seen, starts.astype(np.int64), np.int16(0), 1)
        waiting = ids != self.n
        out_ids, out_sims = ids, sims
        live, rows = np.arange(b), np.arange(b)[:, None]
        places = np.arange(steps, dtype=np.int16)
        while len(live):
            order = np.argsort(~waiting, axis=1, kind="stable")[:, :OPEN]
            chosen = np.where(np.take_along_axis(waiting, order, 1), np.take_along_axis(ids, order, 1), self.n)
            np.put_along_axis(waiting, order, False, 1)
            cand = self.edges[chosen].reshape(len(live), -1)
            fresh = seen[rows, cand] < 0
            seen[rows, cand] = np.maximum(seen[rows, cand], places[: cand.shape[1]])
            fresh &= seen[rows, cand] == places[: cand.shape[1]]  # of a node proposed twice, one stays
            near = self.scores(q, cand)
            near[~fresh] = -np.inf
            every = np.concatenate([sims, near], axis=1)
            best = np.argpartition(-every, width - 1, axis=1)[:, :width]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(every, best, 1), axis=1), 1)
            sims = np.take_along_axis(every, best, 1)
            ids = np.take_along_axis(np.concatenate([ids, np.where(fresh, cand, self.n)], axis=1), best, 1)
            waiting = np.take_along_axis(np.concatenate([waiting, fresh], axis=1), best, 1)
            on = waiting.any(axis=1)
            if not on.all():
                out_ids[live[~on]], out_sims[live[~on]] = ids[~on], sims[~on]
                live, ids, sims, waiting, q, seen = live[on], ids[on], sims[on], waiting[on], q[on], seen[on]
                rows = np.arange(len(live))[:, None]
        return out_ids, out_sims

    def select(self, cand: np.ndarray, sims: np.ndarray, relax: float = 1.0) -> np.ndarray:
        """Of candidates, best first, those to keep as a node's edges, nodes before empty places.

        One is kept if it is nearer to the node than, by ``relax`` times the
        square of the distance, to any kept before; free places are filled with
        the nearest of the others. ``sims`` is their :meth:`closeness`.
        """
        v = self.x[cand]
        between = np.matmul(v, v.transpose(0, 2, 1))
        lengths = 1 if self.half is None else self.half[cand][:, :, None] + self.half[cand][:, None, :]
        between = relax * (lengths - between)
        alive = cand != self.n
        rest = alive.copy()
        out = np.full((len(cand), self.degree), self.n, np.int32)
        rows = np.arange(len(cand))
        for r in range(self.degree):
            j = alive.argmax(axis=1)
            has = alive[rows, j]
            if not has.any():
                alive, between = rest.copy(), np.full_like(between, np.inf)
                j = alive.argmax(axis=1)
                has = alive[rows, j]
                if not has.any():
                    break
            out[has, r] = cand[rows, j][has]
            rest[rows[has], j[has]] = False
            alive[rows, j] = False
            alive &= between[rows, j] > -sims
        return np.take_along_axis(out, np.argsort(out == self.n, axis=1, kind="stable"), 1)

    def link(self, nodes: np.ndarray, kept: np.ndarray, relax: float = 1.0) -> None:
        """Give new nodes the edges ``kept``, and their ends edges back; an end with too many selects anew."""
        self.edges[nodes] = kept
        self.filled[nodes] = (kept != self.n).sum(axis=1)
        to, back = kept.ravel(), np.repeat(nodes, self.degree)
        back, to = back[to != self.n], to[to != self.n]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        at, start, count = np.unique(to, return_index=True, return_counts=True)
        nth = np.arange(len(to)) - np.repeat(start, count)
        full = self.filled[at] + count > self.degree
        fits = np.repeat(~full, count)
        self.edges[to[fits], self.filled[to[fits]] + nth[fits]] = back[fits]
        self.filled[at[~full]] += count[~full].astype(np.int32)
        if full.any():
            # of very many, the nearest ones are the candidates
            for s, c in zip(start[full & (count > 2 * self.degree)], count[full & (count > 2 * self.degree)]):
                some = back[s : s + c]
                back[s : s + c] = some[np.argsort(-self.scores(self.x[to[s]][None], some[None])[0], kind="stable")]
            ends, count, start = at[full], np.minimum(count[full], 2 * self.degree), start[full]
            more = np.full((len(ends), count.max()), self.n, np.int32)
            col = np.arange(count.max())[None, :]
            inside = col < count[:, None]
            more[inside] = back[(start[:, None] + col)[inside]]
            cand = np.concatenate([self.edges[ends], more], axis=1)
            sims = self.closeness(ends, self.scores(self.x[ends], cand))
            sims[cand == self.n] = -np.inf
            by = np.argsort(-sims, axis=1)
            self.edges[ends] = self.select(np.take_along_axis(cand, by, 1), np.take_along_axis(sims, by, 1), relax)
            self.filled[ends] = (self.edges[ends] != self.n).sum(axis=1)


class LayeredGraph(BeamGraph):
    """The graph of a layer and, above it, that of a sample of its nodes."""

    def __init__(self, x: np.ndarray, m: int = M, ef_construction: int = EF_CONSTRUCTION, half: np.ndarray | None = None, seed: int = 42, lowest: bool = True):
        super().__init__(x, min(2 * m if lowest else m, max(1, len(x) - 1)), half)
        self.upper, self.above = None, np.zeros(0, np.int64)
        if self.n <= TOP_NODES:
            return
        # a node is in the next layer with a chance of 1/m, so its level has the usual geometric distribution
        rng = np.random.default_rng(seed)
        self.above = np.flatnonzero(rng.random(self.n) < 1 / m)
        if not len(self.above):
            self.above = np.array([0])
        self.upper = LayeredGraph(x[self.above], m, ef_construction, None if half is None else half[self.above], seed + 1, False)
        rest = np.setdiff1d(np.arange(self.n), self.above)
        order = np.concatenate([self.above, rng.permutation(rest)]).astype(np.int32)
        done = 1
        while done < self.n:
            nodes = order[done : done + min(done, BLOCK)]
            ids, sims = self.beam(self.x[nodes], self._entries(self.x[nodes], done), ef_construction)
            self.link(nodes, self.select(ids, self.closeness(nodes, sims)))
            done += len(nodes)

    def _entries(self, q: np.ndarray, inserted: int | None = None) -> np.ndarray:
        """Where to enter this layer: what the ones above find; of these only the first ``inserted`` may be there yet."""
        ids, _ = self.upper.search(q, OPEN)
        own = np.append(self.above, self.n)[ids].astype(np.int32)
        if inserted is not None and inserted < len(self.above):
            here = np.zeros(self.n + 1, bool)
            here[self.above[:inserted]] = True
            own = np.where(here[own], own, self.n)
            own[~here[own].any(axis=1), 0] = self.above[0]
        return own

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores, best first, of the ``width`` nodes found for each row of ``q``; id n is no node."""
        ids = np.full((len(q), width), self.n, np.int32)
        sims = np.full((len(q), width), -np.inf, np.float32)
        for a in range(0, len(q), BLOCK):
            part = q[a : a + BLOCK]
            if self.upper is None:
                near = part @ self.x[: self.n].T - (0 if self.half is None else self.half[: self.n])
                best = np.argsort(-near, axis=1, kind="stable")[:, :width]
                ids[a : a + BLOCK, : best.shape[1]], sims[a : a + BLOCK, : best.shape[1]] = best, np.take_along_axis(near, best, 1)
            else:
                ids[a : a + BLOCK], sims[a : a + BLOCK] = self.beam(part, self._entries(part), width)
        return ids, sims

    def levels(self) -> list[int]:
        """Nodes of each layer, the lowest first."""
        return [self.n] + (self.upper.levels() if self.upper else [])


@dataclass
class GraphIndex:
    """``rows``: (shard, n, graph), the shards; a vector is in exactly one. ``version`` names the snapshot they come from."""

    rows: DataFrame
    metric: str
    dimension: int
    shards: int
    version: str | None = None

    def __len__(self) -> int:
        """Vectors in the graphs."""
        return self.rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def __repr__(self) -> str:
        return f"GraphIndex(metric={self.metric!r}, dimension={self.dimension}, shards={self.shards})"


def _metric_of(x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Vectors as the graph compares them, and half their squares."""
    if metric == "cosine":
        return unit(x.astype(np.float64)).astype(np.float32), None
    return x.astype(np.float32), ((x.astype(np.float64) ** 2).sum(axis=1) / 2).astype(np.float32)


def build_graph(
    docs: DataFrame, metric: str = "cosine", m: int = M, ef_construction: int = EF_CONSTRUCTION, shard_rows: int = SHARD_ROWS, version: str | None = None, slot_col: str = "slot", vector_col: str = "vector"
) -> GraphIndex:
    """Index over (slot, vector): hashed shards of about ``shard_rows`` vectors, each with its graph, built by one task and written once.

    The dimension is that of most vectors; those of another length, null ones
    and those with elements that aren't finite are in no graph.
    """
    check_metric(metric)
    if m < 2 or ef_construction < m:
        raise VectorError("m must be at least 2 and ef_construction at least m")
    ship(docs.sparkSession)
    rows = docs.filter(F.size(vector_col) > 0).select(F.col(slot_col).cast("long").alias("slot"), F.col(vector_col).cast("array<float>").alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        raise VectorError("no vectors to index")
    dim, shards = sizes["d"], max(1, -(-sizes["count"] // shard_rows))

    def build(t: pa.Table) -> pa.Table:
        right, x = vectors_of(t["vector"].combine_chunks(), dim)
        whole = np.isfinite(x).all(axis=1)
        slots, x = t["slot"].to_numpy()[right[whole]], x[whole]
        order = np.argsort(slots, kind="stable")
        slots, x = slots[order], x[order].astype(np.float32)
        g, half = _metric_of(x, metric)
        body = pickle.dumps((slots, x, LayeredGraph(g, m, ef_construction, half) if len(x) else None), protocol=5)
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int32()), "n": pa.array([len(slots)], pa.int64()), "graph": pa.array([body], pa.binary())})

    cut = rows.filter(F.size("vector") == dim).withColumn("shard", F.pmod(F.xxhash64("slot"), F.lit(shards)).cast("int"))
    made = cut.repartition(shards, "shard").groupBy("shard").applyInArrow(build, "shard int, n long, graph binary")
    return GraphIndex(stage(made, "graph"), metric, dim, shards, version)


def _exactly(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores to be maximised of each query's own rows (b, w, d), in doubles."""
    x = x.astype(np.float64)
    if metric == "l2":
        return -np.sqrt(((x - q[:, None, :]) ** 2).sum(axis=2))
    lengths = np.linalg.norm(x, axis=2) * np.linalg.norm(q, axis=1)[:, None]
    return np.divide(np.einsum("bwd,bd->bw", x, q), lengths, out=np.zeros(lengths.shape), where=lengths != 0)


def _offer(best: TopK, at: np.ndarray, body: bytes, q: np.ndarray, k: int, ef: int, metric: str, allowed: np.ndarray | None = None) -> None:
    """Offer a shard's best for the queries ``at`` of ``q``, with exact scores."""
    slots, x, graph = pickle.loads(body)
    if graph is None:
        return
    exact = at[:0]
    fits = None if allowed is None else np.isin(slots, allowed)
    few = fits is not None and (fits.mean() < EXACT_SHARE or fits.sum() <= k)
    if few:
        exact = at
    else:
        wide = max(ef, 2 * k) if fits is None else int(np.ceil(max(ef, 2 * k) / fits.mean()))
        for a in range(0, len(at), BLOCK):
            some = at[a : a + BLOCK]
            found, _ = graph.search(_metric_of(q[some], metric)[0], min(wide, graph.n))
            if fits is not None:
                found = np.where(np.append(fits, False)[found], found, graph.n)
                found = np.take_along_axis(found, np.argsort(found == graph.n, axis=1, kind="stable"), 1)
                exact = np.append(exact, some[(found != graph.n).sum(axis=1) < min(k, int(fits.sum()))])
            found = found[:, : 2 * k + 16]  # the graph's scores are exact but for rounding
            scores = _exactly(q[some], np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])[found], metric)
            best.offer(some, np.append(slots, np.iinfo(np.int64).max)[found], np.where(found == graph.n, -np.inf, scores))
    if len(exact):  # little is left by the mask, or too few of a beam: all that it leaves
        left = np.flatnonzero(fits)
        for a in range(0, len(exact), BLOCK):
            some = exact[a : a + BLOCK]
            scores = scored(q[some], x[left].astype(np.float64), metric)
            if not few:
                for i, known in enumerate(best.slots[some]):  # what the beam has offered
                    scores[i, np.isin(slots[left], known)] = -np.inf
            best.merge(some, slots[left], scores)


def _ask(batches: Iterator[pa.RecordBatch], q: np.ndarray, k: int, ef: int, metric: str) -> Iterator[pa.RecordBatch]:
    best = TopK(len(q), k)
    for batch in batches:
        for body, part, parts in zip(*(c.to_pylist() for c in batch.columns)):
            _offer(best, np.arange(part, len(q), parts), body, q, k, ef, metric)
    yield best.batch(metric)


def _masked(q: np.ndarray, k: int, ef: int, metric: str):
    def run(graphs: pa.Table, left: pa.Table) -> pa.Table:
        best = TopK(len(q), k)
        for body in graphs["graph"]:
            _offer(best, np.arange(len(q)), body.as_py(), q, k, ef, metric, left["slot"].to_numpy())
        return pa.Table.from_batches([best.batch(metric)])

    return run


def graph_search_batch(index: GraphIndex, queries: DataFrame, top_k: int = 5, ef: int = EF_SEARCH, mask: DataFrame | None = None) -> DataFrame:
    """(query_id, slot, score, rank) for every query (query_id, query_vector), as :func:`vsearch.operators.knn.knn_batch`.

    Every shard answers every query with a beam of max(ef, 2 * top_k). ``mask``,
    (slot), is what may be found: a shard of which it leaves little is searched
    exactly, and so are queries for which too few of a beam are left. Queries
    without a vector of the index's length get no rows; queries go out in blocks.
    """
    check_k(top_k)
    if ef < 1:
        raise VectorError("ef must be at least 1")
    spark, metric = index.rows.sparkSession, index.metric
    asked = queries.filter(F.size("query_vector") == index.dimension).select("query_id", F.col("query_vector").cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    shards = index.rows
    if mask is not None:
        slots = mask.select(F.col("slot").cast("long").alias("slot")).withColumn("shard", F.pmod(F.xxhash64("slot"), F.lit(index.shards)).cast("int"))
        allowed = stage(slots.repartition(index.shards, "shard"), "allowed")
    out = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow()
        if not block.num_rows:
            continue
        q = np.array(block["v"].to_pylist(), np.float64)
        names = spark.createDataFrame(pa.table({"q": pa.array(range(len(q)), pa.int32()), "query_id": block["query_id"]}))
        if mask is None:
            # few shards: each is several tasks, with a part of the queries
            parts = max(1, min(-(-spark.sparkContext.defaultParallelism // index.shards), -(-len(q) // BLOCK)))
            sent = shards.select("graph", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(parts).alias("parts"))
            sent = sent.repartitionByRange(parts, "part") if parts > 1 else sent
            near = sent.mapInArrow(lambda it, q=q: _ask(it, q, top_k, ef, metric), "q int, slot long, score double")
        else:
            near = shards.groupBy("shard").cogroup(allowed.groupBy("shard")).applyInArrow(_masked(q, top_k, ef, metric), "q int, slot long, score double")
        one = near.join(F.broadcast(names), "q").drop("q")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = asked.select("query_id", F.lit(0).cast("long").alias("slot"), F.lit(0.0).alias("score")).limit(0)
    best = F.round("score", 12)
    w = Window.partitionBy("query_id").orderBy(best.desc() if metric == "cosine" else best.asc(), "slot")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def graph_search(index: GraphIndex, docs: DataFrame, query: Sequence[float], top_k: int = 5, ef: int = EF_SEARCH, mask: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, slot, score, rank) for one query, as :func:`vsearch.operators.knn.knn`; ``docs`` has the ids and what the mask needs."""
    one = docs.sparkSession.createDataFrame([(0, [float(v) for v in query])], "query_id int, query_vector array<double>")
    found = graph_search_batch(index, one, top_k, ef, None if mask is None else docs.filter(mask).select("slot")).drop("query_id")
    return docs.select(F.col(id_col).alias("id"), "slot").join(F.broadcast(found), "slot").select("id", "slot", "score", "rank")
