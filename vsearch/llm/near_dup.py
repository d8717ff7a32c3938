"""Problem 4: near-duplicate texts by meet-in-the-middle ball hashing.

A text's fingerprint is, for each of a number of hash functions (``tables``),
the WIDTH smallest hashes of its shingle set. The distance of two fingerprints is the number of
hashes to take away from both until they agree; its ball of half the radius is
every way to take away one. Two texts within the radius (one hash taken from
each) thus emit a common variant, so a shuffle on variants brings them
together, and each colliding pair is verified on its full shingle sets.

Sets of at most SMALL_SET shingles, which are too small for that, also emit so
many of their least shingles that any two of them within the similarity share
one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vsearch.llm.components import components
from vsearch.llm.entries import TERM, entry_texts
from vsearch.runtime import broadcast_if_small, partitions, stage

SHINGLE = 3
LEAST_TERMS = 20
SIMILARITY = 0.6
WIDTH = 5
#: Of pairs at the similarity itself, of which one set contains the other, so many may meet in no table; of others it is fewer.
#: At 0.6 this takes fifteen tables: one lets such a pair through with probability 0.34, all with 0.998 (with 16 to 30
#: shingles down to 0.31 and 0.996, simulated); sets of one size with 0.44 and 0.9998.
MISSED = 1 / 400
#: Two sets of at most so many shingles meet for certain.
SMALL_SET = 15
#: Of a variant in a shuffle, about.
KEY_BYTES = 40
#: A variant that more texts share is joined in blocks of about so many, each a task's share.
BLOCK_TEXTS = 2_000
#: Exact copies of one text, if more than this, are linked through their first one only.
EXPAND = 20

_U = np.uint64
_LEAST = _U(0xC2B2AE3D27D4EB4F)

@lru_cache(maxsize=8)
def tables(similarity: float) -> int:
    """How many it takes for MISSED. Of a set's WIDTH least hashes, all but one at most must be in a subset of it."""
    meet = similarity ** (WIDTH - 1) * (WIDTH - (WIDTH - 1) * similarity)
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-meet))) if meet < 1 else 1


@lru_cache(maxsize=8)
def _seeds(n: int) -> np.ndarray:
    return (np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, term: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[term] = xxhash.xxh3_64_intdigest(term)
        return h


def shingle_hashes(texts: list[str], hashes: dict, width: int = SHINGLE, least: int = LEAST_TERMS) -> Iterator[np.ndarray | None]:
    """Sorted distinct 64-bit hashes of the shingles of each text; None for a text of too few terms."""
    least = max(least, width)
    toks = [TERM.findall(t.lower()) for t in texts]
    sizes = [len(t) if len(t) >= least else 0 for t in toks]
    flat = np.fromiter((hashes[w] for t, n in zip(toks, sizes) if n for w in t), dtype=_U, count=sum(sizes))
    n = max(len(flat) - width + 1, 0)
    mixed = np.zeros(n, dtype=_U)
    for k in range(width):
        mixed = mixed * _U(0xD6E8FEB86659FD93) + _mix(flat[k : k + n] + _U(k + 1))
    mixed = _mix(mixed)
    at = 0
    for size in sizes:
        yield np.unique(mixed[at : at + size - width + 1]) if size else None
        at += size


def variants(shingles: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Keys of all fingerprint variants of a shingle set, at most WIDTH + 1 a table, and of the least shingles of a small one."""
    n = len(shingles)
    m = min(WIDTH, n)
    seeds = _seeds(tables(similarity))
    low = _mix(shingles[None, :] ^ seeds)
    if n > m:
        low = np.partition(low, m - 1, axis=1)[:, :m]
    total = low.sum(axis=1, keepdims=True, dtype=_U)
    keys = [_mix(total - low + seeds)] if m > 1 else []
    if m < WIDTH:  # the whole set may equal a larger fingerprint's variant
        keys.append(_mix(total + seeds))
    if n <= SMALL_SET:  # at least similarity * n are shared, so the least shared one is among these
        keys.append(_mix(np.sort(shingles)[None, : n - math.ceil(similarity * n - 1e-9) + 1] ^ _LEAST))
    return np.unique(np.concatenate([k.ravel() for k in keys]))


_SKETCH = "id long, text_hash binary, set_hash binary, n int, keys array<long>"


def _sketch(batches: Iterator[pa.RecordBatch], width: int, least: int, similarity: float) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        rows: list[list] = [[] for _ in range(5)]
        texts = batch.column(1).to_pylist()
        for i, text, sh in zip(batch.column(0).to_pylist(), texts, shingle_hashes(texts, hashes, width, least)):
            if sh is not None:
                for c, v in zip(rows, (i, xxhash.xxh3_128_digest(text), xxhash.xxh3_128_digest(sh.tobytes()), len(sh), variants(sh, similarity).view(np.int64))):
                    c.append(v)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["id", "text_hash", "set_hash", "n", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], width: int, least: int) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        sets = [None if s is None else s.tobytes() for s in shingle_hashes(batch.column(1).to_pylist(), hashes, width, least)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            p, q = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = len(np.intersect1d(p, q, assume_unique=True))
            union = len(p) + len(q) - both
            if both >= similarity * union - 1e-9:
                for c, v in zip(out, (a, b, both / union)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["a", "b", "similarity"])


def _colliding(left: DataFrame, right: DataFrame | None, similarity: float) -> DataFrame:
    """(a, b), a < b, of texts that share a variant and whose sizes allow the similarity."""
    a, b = left.alias("a"), (left if right is None else right).alias("b")
    close = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.block") == F.col("b.block"))
        & (F.col("a.id") < F.col("b.id"))
        & (F.col("a.n") >= F.col("b.n") * similarity - 1e-9)
        & (F.col("b.n") >= F.col("a.n") * similarity - 1e-9)
    )
    return a.join(b.hint("merge"), close).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def near_duplicates(
    df: DataFrame, id_col: str = "seq", text_col: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE, least_terms: int = LEAST_TERMS
) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and the class of every text.

    Returns (links, classes). ``classes`` has (id, rep, text_hash) for every id
    whose text has at least ``least_terms`` terms; ids with equal shingle sets
    share their least id as rep, whether or not their texts are the same, and
    exact copies share their text_hash. ``links`` has (a, b, similarity), a < b, for pairs of reps
    whose sets have intersection over union of at least ``similarity``.

    Null ids or texts, empty and short texts take no part. A text repeated
    under many ids is sketched for each but emits variants once. A variant that
    very many texts share is joined in blocks, so that no task has all their
    pairs; nothing is capped.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(
        F.col("id").isNotNull() & (F.length("text") >= 2 * least_terms - 1)
    )
    sketches = stage(rows.mapInArrow(lambda it: _sketch(it, width, least_terms, similarity), _SKETCH), "sketches")
    reps = stage(sketches.groupBy("set_hash").agg(F.min(F.struct("id", "n", "keys")).alias("r")).select("set_hash", "r.*"), "reps")
    members = sketches.groupBy("id", "set_hash").agg(F.min("text_hash").alias("text_hash"))
    classes = members.join(reps.select("set_hash", F.col("id").alias("rep")), "set_hash").select("id", "rep", "text_hash")

    n_keys = reps.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    balls = reps.select("id", "n", F.explode("keys").alias("key")).repartition(partitions(df.sparkSession, n_keys * KEY_BYTES), "key")
    counts = balls.groupBy("key").agg(F.count("*").alias("texts")).filter(F.col("texts") > BLOCK_TEXTS)
    hot = stage(counts.select("key", F.ceil(F.col("texts") / BLOCK_TEXTS).cast("int").alias("blocks")), "hot-variants")
    if hot.isEmpty():
        pairs = _colliding(balls.withColumn("block", F.lit(0)), None, similarity)
    else:
        few = broadcast_if_small(hot)
        shared = balls.join(few, "key")
        # each text of one side meets all of the other in one block
        left = shared.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks")
        right = shared.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        pairs = _colliding(balls.join(few, "key", "left_anti").withColumn("block", F.lit(0)), None, similarity).unionByName(_colliding(left, right, similarity))
    pairs = stage(pairs.distinct(), "pairs")

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = entry_texts(rows.join(broadcast_if_small(ids), "id", "left_semi"), "id", "text")
    sets = stage(texts.mapInArrow(lambda it: _sets(it, width, least_terms), "id long, shingles binary"), "sets")
    both = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    links = both.mapInArrow(lambda it: _verify(it, similarity), "a long, b long, similarity double")
    return links, classes


def expanded(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ids: links carried over to the members of both classes, and pairs of members of one class.

    All pairs of different texts are spelt out, and those of exact copies up to
    EXPAND of a text. A text of more copies is carried by its first one alone,
    to which each other copy is paired: the pairs among them aren't spelt out.
    Members of a class that has very many of them are taken in blocks, so that
    no task has all their pairs.
    """
    links, classes = stage(links.select("a", "b"), "links"), stage(classes, "classes")
    sizes = classes.groupBy("rep").agg(F.count("*").alias("size")).filter("size > 1")
    shared = stage(classes.join(sizes.select("rep"), "rep"), "shared")
    copies = shared.groupBy("rep", "text_hash").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter(F.col("copies") > EXPAND)
    copies = stage(copies.select("rep", "text_hash", "first"), "copies")
    if copies.isEmpty():
        carried, star = shared.select("id", "rep"), None
    else:
        marked = shared.join(broadcast_if_small(copies), ["rep", "text_hash"], "left")
        star = marked.filter(F.col("first") < F.col("id")).select(F.col("first").alias("a"), F.col("id").alias("b"))
        carried = marked.filter(F.col("first").isNull() | (F.col("first") == F.col("id"))).select("id", "rep")
    blocks = carried.groupBy("rep").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("blocks"))
    carried = stage(carried.join(blocks, "rep").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")), "carried")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")

    left, right = carried.alias("a"), carried.select("id", "rep", every).alias("b")
    same = (F.col("a.rep") == F.col("b.rep")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id"))
    found = left.join(right.hint("merge"), same).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))

    # a rep that is alone in its class stands for itself
    blocks, members = carried.select("rep", "blocks").distinct(), carried.select("rep", "block", "id")
    across = links
    for end, other in (("a", "b"), ("b", "a")):
        spread = across.join(blocks.withColumnRenamed("rep", end), end, "left").select(end, other, F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
        across = spread.join(members.withColumnsRenamed({"rep": end, "id": "member"}), [end, "block"], "left").select(F.coalesce("member", end).alias(end), other)
    found = found.unionByName(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found if star is None else found.unionByName(star)


def groups(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, rep, group_id, n_links) for every id: its class, the least id of its connected group, and the number of other classes its text is linked to."""
    links, classes = stage(links.select("a", "b"), "links"), stage(classes, "classes")
    found = components(links).withColumnsRenamed({"id": "rep", "root": "group_id"})
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return (
        classes.join(found.join(ends, "rep"), "rep", "left")
        .select("id", "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
