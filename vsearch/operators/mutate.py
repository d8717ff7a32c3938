"""Changes to a collection, each a function from one snapshot to the next.

A snapshot has the columns of ``types.DOCS`` and may have more; those are kept
on old rows and NULL on new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vsearch.operators.numbering import dense_number
from vsearch.runtime import stage
from vsearch.types import StoreError

CONTENT = ("text", "vector", "metadata")


def next_slot(docs: DataFrame) -> int:
    """One after the greatest slot."""
    last = docs.agg(F.max("slot")).first()[0]
    return 0 if last is None else last + 1


def _latest(rows: DataFrame) -> DataFrame:
    """Of several rows of a doc_id the one of greatest seq; null ids are left out."""
    cols = [c for c in rows.columns if c != "doc_id"]
    picked = rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max_by(F.struct(*cols), F.col("seq")).alias("r"))
    return picked.select("doc_id", "r.*")


def _appended(docs: DataFrame, new: DataFrame, by: list[Column | str]) -> DataFrame:
    """``docs`` and ``new`` rows, numbered after the last slot in the order of ``by``."""
    numbered = dense_number(new, by, "slot", next_slot(docs)).withColumn("active", F.lit(True))
    return docs.unionByName(numbered.select([c for c in docs.columns if c in numbered.columns]), allowMissingColumns=True)


def duplicates(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id) of ``rows`` that ``docs`` has, deleted ones included, or that come twice."""
    twice = rows.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    return rows.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_semi").union(twice).distinct()


def add(docs: DataFrame, rows: DataFrame, by: str = "seq", strict: bool = True) -> DataFrame:
    """Append ``rows`` (seq, doc_id, text, vector, metadata).

    An id that exists, even deleted, or comes twice is an error; with
    ``strict`` off such rows are skipped, and of rows that come twice the first
    is taken.
    """
    if strict:
        bad = duplicates(docs, rows).take(1)
        if bad:
            raise StoreError(f"doc_id {bad[0][0]!r} exists")
        new = rows
    else:
        first = rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), F.col(by)).alias("r")).select("doc_id", "r.*")
        new = first.join(docs.select("doc_id"), "doc_id", "left_anti")
    return _appended(docs, new, [by, "doc_id"])


def update(docs: DataFrame, rows: DataFrame, strict: bool = True) -> DataFrame:
    """Replace text, vector and metadata of existing ids, which makes deleted ones active again.

    A missing id is an error, or skipped with ``strict`` off; of several rows
    of an id the one of greatest ``seq`` counts. Metadata left NULL becomes {}.
    """
    last = _latest(rows)
    if strict:
        missing = last.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti").take(1)
        if missing:
            raise StoreError(f"doc_id {missing[0][0]!r} doesn't exist")
    new = last.select("doc_id", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in CONTENT])
    joined = docs.join(new, "doc_id", "left")
    is_new = F.coalesce("_new", F.lit(False))
    value = {"text": F.col("_text"), "vector": F.col("_vector"), "metadata": F.coalesce("_metadata", F.lit("{}"))}
    return joined.select([F.when(is_new, value[c]).otherwise(F.col(c)).alias(c) if c in value else (F.col("active") | is_new).alias("active") if c == "active" else F.col(c) for c in docs.columns])


def upsert(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Update active ids in place; add absent ids and, at the end, deleted ones anew. The row of greatest ``seq`` of an id counts."""
    last = stage(_latest(rows), "upserts")
    dead = docs.filter(~F.col("active")).join(last.select("doc_id"), "doc_id", "left_semi").select("doc_id")
    kept = docs.join(dead, "doc_id", "left_anti")
    new = last.join(docs.filter("active").select("doc_id"), "doc_id", "left_anti")
    return _appended(update(kept, last, strict=False), new, ["seq", "doc_id"])


def delete(docs: DataFrame, ids: DataFrame, strict: bool = True) -> DataFrame:
    """Mark ``ids`` (doc_id) as deleted; their rows stay until compacted. A missing id is an error unless ``strict`` is off."""
    gone = ids.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    if strict:
        missing = gone.join(docs.select("doc_id"), "doc_id", "left_anti").take(1)
        if missing:
            raise StoreError(f"doc_id {missing[0][0]!r} doesn't exist")
    marked = docs.join(gone.withColumn("_gone", F.lit(True)), "doc_id", "left")
    return marked.select([(F.col("active") & F.col("_gone").isNull()).alias("active") if c == "active" else F.col(c) for c in docs.columns])


def compact(docs: DataFrame) -> DataFrame:
    """Drop deleted rows and number the rest from 0 in their order."""
    live = docs.filter("active").withColumnRenamed("slot", "_old")
    return dense_number(live, ["_old"], "slot").select(docs.columns)


def log_entries(rows: DataFrame) -> DataFrame:
    """Entries of a log, each ``seq`` once, with ``op`` in lower case; unknown ops and null ids are left out."""
    cols = [c for c in ("op", "doc_id", *CONTENT) if c in rows.columns]
    once = rows.filter(F.col("seq").isNotNull()).groupBy("seq").agg(F.min(F.struct(*cols)).alias("r")).select("seq", "r.*")
    return once.withColumn("op", F.lower(F.trim("op"))).filter(F.col("op").isin("insert", "update", "delete") & F.col("doc_id").isNotNull())


def replay(docs: DataFrame, log: DataFrame, revive: bool = False) -> DataFrame:
    """Apply log entries (seq, op, doc_id, text, vector, metadata) in the order of seq.

    insert: only if the id doesn't exist; with ``revive`` also if it is
    deleted, so that a delete and a later insert aren't lost. update: replaces
    the content and makes the document active, adding it if absent. delete:
    marks an existing document. New documents follow in the order of the entry
    that created them.

    The end state of an id follows from the last entry that sets its content
    (the last update, the first insert, with ``revive`` also an insert right
    after a delete) and the last delete, so entries are aggregated before the
    shuffle and an id with very many of them is no more work than others.
    """
    entries = stage(log_entries(log), "log")
    row = F.struct(*CONTENT)
    if revive:
        # an insert counts if the entry before it, of the same id, is a delete; entries and their successors meet by number, so no id is a group of its own
        entries = dense_number(entries, ["doc_id", "seq"], "n")
        before = entries.select((F.col("n") + 1).alias("n"), F.col("doc_id").alias("_doc"), F.col("op").alias("_op"))
        entries = entries.join(before, "n", "left").withColumn("_first", ~F.coalesce(F.col("_doc") == F.col("doc_id"), F.lit(False)))
        again = (F.col("op") == "insert") & ~F.col("_first") & (F.col("_op") == "delete")
        start = (F.col("op") == "insert") & F.col("_first")
    else:
        again, start = F.lit(False), F.col("op") == "insert"

    def seqs(which: Column) -> Column:
        return F.when(which, F.col("seq"))

    updated, inserts = F.col("op") == "update", F.col("op") == "insert"
    per = entries.groupBy("doc_id").agg(
        F.max(seqs(F.col("op") == "delete")).alias("d"),
        F.min(seqs(inserts | updated)).alias("born"),
        F.max(seqs(updated | again)).alias("u"),
        F.max_by(F.when(updated | again, row), seqs(updated | again)).alias("urow"),
        F.min(seqs(start)).alias("i"),
        F.min_by(F.when(start, row), seqs(start)).alias("irow"),
    )
    old = docs.select("doc_id", F.lit(True).alias("_there"), F.col("active").alias("_active"))
    state = per.join(old, "doc_id", "left")
    there = F.coalesce("_there", F.lit(False))
    # the first insert counts if nothing set the document before
    opens = (~there | ~F.col("_active")) if revive else ~there
    since = F.coalesce("u", F.when(opens, F.col("i")))
    content = F.when(F.col("u").isNotNull(), F.col("urow")).when(opens, F.col("irow"))
    exists = there | F.col("born").isNotNull()
    deleted = F.when(since.isNotNull(), F.coalesce(F.col("d") > since, F.lit(False))).otherwise(F.col("d").isNotNull() | ~F.coalesce("_active", F.lit(True)))
    state = stage(state.filter(exists).select("doc_id", there.alias("_there"), "born", content.alias("_row"), (~deleted).alias("_live")), "state")

    changed = docs.join(state.filter("_there").select("doc_id", "_row", "_live"), "doc_id", "left")
    fresh = F.col("_row").isNotNull()
    value = {c: F.when(fresh, F.col(f"_row.{c}")).otherwise(F.col(c)).alias(c) for c in CONTENT}
    value["active"] = F.coalesce("_live", "active").alias("active")
    kept = changed.select([value.get(c, F.col(c)) for c in docs.columns])
    new = state.filter("NOT _there").select("doc_id", "born", *[F.col(f"_row.{c}").alias(c) for c in CONTENT], F.col("_live").alias("active"))
    numbered = dense_number(new, ["born", "doc_id"], "slot", next_slot(docs))
    return kept.unionByName(numbered.select([c for c in docs.columns if c in numbered.columns]), allowMissingColumns=True)


def collection_info(docs: DataFrame) -> DataFrame:
    """One row: total_count, active_count, deleted_count, dimension."""
    return docs.agg(
        F.count("*").alias("total_count"), F.count_if("active").alias("active_count"), F.count_if(~F.col("active")).alias("deleted_count"), F.max(F.size("vector")).cast("long").alias("dimension")
    )


def get(docs: DataFrame, doc_id: str, deleted: bool = False) -> DataFrame:
    """The row of an id; of a deleted one only if asked for."""
    return docs.filter((F.col("doc_id") == doc_id) & (F.col("active") | F.lit(deleted)))


def records(docs: DataFrame, include_vector: bool = False) -> DataFrame:
    """Active rows in slot order, the vectors only if asked for, else they aren't read."""
    return order_of(docs).select("slot", "doc_id", "text", "metadata", *(["vector"] if include_vector else []))


def order_of(docs: DataFrame) -> DataFrame:
    """Active rows in slot order."""
    return docs.filter("active").orderBy("slot")
