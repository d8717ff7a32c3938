"""Keyword search: the inverted index as DataFrames, and BM25 over it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vsearch.functions.text import tokenize
from vsearch.operators.knn import check_k
from vsearch.runtime import small, stage

K1, B = 1.5, 0.75


def doc_lengths(docs: DataFrame, slot: str = "slot", text: str = "text", group: str | None = None, flags: str | None = None) -> DataFrame:
    """(slot, toks, dl[, grp, flags]) of every document; one without terms has length 0 and counts."""
    grp = ([F.col(group).alias("grp")] if group else []) + ([F.col(flags).alias("flags")] if flags else [])
    return docs.select(F.col(slot).alias("slot"), tokenize(F.col(text)).alias("toks"), *grp).withColumn("dl", F.size("toks"))


def postings(lengths: DataFrame) -> DataFrame:
    """(slot, term, tf, dl): counts are complete before the shuffle, as a document lies in one partition."""
    keys = [c for c in ("grp", "slot", "dl") if c in lengths.columns]
    return lengths.select(*keys, F.explode("toks").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def totals(lengths: DataFrame) -> DataFrame:
    grp = [F.col("grp")] if "grp" in lengths.columns else []
    return lengths.groupBy(*grp).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"))


def document_frequency(post: DataFrame) -> DataFrame:
    keys = [c for c in ("grp",) if c in post.columns]
    return post.groupBy(*keys, "term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    floor = F.lit(1e-6)
    return tf * (k1 + 1) / F.greatest(tf + k1 * (1 - b + b * dl / F.greatest(avgdl, floor)), floor)


def query_terms(queries: DataFrame, query_id: str = "query_id", query_text: str = "query_text", group: str | None = None) -> DataFrame:
    """(query_id, term, qtf[, grp]); a repeated term counts again."""
    grp = [F.col(group).alias("grp")] if group else []
    terms = queries.select(F.col(query_id).alias("query_id"), *grp, F.explode(tokenize(F.col(query_text))).alias("term"))
    return terms.groupBy("query_id", *(["grp"] if group else []), "term").agg(F.count("*").alias("qtf"))


def bm25_batch(
    docs: DataFrame, queries: DataFrame, top_k: int = 10, k1: float = K1, b: float = B, allow: DataFrame | None = None, slot: str = "slot", text: str = "text", group: str | None = None,
    query_id: str = "query_id", query_text: str = "query_text", query_k: str | None = None, flags: str | None = None, query_flag: str | None = None,
) -> DataFrame:
    """(query_id, slot, score, rank): the best documents by BM25 for every query, ties by slot.

    Only documents that share a term with the query are returned. ``allow``,
    (slot) or (query_id, slot), restricts them; corpus statistics stay those of
    all ``docs``. ``group`` names a column of both tables: each query searches
    its group's documents with their statistics. ``query_k`` names a column
    with each query's k. ``flags``, an array of booleans of a document, and
    ``query_flag``, a place in it, restrict a query to the documents that have
    its flag, without a table of what each query may find. Queries without
    terms, and an empty corpus, give no rows. Scores that agree to 12 digits
    tie, as sums are taken in any order.

    Documents are read once: what leaves the scan, and is written, is a row for
    each document and one for each of its terms that some query asks for. The
    terms of the queries are broadcast if few enough.
    """
    check_k(top_k)
    lengths = doc_lengths(docs, slot, text, group, flags)
    keys = ["grp"] if group else []
    terms = query_terms(queries, query_id, query_text, group)
    # all that is broadcast has at most a row for each term of each query
    hint = F.broadcast if small(terms) else (lambda df: df)
    # no term is empty: that one stands for the document
    wanted = terms.select(*keys, "term").union(terms.select(*keys, F.lit(""))).distinct()
    body = ["flags"] if flags else []
    seen = (
        lengths.select(*keys, "slot", "dl", *body, F.explode(F.concat("toks", F.array(F.lit("")))).alias("term"))
        .join(hint(wanted), [*keys, "term"])
        .groupBy(*keys, "slot", "dl", *body, "term").agg(F.count("*").alias("tf"))
    )
    seen = stage(seen, "matched")
    matched = seen.filter("term <> ''")
    freq = document_frequency(matched)
    weighted = terms.join(freq, [*keys, "term"])
    whole = totals(seen.filter("term = ''"))
    weighted = weighted.join(hint(whole), "grp") if group else weighted.crossJoin(F.broadcast(whole))  # one row
    if flags:
        weighted = weighted.join(hint(queries.select(F.col(query_id).alias("query_id"), F.col(query_flag).alias("_flag"))), "query_id")
    weighted = weighted.select(
        *(["_flag"] if flags else []),
        "query_id", *keys, "term", (F.col("qtf") * idf(F.col("n_docs"), F.col("df"))).alias("w"), (F.col("total_tokens") / F.greatest(F.col("n_docs"), F.lit(1))).alias("avgdl")
    )
    hits = matched.join(hint(weighted), [*keys, "term"])
    if flags:
        hits = hits.filter(F.col("flags")[F.col("_flag")])
    if allow is not None:
        hits = hits.join(allow, [c for c in ("query_id", "slot") if c in allow.columns], "left_semi")
    scores = hits.groupBy("query_id", "slot").agg(F.sum(F.col("w") * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("score"))
    most = top_k if query_k is None else queries.agg(F.max(query_k)).first()[0] or 1
    # a constant limit is applied within each partition before the shuffle by query
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "slot"))).filter(F.col("rank") <= int(most))
    if query_k is None:
        return ranked
    ks = queries.select(F.col(query_id).alias("query_id"), F.col(query_k).alias("_k"))
    return ranked.join(hint(ks), "query_id").filter(F.col("rank") <= F.col("_k")).drop("_k")


def bm25(docs: DataFrame, query: str, top_k: int = 10, k1: float = K1, b: float = B, allow: DataFrame | None = None, slot: str = "slot", text: str = "text") -> DataFrame:
    """(slot, score, rank) for one query text; see :func:`bm25_batch`."""
    one = docs.sparkSession.createDataFrame([(0, query)], "query_id int, query_text string")
    return bm25_batch(docs, one, top_k, k1, b, allow, slot, text).drop("query_id")


# --- a written index ----------------------------------------------------------------------------

#: Folders that the postings are spread over; a search reads those of its terms only. Each is written by up to SPREAD tasks, so a term of all documents isn't one task's work.
BUCKETS = 64
SPREAD = 16


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class Lexicon:
    """An inverted index in files: postings by hash of the term, sorted by it, and the documents' lengths.

    ``add`` and ``remove`` append a part or a set of removed slots; both count
    at the next search. ``rebuild`` folds them in.
    """

    path: str
    buckets: int = BUCKETS

    def _write(self, docs: DataFrame, mode: str, slot: str, text: str) -> None:
        lengths = doc_lengths(docs, slot, text)
        lengths.select("slot", "dl").write.mode(mode).parquet(f"{self.path}/docs")
        post = postings(lengths).withColumn("bucket", _bucket(F.col("term"), self.buckets))
        post.repartition("bucket", F.pmod(F.xxhash64("slot"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/postings")

    def build(self, docs: DataFrame, slot: str = "slot", text: str = "text") -> Lexicon:
        self._write(docs, "overwrite", slot, text)
        docs.select(F.col(slot).cast("long").alias("slot")).limit(0).write.mode("overwrite").parquet(f"{self.path}/removed")
        return self

    def add(self, docs: DataFrame, slot: str = "slot", text: str = "text") -> None:
        """Slots are new ones: to replace a document, remove it and add it under its new slot."""
        self._write(docs, "append", slot, text)

    def remove(self, slots: DataFrame) -> None:
        slots.select(F.col("slot").cast("long")).write.mode("append").parquet(f"{self.path}/removed")

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        rows = spark.read.parquet(f"{self.path}/{name}")
        return rows.join(spark.read.parquet(f"{self.path}/removed"), "slot", "left_anti")

    def docs(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "docs")

    def postings(self, spark: SparkSession, terms: list[str] | None = None) -> DataFrame:
        """Those of ``terms`` only, if given: folders and row groups of other terms aren't read."""
        rows = spark.read.parquet(f"{self.path}/postings")
        if terms is not None:
            wanted = {r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"), self.buckets)).collect()} if terms else set()
            rows = rows.filter(F.col("bucket").isin(sorted(wanted)) & F.col("term").isin(terms)) if terms else rows.limit(0)
        return rows.drop("bucket").join(spark.read.parquet(f"{self.path}/removed"), "slot", "left_anti")

    def rebuild(self, docs: DataFrame, slot: str = "slot", text: str = "text") -> Lexicon:
        return self.build(docs, slot, text)

    def search(self, spark: SparkSession, query: str, top_k: int = 10, k1: float = K1, b: float = B, allow: DataFrame | None = None) -> DataFrame:
        """(slot, score, rank) as :func:`bm25`, reading the query's terms only."""
        check_k(top_k)
        one = spark.createDataFrame([(query,)], "q string").select(tokenize(F.col("q"))).first()[0]
        counts = {t: one.count(t) for t in one}
        total = self.docs(spark).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        post = self.postings(spark, list(counts))
        df = F.broadcast(post.groupBy("term").agg(F.count("*").alias("df")))  # a row for each term of one query
        qtf = reduce(lambda c, t: c.when(F.col("term") == t, F.lit(counts[t])), counts, F.when(F.lit(False), F.lit(0)))
        weight = qtf * idf(F.lit(total["n_docs"]), F.col("df")) * term_weight(F.col("tf"), F.col("dl"), F.lit(total["total"] / max(total["n_docs"], 1)), k1, b)
        hits = post.join(df, "term")
        if allow is not None:
            hits = hits.join(allow.select("slot"), "slot", "left_semi")
        scores = hits.groupBy("slot").agg(F.sum(weight).alias("score"))
        best = scores.orderBy(F.round("score", 12).desc(), "slot").limit(top_k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "slot")))
