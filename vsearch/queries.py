"""The driver's queries for the core, and the SQL each is held against.

The committed collection is ``snapshot_docs``, the log ``wal_entries``, the
text corpus ``documents``; every query runs over its whole tables.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import partial, reduce
from operator import and_
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vsearch.embed import HashingEmbedder, embedding
from vsearch.functions import vector as V
from vsearch.functions.filters import compile_filters, parsed
from vsearch.functions.text import chunks, tokenize
from vsearch.operators import ann, chunking, fusion, graph, knn, lexical, mutate
from vsearch.plans import search as plans
from vsearch.runtime import shared_dir, stage, table
from vsearch.sources.log import parse_lines
from vsearch.sources.sv import read_sv, write_sv
from vsearch.store import Store
from vsearch.streaming.ingest import op_counts
from vsearch.types import DOCS, StoreError

Query = Callable[[SparkSession, str], DataFrame]
QUERY_ID = 28
TOP_K = 10
#: Each document is tested against so many filters in one pass; more take further passes.
FILTER_BLOCK = 1_000


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "snapshot_docs")


def live(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("active")


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_queries")


def query_row(spark: SparkSession, d: str, query_id: int = QUERY_ID):
    return search_queries(spark, d).filter(F.col("query_id") == query_id).first()


def _scored(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# --- dense --------------------------------------------------------------------------------------

LANGS = ["en", "de"]


def vector_norms(spark, d):
    return docs(spark, d).select("slot", F.round(V.norm(F.col("vector")), 6).alias("norm"))


def _knn(spark, d, metric="cosine", k=TOP_K, mask=None, zero=False):
    q = query_row(spark, d)["query_vector"]
    found = knn.knn(live(spark, d), [0.0] * len(q) if zero else q, k, metric, mask)
    return _scored(found.withColumnRenamed("id", "doc_id"), "doc_id")


def knn_embeddings(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("slot"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = rows.filter("slot = 0").first()["vector"]
    return _scored(knn.knn(rows, q, TOP_K).withColumnRenamed("id", "vec_id"), "vec_id")


def _batch(spark, d, metric="cosine", filters=None, native=False):
    mask = plans.eligible(filters)
    run = knn.knn_batch_native if native else knn.knn_batch
    return _scored(run(docs(spark, d), search_queries(spark, d), TOP_K, metric, mask=mask), "query_id", "slot")


_COS = "CASE WHEN sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) = 0 THEN 0 ELSE list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END"
_L2 = "list_distance(a, b)"


def _knn_sql(score: str, order: str, where: str = "true", k: int = TOP_K, vector: str = f"(SELECT query_vector::DOUBLE[] FROM search_queries WHERE query_id = {QUERY_ID})") -> str:
    return f"""
        WITH p AS (SELECT slot, doc_id, vector::DOUBLE[] AS a, {vector} AS b FROM meta WHERE active AND {where}),
        s AS (SELECT slot, doc_id, {score} AS score FROM p),
        r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score {order}, slot) AS rank FROM s)
        SELECT doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= {k}"""


def _batch_sql(score: str, order: str, where: str = "true") -> str:
    return f"""
        WITH p AS (SELECT query_id, slot, vector::DOUBLE[] AS a, query_vector::DOUBLE[] AS b FROM meta, search_queries WHERE active AND {where}),
        s AS (SELECT query_id, slot, {score} AS score FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) {order}, slot) AS rank FROM s)
        SELECT query_id, slot, rank, round(score, 6) AS score FROM r WHERE rank <= {TOP_K}"""


# --- filters ------------------------------------------------------------------------------------

FILTERS: dict[str, dict[str, Any]] = {
    "filter_eq": {"category": "notes"},
    "filter_eq_operator": {"category": {"$eq": "guides"}},
    "filter_eq_number": {"chunk_index": 2.0},
    "filter_ne": {"size": {"$ne": "large"}},
    "filter_gt": {"price": {"$gt": 500}},
    "filter_gte": {"price": {"$gte": 500}},
    "filter_lt": {"price": {"$lt": 200}},
    "filter_lte": {"price": {"$lte": 200}},
    "filter_in": {"lang": {"$in": LANGS}},
    "filter_in_mixed": {"category": {"$in": [200, "notes", None]}},
    "filter_in_no_list": {"lang": {"$in": "en"}},
    "filter_nin": {"category": {"$nin": ["notes", "audit"]}},
    "filter_nin_no_list": {"category": {"$nin": "notes"}},
    "filter_range": {"price": {"$gt": 150, "$lt": 500}},
    "filter_multi_key": {"category": "guides", "lang": "en"},
    "filter_missing_key": {"nosuch": {"$ne": 1}},
    "filter_exists": {"tags": {}},
    "filter_null_value": {"category": None},
    "filter_ne_null": {"category": {"$ne": None}},
    "filter_list_value": {"tags": []},
    "filter_string_order": {"category": {"$gte": "guides"}},
    "filter_type_mismatch": {"category": {"$gt": 5}},
    "filter_none": {},
}


def _filter(spark, d, name):
    fits = live(spark, d).filter(compile_filters(FILTERS[name], parsed(F.col("metadata"))))
    return fits.agg(F.count("*").alias("n"), F.sum("slot").alias("slots")) if name in ("filter_missing_key", "filter_in_no_list", "filter_type_mismatch") else fits.select("slot", "doc_id")


def _at(key: str) -> str:
    return f"'$.\"{key}\"'"


def _num(key: str) -> str:
    return f"CASE WHEN json_type(m, {_at(key)}) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN json_extract_string(m, {_at(key)})::DOUBLE WHEN json_type(m, {_at(key)}) = 'BOOLEAN' THEN json_extract_string(m, {_at(key)})::BOOLEAN::INT::DOUBLE END"


def _str(key: str) -> str:
    return f"CASE WHEN json_type(m, {_at(key)}) = 'VARCHAR' THEN json_extract_string(m, {_at(key)}) END"


def _test_sql(key: str, op: str, v: Any) -> str:
    if op in ("$in", "$nin"):
        if not isinstance(v, list):
            return "false" if op == "$in" else "true"
        some = " OR ".join(_test_sql(key, "$eq", x) for x in v)
        return f"({some})" if op == "$in" else f"NOT ({some})"
    if op == "$ne":
        return f"NOT {_test_sql(key, '$eq', v)}"
    sign = {"$eq": "=", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}[op]
    if v is None:
        return f"coalesce(json_type(m, {_at(key)}) = 'NULL', false)"
    if isinstance(v, list):
        return f"coalesce(json_type(m, {_at(key)}) = 'ARRAY' AND (m -> {_at(key)})::VARCHAR = '{json.dumps(v)}', false)"
    side = f"({_str(key)}) {sign} '{v}'" if isinstance(v, str) else f"({_num(key)}) {sign} {float(v)}"
    return f"coalesce({side}, false)"


def filter_sql(filters: dict[str, Any]) -> str:
    parts = ["true"]
    for key, cond in filters.items():
        parts.append(f"coalesce(json_exists(m, {_at(key)}), false)")
        parts += [_test_sql(key, op, v) for op, v in cond.items()] if isinstance(cond, dict) else [_test_sql(key, "$eq", cond)]
    return " AND ".join(parts)


_META = "meta AS (SELECT *, CASE WHEN json_valid(metadata) THEN metadata::JSON END AS m FROM snapshot_docs)"


def _with_meta(sql: str) -> str:
    """Put the parsed metadata before the query's own tables."""
    body = sql.strip()
    return f"WITH {_META}, " + body[4:] if body.upper().startswith("WITH") else f"WITH {_META} {body}"


# --- keyword search -----------------------------------------------------------------------------


def _lengths(spark, d):
    return lexical.doc_lengths(live(spark, d))


def tokenize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", tokenize(F.col("text"))).alias("terms"))


def term_frequency(spark, d):
    return lexical.postings(_lengths(spark, d)).select("slot", "term", "tf")


def document_frequency(spark, d):
    return lexical.document_frequency(lexical.postings(_lengths(spark, d)))


def doc_lengths(spark, d):
    return _lengths(spark, d).select("slot", F.col("dl").cast("long").alias("dl"))


def corpus_stats(spark, d):
    return lexical.totals(_lengths(spark, d)).select("n_docs", "total_tokens", F.round(F.col("total_tokens") / F.greatest("n_docs", F.lit(1)), 6).alias("avgdl"))


def idf(spark, d):
    lengths = _lengths(spark, d)
    df = lexical.document_frequency(lexical.postings(lengths))
    return df.crossJoin(F.broadcast(lexical.totals(lengths))).select("term", F.round(lexical.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


TEXT = "budget tombstone planner budget"


def _bm25(spark, d, text=TEXT, k=TOP_K, k1=lexical.K1, b=lexical.B, allow=None, everything=False, count=False):
    rows = docs(spark, d) if everything else live(spark, d)
    allowed = rows.filter(plans.eligible(allow)).select("slot") if allow else None
    found = lexical.bm25(rows, text, k, k1, b, allowed)
    return found.agg(F.count("*").alias("n")) if count else _scored(found, "slot")


def bm25_batch(spark, d):
    return _scored(lexical.bm25_batch(live(spark, d), search_queries(spark, d), TOP_K), "query_id", "slot")


def bm25_indexed(spark, d):
    """A search of an index in files; the folder is a stage of its own."""
    index = lexical.Lexicon(f"{shared_dir(spark)}/stage/lexicon-{uuid.uuid4().hex}").build(docs(spark, d))
    index.remove(docs(spark, d).filter("NOT active").select("slot"))
    return _scored(index.search(spark, TEXT, TOP_K), "slot")


def bm25_documents(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("slot"), "text")
    return _scored(lexical.bm25_batch(rows, search_queries(spark, d), TOP_K), "query_id", "slot")


_TERMS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"


def _bm25_ctes(corpus: str, queries: str, k1: float = lexical.K1, b: float = lexical.B, where: str = "true", group: bool = False) -> str:
    g, u = ("coll_name, ", "USING (coll_name)") if group else ("", "")
    return f"""
        dl AS (SELECT {g}slot, {_TERMS} AS t, len({_TERMS}) AS dl FROM {corpus}),
        cs AS (SELECT {g}count(*) AS n, sum(dl) / greatest(count(*), 1) AS avgdl FROM dl {"GROUP BY coll_name" if group else ""}),
        post AS (SELECT {g}slot, dl, term, count(*) AS tf FROM (SELECT {g}slot, dl, unnest(t) AS term FROM dl) GROUP BY {g}slot, dl, term),
        freq AS (SELECT {g}term, count(*) AS df FROM post GROUP BY {g}term),
        qt AS (SELECT query_id, {g}term, count(*) AS qtf FROM (SELECT query_id, {g}unnest(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM {queries}) GROUP BY query_id, {g}term),
        bm AS (SELECT query_id, slot, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / greatest(avgdl, 1e-6)))) AS score
               FROM qt JOIN post USING ({g}term) JOIN freq USING ({g}term) {"JOIN cs " + u if group else ", cs"} WHERE {where} GROUP BY query_id, slot),
        sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, slot) AS rank FROM bm)"""


def _bm25_sql(text: str = TEXT, k: int = TOP_K, corpus: str = "(SELECT * FROM snapshot_docs WHERE active)", **kw: Any) -> str:
    one = f"(SELECT 0 AS query_id, '{text}' AS query_text)"
    return f"WITH {_bm25_ctes(corpus, one, **kw)} SELECT slot, rank, round(score, 6) AS score FROM sparse WHERE rank <= {k}"


# --- fusion -------------------------------------------------------------------------------------


def _hybrid(spark, d, alpha=0.5, filters=None):
    q = query_row(spark, d)
    found = plans.hybrid_search(docs(spark, d), TEXT, q["query_vector"], TOP_K, alpha, filters)
    return found.select("doc_id", F.col("rank").cast("long").alias("rank"), "score")


def hybrid_candidates(spark, d):
    """Both rankings of the hybrid search before they are fused."""
    depth = fusion.candidate_depth(TOP_K)
    dense = knn.knn(live(spark, d), query_row(spark, d)["query_vector"], depth).select(F.lit("dense").alias("leg"), "slot", F.col("rank").cast("long").alias("rank"))
    sparse = lexical.bm25(live(spark, d), TEXT, depth).select(F.lit("sparse").alias("leg"), "slot", F.col("rank").cast("long").alias("rank"))
    return dense.unionByName(sparse)


def hybrid_batch(spark, d):
    """The flagship: all search queries, each in its collection with its filter, weight and depth."""
    asked = search_queries(spark, d)
    texts = sorted(r[0] for r in asked.select("filter_json").filter("filter_json IS NOT NULL").distinct().collect())
    parts = [plans.hybrid_batch(docs(spark, d), asked.filter("filter_json IS NULL"), {})] if len(texts) > FILTER_BLOCK else []
    for at in range(0, max(len(texts), 1), FILTER_BLOCK):
        block = texts[at : at + FILTER_BLOCK]
        own = asked.filter(F.col("filter_json").isin(block)) if parts else asked
        parts.append(plans.hybrid_batch(docs(spark, d), own, {t: json.loads(t) for t in block}))
    found = reduce(DataFrame.unionByName, parts)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def _hybrid_sql(alpha: float, where: str = "true") -> str:
    depth = fusion.candidate_depth(TOP_K)
    return f"""
        WITH ok AS (SELECT slot FROM meta WHERE active AND {where}),
        {_bm25_ctes("(SELECT * FROM snapshot_docs WHERE active)", f"(SELECT 0 AS query_id, '{TEXT}' AS query_text)", where="slot IN (SELECT slot FROM ok)")},
        p AS (SELECT slot, vector::DOUBLE[] AS a, (SELECT query_vector::DOUBLE[] FROM search_queries WHERE query_id = {QUERY_ID}) AS b FROM snapshot_docs WHERE slot IN (SELECT slot FROM ok)),
        de AS (SELECT slot, row_number() OVER (ORDER BY {_COS} DESC, slot) AS rank FROM p QUALIFY rank <= {depth}),
        sp AS (SELECT slot, rank FROM sparse WHERE rank <= {depth}),
        f AS (SELECT slot, de.rank AS dr, sp.rank AS sr, coalesce({alpha} / (60.0 + de.rank), 0) + coalesce({1 - alpha} / (60.0 + sp.rank), 0) AS score FROM de FULL JOIN sp USING (slot)),
        r AS (SELECT *, row_number() OVER (ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM f)
        SELECT doc_id, rank, round(score, 6) AS score FROM r JOIN snapshot_docs USING (slot) WHERE rank <= {TOP_K}"""


def _hybrid_batch_sql() -> str:
    seen = ({"price": {"$gt": 150, "$lt": 500}}, {"category": "notes"}, {"size": {"$ne": "large"}}, {"lang": {"$in": ["en", "de"]}})
    case = " ".join(f"WHEN filter_json = '{json.dumps(f)}' THEN {filter_sql(f)}" for f in seen)
    return f"""
        WITH q AS (SELECT *, greatest(3 * top_k, 20) AS depth FROM search_queries WHERE trim(query_text) <> ''),
        ok AS (SELECT query_id, slot FROM q JOIN meta USING (coll_name) WHERE active AND CASE WHEN filter_json IS NULL THEN true {case} END),
        {_bm25_ctes("(SELECT * FROM snapshot_docs WHERE active)", "q", where="(query_id, slot) IN (SELECT (query_id, slot) FROM ok)", group=True)},
        p AS (SELECT query_id, slot, vector::DOUBLE[] AS a, query_vector::DOUBLE[] AS b FROM ok JOIN q USING (query_id) JOIN snapshot_docs USING (slot)),
        de0 AS (SELECT query_id, slot, row_number() OVER (PARTITION BY query_id ORDER BY round({_COS}, 12) DESC, slot) AS rank FROM p),
        de AS (SELECT query_id, slot, rank FROM de0 JOIN q USING (query_id) WHERE rank <= depth),
        sp AS (SELECT query_id, slot, rank FROM sparse JOIN q USING (query_id) WHERE rank <= depth),
        f0 AS (SELECT query_id, slot, de.rank AS dr, sp.rank AS sr FROM de FULL JOIN sp USING (query_id, slot)),
        f AS (SELECT query_id, slot, top_k, dr, sr, coalesce(alpha / (60.0 + dr), 0) + coalesce((1 - alpha) / (60.0 + sr), 0) AS score FROM f0 JOIN q USING (query_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM f)
        SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r JOIN snapshot_docs USING (slot) WHERE rank <= top_k"""


# --- chunks -------------------------------------------------------------------------------------


def _chunks(spark, d, size, overlap, separator=None):
    cut = table(spark, d, "documents").select("doc_id", F.posexplode(chunks(F.col("text"), size, overlap, separator)).alias("i", "chunk"))
    return cut.select("doc_id", F.col("i").cast("long").alias("chunk_index"), "chunk")


def chunk_by_spec(spark, d):
    """Each collection's documents by the size, overlap and separator of its own spec, which are columns."""
    rows = docs(spark, d).join(F.broadcast(table(spark, d, "chunk_specs")), "coll_name")
    cut = rows.select("slot", F.posexplode(chunks(F.col("text"), F.col("chunk_size"), F.col("overlap"), F.col("separator"))).alias("i", "chunk"))
    return cut.select("slot", F.col("i").cast("long").alias("chunk_index"), "chunk")


def chunk_doc_ids_meta(spark, d):
    cut = chunking.chunk_documents(docs(spark, d), 120, 20)
    m = F.try_parse_json("metadata")
    return cut.select(
        "doc_id", "source_doc", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "text",
        F.try_variant_get(m, "$.lang", "string").alias("lang"), F.try_variant_get(m, "$.chunk_index", "long").alias("meta_index"), F.try_variant_get(m, "$.source_doc", "string").alias("meta_source"),
    )


def chunk_short_text(spark, d):
    return docs(spark, d).select("slot", F.size(chunks(F.col("text"), 100_000, 50)).cast("long").alias("n"))


def _chunk_sql(rows: str, key: str, size: str, overlap: str) -> str:
    """Windows of characters; positions are counted from 1."""
    has = "regexp_matches(text, '\\S')"
    return f"""
        w AS (SELECT {key}, s, substr(text, s, {size}) AS chunk FROM (SELECT {key}, text, {size} AS size, {overlap} AS overlap,
                unnest(CASE WHEN length(text) <= {size} THEN [1] ELSE range(1, length(text) + 1, {size} - {overlap}) END) AS s FROM {rows} WHERE text IS NOT NULL AND {has}) x),
        c AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY s) - 1 AS chunk_index, count(*) OVER (PARTITION BY {key}) AS total_chunks, chunk FROM w WHERE regexp_matches(chunk, '\\S'))"""


def _packed_sql(rows: str, key: str, size: str, overlap: str, sep: str) -> str:
    joined = "regexp_replace(a.c || p_ || x.c, '^\\s+|\\s+$', '', 'g')"
    return f"""
        t AS (SELECT {key}, text, {size} AS z_, {overlap} AS o_, {sep} AS p_, list_filter(list_transform(string_split(text, {sep}), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS segs
                   FROM {rows} WHERE text IS NOT NULL AND regexp_matches(text, '\\S')),
        f AS (SELECT {key}, text, z_, list_reduce(list_transform(segs, lambda s: {{'o': []::VARCHAR[], 'c': s}}), lambda a, x:
                CASE WHEN a.c = '' THEN {{'o': a.o, 'c': x.c}}
                     WHEN length({joined}) <= z_ THEN {{'o': a.o, 'c': {joined}}}
                     ELSE {{'o': list_append(a.o, a.c), 'c': CASE WHEN o_ > 0 THEN right(a.c, o_) || p_ || x.c ELSE x.c END}} END, {{'o': []::VARCHAR[], 'c': ''}}) AS r FROM t),
        l AS (SELECT {key}, CASE WHEN length(text) <= z_ THEN [text] WHEN r.c = '' THEN r.o ELSE list_append(r.o, r.c) END AS l FROM f),
        p AS (SELECT {key}, i - 1 AS chunk_index, l[i] AS chunk FROM l, unnest(range(1, len(l) + 1)) u(i))"""


# --- changes ------------------------------------------------------------------------------------


def _log(spark, d):
    return table(spark, d, "wal_entries").select("seq", "op", "doc_id", "text", "vector", "metadata")


def _ops(spark, d, op):
    return mutate.log_entries(_log(spark, d)).filter(F.col("op") == op)


def _state(df: DataFrame) -> DataFrame:
    return df.select("slot", "doc_id", "text", "metadata", "active", F.size("vector").cast("long").alias("dim"))


def add_absent(spark, d):
    return _state(mutate.add(docs(spark, d), _ops(spark, d, "insert"), strict=False))


def update_rows(spark, d):
    return _state(mutate.update(docs(spark, d), _ops(spark, d, "update"), strict=False))


def upsert(spark, d):
    return _state(mutate.upsert(docs(spark, d), _ops(spark, d, "update")))


def soft_delete(spark, d):
    return mutate.delete(docs(spark, d), _ops(spark, d, "delete"), strict=False).select("slot", "doc_id", "active")


def compact_renumber(spark, d):
    return mutate.compact(docs(spark, d)).select("slot", "doc_id")


def wal_replay(spark, d):
    return _state(mutate.replay(docs(spark, d), _log(spark, d)))


def wal_replay_revive(spark, d):
    return _state(mutate.replay(docs(spark, d), _log(spark, d), revive=True))


def collection_info(spark, d):
    return mutate.collection_info(docs(spark, d))


def get_by_id(spark, d):
    return mutate.get(docs(spark, d), "status_board").select("slot", "doc_id", "text")


def list_active(spark, d):
    return mutate.order_of(docs(spark, d)).select("slot", "doc_id")


def list_records(spark, d):
    return mutate.records(docs(spark, d), include_vector=True).select("slot", "doc_id", "text", "metadata", F.size("vector").cast("long").alias("dim"))


def log_lines(spark, d):
    e = parse_lines(table(spark, d, "wal_lines"))
    return e.select("seq", "op", "doc_id", "text", F.size("vector").cast("long").alias("dim"))


def log_windows(spark, d):
    return op_counts(table(spark, d, "wal_entries").filter("logged_at IS NOT NULL"), window="1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "op", "n")


_LOG = """log AS (SELECT seq, any_value(lower(trim(op))) AS op, any_value(doc_id) AS doc_id, any_value(text) AS text, any_value(vector) AS vector, any_value(metadata) AS metadata
                  FROM wal_entries WHERE seq IS NOT NULL GROUP BY seq HAVING any_value(doc_id) IS NOT NULL)"""
_OUT = "slot, doc_id, text, metadata, active, len(vector) AS dim"


def _replay_sql() -> str:
    """By the last change that counts: what stands before it can't matter."""
    return f"""
        WITH {_LOG},
        ev AS (SELECT l.*, s.doc_id IS NOT NULL AS there, s.active AS was FROM log l LEFT JOIN snapshot_docs s USING (doc_id)),
        setter AS (SELECT * FROM ev WHERE op = 'update' OR (op = 'insert' AND NOT there
                     AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.doc_id = ev.doc_id AND e.op IN ('insert', 'update') AND e.seq < ev.seq))
                   QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1),
        born AS (SELECT doc_id, min(seq) AS born FROM ev WHERE op IN ('insert', 'update') AND NOT there GROUP BY doc_id),
        gone AS (SELECT ev.doc_id, true AS gone FROM ev LEFT JOIN setter s USING (doc_id) WHERE ev.op = 'delete' AND (CASE WHEN s.seq IS NULL THEN ev.there ELSE ev.seq > s.seq END) GROUP BY ev.doc_id),
        ids AS (SELECT doc_id FROM snapshot_docs UNION SELECT doc_id FROM born),
        fin AS (SELECT ids.doc_id, coalesce(s.slot, (SELECT max(slot) FROM snapshot_docs) + row_number() OVER (PARTITION BY s.slot IS NULL ORDER BY b.born)) AS slot,
                  CASE WHEN x.doc_id IS NULL THEN s.text ELSE x.text END AS text, CASE WHEN x.doc_id IS NULL THEN s.metadata ELSE x.metadata END AS metadata,
                  CASE WHEN x.doc_id IS NULL THEN s.vector ELSE x.vector END AS vector,
                  CASE WHEN g.gone THEN false WHEN x.doc_id IS NOT NULL THEN true ELSE s.active END AS active
                FROM ids LEFT JOIN snapshot_docs s USING (doc_id) LEFT JOIN setter x USING (doc_id) LEFT JOIN born b USING (doc_id) LEFT JOIN gone g USING (doc_id))
        SELECT {_OUT} FROM fin"""


def _revive_sql() -> str:
    """Entry by entry: the state of a document after each of its entries."""
    new = "(x.op = 'update' OR (x.op = 'insert' AND NOT (a.there AND a.act)))"
    return f"""
        WITH {_LOG},
        ev AS (SELECT doc_id, list({{'op': op, 's': seq, 'there': false, 'act': false, 'pick': NULL::BIGINT, 'born': NULL::BIGINT}} ORDER BY seq) AS es FROM log GROUP BY doc_id),
        st AS (SELECT doc_id, [{{'op': '', 's': 0::BIGINT, 'there': s.doc_id IS NOT NULL, 'act': coalesce(s.active, false), 'pick': NULL::BIGINT, 'born': NULL::BIGINT}}] || es AS es FROM ev LEFT JOIN snapshot_docs s USING (doc_id)),
        en AS (SELECT doc_id, list_reduce(es, lambda a, x: {{'op': '', 's': 0::BIGINT, 'there': a.there OR x.op IN ('insert', 'update'),
                 'act': CASE WHEN x.op = 'delete' THEN false WHEN {new} THEN true ELSE a.act END, 'pick': CASE WHEN {new} THEN x.s ELSE a.pick END,
                 'born': CASE WHEN NOT a.there AND x.op IN ('insert', 'update') THEN x.s ELSE a.born END}}) AS e FROM st),
        ids AS (SELECT doc_id, slot, text, metadata, active, vector, false AS fresh FROM snapshot_docs
                UNION ALL SELECT doc_id, (SELECT max(slot) FROM snapshot_docs) + row_number() OVER (ORDER BY e.born), NULL, NULL, true, NULL, true FROM en WHERE e.born IS NOT NULL),
        fin AS (SELECT ids.doc_id, slot, CASE WHEN e.pick IS NULL THEN ids.text ELSE l.text END AS text, CASE WHEN e.pick IS NULL THEN ids.metadata ELSE l.metadata END AS metadata,
                  CASE WHEN e.pick IS NULL THEN ids.vector ELSE l.vector END AS vector, coalesce(e.act, ids.active) AS active
                FROM ids LEFT JOIN en USING (doc_id) LEFT JOIN log l ON l.seq = e.pick)
        SELECT {_OUT} FROM fin"""


# --- approximate search, embedding, store ----------------------------------------------------------


def _cells(spark, d, nprobe):
    index = ann.build_cells(docs(spark, d), 16)
    return _scored(ann.cell_search(index, query_row(spark, d)["query_vector"], TOP_K, nprobe, F.col("active")).withColumnRenamed("id", "doc_id"), "doc_id")


def ivf_search_batch(spark, d):
    return _scored(ann.cell_search_batch(ann.build_cells(live(spark, d), 16), search_queries(spark, d), TOP_K, 10), "query_id", "slot")


def graph_search(spark, d):
    index = graph.build_graph(docs(spark, d))
    return _scored(graph.graph_search(index, docs(spark, d), query_row(spark, d)["query_vector"], TOP_K, mask=F.col("active")).withColumnRenamed("id", "doc_id"), "doc_id")


def graph_search_batch(spark, d):
    return _scored(graph.graph_search_batch(graph.build_graph(live(spark, d)), search_queries(spark, d), TOP_K), "query_id", "slot")


def graph_masked_few(spark, d):
    """A filter that leaves little of a shard, which is then searched exactly."""
    index = graph.build_graph(docs(spark, d))
    few = docs(spark, d).filter(plans.eligible(FILTERS["filter_range"])).select("slot")
    return _scored(graph.graph_search_batch(index, search_queries(spark, d), TOP_K, mask=few), "query_id", "slot")


def graph_recall(spark, d):
    rows, asked = live(spark, d), search_queries(spark, d)
    return ann.recall(graph.graph_search_batch(graph.build_graph(rows), asked, TOP_K), knn.knn_batch(rows, asked, TOP_K))


def lsh_search(spark, d):
    return ann.lsh_search(live(spark, d), query_row(spark, d)["query_vector"], TOP_K)


def ann_recall(spark, d):
    rows, asked = live(spark, d), search_queries(spark, d)
    return ann.recall(ann.cell_search_batch(ann.build_cells(rows, 16), asked, TOP_K, 10), knn.knn_batch(rows, asked, TOP_K))


def embed_hash_udf(spark, d):
    v = embedding(F.col("text"), HashingEmbedder(64))
    return docs(spark, d).select("slot", v.alias("v")).select("slot", F.size("v").alias("dim"), F.round(V.norm(F.col("v")), 4).alias("norm"))


def snapshot_roundtrip(spark, d):
    """The collection through a store of its own: created, committed, loaded. All its values are compared, those that aren't returned too."""
    store = Store(spark, f"{_folder(spark)}/roundtrip-{uuid.uuid4().hex}")
    store.create()
    store.commit(docs(spark, d))
    return _compared(docs(spark, d).select(*DOCS.names), Store(spark, store.path).load())


def sv_roundtrip(spark, d):
    """The collection through one file of its own: written, read. All its values are compared; metadata that is no JSON object isn't representable there and becomes {}."""
    path = f"{_folder(spark)}/roundtrip-{uuid.uuid4().hex}.sv"
    meta = parsed(F.col("metadata"))
    plain = F.when(F.schema_of_variant(meta).startswith("OBJECT"), F.to_json(meta)).otherwise("{}")
    rows = stage(docs(spark, d).select("slot", "doc_id", "text", "vector", plain.alias("metadata"), "active"), "plain")
    write_sv(rows, path)
    read = read_sv(spark, path).withColumn("metadata", F.to_json(F.parse_json("metadata")))
    return _compared(rows, read)


def _folder(spark) -> str:
    at = f"{shared_dir(spark).removeprefix('file://')}/stage"
    os.makedirs(at, exist_ok=True)
    return at


def _compared(written: DataFrame, rows: DataFrame) -> DataFrame:
    written, read = written.alias("w"), rows.alias("r")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"r.{c}")) for c in DOCS.names]
    wrong = written.join(read, F.col("w.slot") == F.col("r.slot"), "full").filter(~reduce(and_, same)).count()
    if wrong:
        raise StoreError(f"{wrong} rows aren't as they were written")
    return rows.select("slot", "doc_id", "text", "active", F.size("vector").cast("long").alias("dim"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "hybrid_batch": hybrid_batch,
        "vector_norms": vector_norms,
        "knn_cosine": _knn,
        "knn_embeddings": knn_embeddings,
        "knn_l2": partial(_knn, metric="l2"),
        "knn_cosine_masked": lambda s, d: _knn(s, d, mask=compile_filters({"lang": {"$in": LANGS}}, parsed(F.col("metadata")))),
        "knn_k_exceeds_n": partial(_knn, k=1_000_000),
        "knn_zero_vector": partial(_knn, zero=True),
        "knn_batch_cosine": _batch,
        "knn_batch_l2": partial(_batch, metric="l2"),
        "knn_batch_native": partial(_batch, native=True),
        "knn_batch_filtered": partial(_batch, filters=FILTERS["filter_range"]),
        **{name: partial(_filter, name=name) for name in FILTERS},
        "tokenize": tokenize_documents,
        "term_frequency": term_frequency,
        "document_frequency": document_frequency,
        "doc_lengths": doc_lengths,
        "corpus_stats": corpus_stats,
        "idf": idf,
        "bm25_topk": _bm25,
        "bm25_repeated_term": partial(_bm25, text="budget budget budget planner"),
        "bm25_allowlist": partial(_bm25, allow=FILTERS["filter_ne"]),
        "bm25_no_match": partial(_bm25, text="zzzzqqqq", count=True),
        "bm25_params_k1_b": partial(_bm25, k1=0.9, b=0.4),
        "bm25_with_deleted": partial(_bm25, everything=True),
        "bm25_batch": bm25_batch,
        "bm25_documents": bm25_documents,
        "bm25_indexed": bm25_indexed,
        "hybrid_rrf": _hybrid,
        "hybrid_alpha0": partial(_hybrid, alpha=0.0),
        "hybrid_alpha1": partial(_hybrid, alpha=1.0),
        "hybrid_filtered": partial(_hybrid, filters=FILTERS["filter_ne"]),
        "hybrid_candidates": hybrid_candidates,
        "chunk_chars": partial(_chunks, size=500, overlap=50),
        "chunk_chars_no_overlap": partial(_chunks, size=300, overlap=0),
        "chunk_separator": partial(_chunks, size=500, overlap=50, separator="\n"),
        "chunk_by_spec": chunk_by_spec,
        "chunk_doc_ids_meta": chunk_doc_ids_meta,
        "chunk_short_text": chunk_short_text,
        **{f.__name__: f for f in (add_absent, update_rows, upsert, soft_delete, compact_renumber, wal_replay, wal_replay_revive, collection_info, get_by_id, list_active, list_records, log_lines, log_windows)},
        "ivf_search": partial(_cells, nprobe=10),
        "ivf_nprobe_all": partial(_cells, nprobe=16),
        **{f.__name__: f for f in (ivf_search_batch, graph_search, graph_search_batch, graph_masked_few, graph_recall, lsh_search, ann_recall, embed_hash_udf, snapshot_roundtrip, sv_roundtrip)},
    }
    return out


def oracle_sql() -> dict[str, str]:
    text = "(SELECT * FROM snapshot_docs WHERE active)"
    post = f"WITH p AS (SELECT slot, unnest({_TERMS}) AS term FROM {text})"
    dl = f"(SELECT slot, len({_TERMS}) AS dl FROM {text})"
    zero = "list_transform(range(64), lambda x: 0.0::DOUBLE)"
    depth = fusion.candidate_depth(TOP_K)
    with_meta = {
        "hybrid_batch": _hybrid_batch_sql(),
        "knn_cosine": _knn_sql(_COS, "DESC"),
        "knn_l2": _knn_sql(_L2, "ASC"),
        "knn_cosine_masked": _knn_sql(_COS, "DESC", filter_sql(FILTERS["filter_in"])),
        "knn_k_exceeds_n": _knn_sql(_COS, "DESC", k=1_000_000),
        "knn_zero_vector": _knn_sql(_COS, "DESC", vector=zero),
        "ivf_nprobe_all": _knn_sql(_COS, "DESC"),
        "knn_batch_cosine": _batch_sql(_COS, "DESC"),
        "knn_batch_native": _batch_sql(_COS, "DESC"),
        "knn_batch_l2": _batch_sql(_L2, "ASC"),
        "knn_batch_filtered": _batch_sql(_COS, "DESC", filter_sql(FILTERS["filter_range"])),
        "graph_masked_few": _batch_sql(_COS, "DESC", filter_sql(FILTERS["filter_range"])),
        **{n: f"SELECT {'count(*) AS n, sum(slot) AS slots' if n in ('filter_missing_key', 'filter_in_no_list', 'filter_type_mismatch') else 'slot, doc_id'} FROM meta WHERE active AND {filter_sql(f)}" for n, f in FILTERS.items()},
        "bm25_allowlist": _bm25_sql(where=f"slot IN (SELECT slot FROM meta WHERE active AND {filter_sql(FILTERS['filter_ne'])})"),
        "hybrid_rrf": _hybrid_sql(0.5),
        "hybrid_alpha0": _hybrid_sql(0.0),
        "hybrid_alpha1": _hybrid_sql(1.0),
        "hybrid_filtered": _hybrid_sql(0.5, filter_sql(FILTERS["filter_ne"])),
    }
    return {k: _with_meta(v) for k, v in with_meta.items()} | {
        "vector_norms": "SELECT slot, round(sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])), 6) AS norm FROM snapshot_docs",
        "tokenize": f"SELECT doc_id, coalesce(array_to_string({_TERMS}, ' '), '') AS terms FROM documents",
        "term_frequency": f"{post} SELECT slot, term, count(*) AS tf FROM p GROUP BY slot, term",
        "document_frequency": f"{post} SELECT term, count(DISTINCT slot) AS df FROM p GROUP BY term",
        "doc_lengths": f"SELECT * FROM {dl}",
        "corpus_stats": f"SELECT count(*) AS n_docs, sum(dl)::BIGINT AS total_tokens, round(sum(dl) / count(*), 6) AS avgdl FROM {dl}",
        "idf": f"{post} SELECT term, round(ln(1 + ((SELECT count(*) FROM {text}) - count(DISTINCT slot) + 0.5) / (count(DISTINCT slot) + 0.5)), 6) AS idf FROM p GROUP BY term",
        "bm25_topk": _bm25_sql(),
        "bm25_indexed": _bm25_sql(),
        "knn_embeddings": f"""
            WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS b FROM embeddings),
            r AS (SELECT vec_id, {_COS} AS score, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM p)
            SELECT vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= {TOP_K}""",
        "list_records": f"SELECT slot, doc_id, text, metadata, len(vector) AS dim FROM {text}",
        "bm25_repeated_term": _bm25_sql("budget budget budget planner"),
        "bm25_no_match": f"SELECT count(*) AS n FROM ({_bm25_sql('zzzzqqqq')})",
        "bm25_params_k1_b": _bm25_sql(k1=0.9, b=0.4),
        "bm25_with_deleted": _bm25_sql(corpus="snapshot_docs"),
        "bm25_batch": f"WITH {_bm25_ctes(text, 'search_queries')} SELECT query_id, slot, rank, round(score, 6) AS score FROM sparse WHERE rank <= {TOP_K}",
        "bm25_documents": f"WITH {_bm25_ctes('(SELECT doc_id AS slot, text FROM documents)', 'search_queries')} SELECT query_id, slot, rank, round(score, 6) AS score FROM sparse WHERE rank <= {TOP_K}",
        "hybrid_candidates": f"""
            WITH {_bm25_ctes(text, f"(SELECT 0 AS query_id, '{TEXT}' AS query_text)")},
            p AS (SELECT slot, vector::DOUBLE[] AS a, (SELECT query_vector::DOUBLE[] FROM search_queries WHERE query_id = {QUERY_ID}) AS b FROM {text})
            SELECT 'dense' AS leg, slot, row_number() OVER (ORDER BY {_COS} DESC, slot) AS rank FROM p QUALIFY rank <= {depth}
            UNION ALL SELECT 'sparse', slot, rank FROM sparse WHERE rank <= {depth}""",
        "chunk_chars": f"WITH {_chunk_sql('documents', 'doc_id', '500', '50')} SELECT doc_id, chunk_index, chunk FROM c",
        "chunk_chars_no_overlap": f"WITH {_chunk_sql('documents', 'doc_id', '300', '0')} SELECT doc_id, chunk_index, chunk FROM c",
        "chunk_separator": f"WITH {_packed_sql('documents', 'doc_id', '500', '50', 'chr(10)')} SELECT * FROM p",
        "chunk_by_spec": f"""
            WITH own AS (SELECT slot, text, chunk_size AS size, overlap, separator FROM snapshot_docs JOIN chunk_specs USING (coll_name)),
            windows AS (SELECT * FROM own WHERE coalesce(separator, '') = ''), packs AS (SELECT * FROM own WHERE separator <> ''),
            {_chunk_sql('windows', 'slot', 'size', 'overlap')},
            {_packed_sql('packs', 'slot', 'size', 'overlap', 'separator')}
            SELECT slot, chunk_index, chunk FROM c UNION ALL SELECT * FROM p""",
        "chunk_doc_ids_meta": f"""
            WITH {_chunk_sql('snapshot_docs', 'slot', '120', '20')}
            SELECT doc_id || '_chunk_' || chunk_index AS doc_id, doc_id AS source_doc, chunk_index, total_chunks, chunk AS text,
                   CASE WHEN json_valid(metadata) THEN json_extract_string(metadata::JSON, '$.lang') END AS lang, chunk_index AS meta_index, doc_id AS meta_source
            FROM c JOIN snapshot_docs USING (slot)""",
        "chunk_short_text": "SELECT slot, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 1 ELSE 0 END::BIGINT AS n FROM snapshot_docs",
        "add_absent": f"""
            WITH {_LOG}, new AS (SELECT * FROM log WHERE op = 'insert' AND doc_id NOT IN (SELECT doc_id FROM snapshot_docs) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1)
            SELECT {_OUT} FROM snapshot_docs UNION ALL
            SELECT (SELECT max(slot) FROM snapshot_docs) + row_number() OVER (ORDER BY seq), doc_id, text, metadata, true, len(vector) FROM new""",
        "update_rows": f"""
            WITH {_LOG}, u AS (SELECT * FROM log WHERE op = 'update' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1)
            SELECT s.slot, s.doc_id, CASE WHEN u.doc_id IS NULL THEN s.text ELSE u.text END AS text, CASE WHEN u.doc_id IS NULL THEN s.metadata ELSE coalesce(u.metadata, '{{}}') END AS metadata,
                   s.active OR u.doc_id IS NOT NULL AS active, len(CASE WHEN u.doc_id IS NULL THEN s.vector ELSE u.vector END) AS dim
            FROM snapshot_docs s LEFT JOIN u USING (doc_id)""",
        "upsert": f"""
            WITH {_LOG}, u AS (SELECT * FROM log WHERE op = 'update' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1),
            kept AS (SELECT s.* FROM snapshot_docs s WHERE active OR doc_id NOT IN (SELECT doc_id FROM u)),
            new AS (SELECT * FROM u WHERE doc_id NOT IN (SELECT doc_id FROM snapshot_docs WHERE active))
            SELECT s.slot, s.doc_id, CASE WHEN u.doc_id IS NULL THEN s.text ELSE u.text END AS text, CASE WHEN u.doc_id IS NULL THEN s.metadata ELSE coalesce(u.metadata, '{{}}') END AS metadata,
                   s.active, len(CASE WHEN u.doc_id IS NULL THEN s.vector ELSE u.vector END) AS dim
            FROM kept s LEFT JOIN u USING (doc_id)
            UNION ALL SELECT (SELECT max(slot) FROM kept) + row_number() OVER (ORDER BY seq), doc_id, text, metadata, true, len(vector) FROM new""",
        "soft_delete": f"WITH {_LOG} SELECT slot, doc_id, active AND doc_id NOT IN (SELECT doc_id FROM log WHERE op = 'delete') AS active FROM snapshot_docs",
        "compact_renumber": f"SELECT row_number() OVER (ORDER BY slot) - 1 AS slot, doc_id FROM {text}",
        "wal_replay": _replay_sql(),
        "wal_replay_revive": _revive_sql(),
        "collection_info": "SELECT count(*) AS total_count, count(*) FILTER (active) AS active_count, count(*) FILTER (NOT active) AS deleted_count, max(len(vector)) AS dimension FROM snapshot_docs",
        "get_by_id": "SELECT slot, doc_id, text FROM snapshot_docs WHERE doc_id = 'status_board' AND active",
        "list_active": f"SELECT slot, doc_id FROM {text}",
        "log_lines": """
            WITH j AS (SELECT line_no, CASE WHEN json_valid(line) AND trim(line) LIKE '{%' THEN line::JSON END AS j FROM wal_lines)
            SELECT line_no AS seq, j ->> 'op' AS op, j ->> 'doc_id' AS doc_id, j ->> 'text' AS text, CASE WHEN json_type(j, '$.vector') = 'ARRAY' THEN json_array_length(j, '$.vector') END::BIGINT AS dim
            FROM j WHERE (j ->> 'op') IS NOT NULL AND (j ->> 'doc_id') IS NOT NULL""",
        "log_windows": "SELECT strftime(logged_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, lower(op) AS op, count(*) AS n FROM wal_entries WHERE logged_at IS NOT NULL GROUP BY ALL",
        "sv_roundtrip": "SELECT slot, doc_id, text, active, len(vector) AS dim FROM snapshot_docs",
        "snapshot_roundtrip": "SELECT slot, doc_id, text, active, len(vector) AS dim FROM snapshot_docs",
    }
