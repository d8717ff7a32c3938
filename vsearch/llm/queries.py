"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vsearch.llm import contamination, mixing, near_dup, salience, sentences, splitting, template, vector_graph
from vsearch.llm.entries import entry_texts
from vsearch.runtime import table


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    return splitting.with_specs(table(spark, d, "wal_entries").filter(F.col("text").isNotNull()), table(spark, d, "chunk_specs"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(_oversized(spark, d), "seq", with_text=False)
    forced = F.max(F.col("piece_kind") == "forced")
    return pieces.groupBy(F.col("id").alias("seq")).agg(F.when(forced, "forced").otherwise("natural").alias("cut_kind"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    texts = entry_texts(table(spark, d, "wal_entries"), keep=("coll_name",))
    return splitting.split_oversized(splitting.with_specs(texts, table(spark, d, "chunk_specs"))).withColumnRenamed("id", "seq")


def p1_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized text put together from its pieces without what they repeat; whether none is too long, and each after the first repeats the overlap."""
    texts = splitting.with_specs(entry_texts(table(spark, d, "wal_entries"), keep=("coll_name",)), table(spark, d, "chunk_specs"))
    pieces = splitting.split_oversized(texts)
    part = F.struct("piece_no", F.expr("substring(piece, overlap_len + 1)").alias("fresh"))
    whole = pieces.groupBy("id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max(F.length("piece")).alias("longest"), F.max("overlap_len").alias("most"), F.min(F.when(F.col("piece_no") > 0, F.col("overlap_len"))).alias("least"))
    fits = (F.col("longest") <= F.col("chunk_size")) & (F.col("most") == F.col("overlap")) & (F.col("least") == F.col("overlap"))
    return whole.join(texts.select("id", "chunk_size", "overlap"), "id").select(F.col("id").alias("seq"), F.concat_ws("", F.transform("parts", lambda x: x["fresh"])).alias("text"), fits.alias("fits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    scored = salience.term_scores(table(spark, d, "wal_entries"))
    return scored.filter("tf >= 3 AND df BETWEEN 2 AND 6").select(F.col("id").alias("seq"), "term")


def p2_term_scores(spark: SparkSession, d: str) -> DataFrame:
    return salience.term_scores(table(spark, d, "wal_entries")).withColumnRenamed("id", "seq")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = vector_graph.similar_vectors(table(spark, d, "wal_entries"), k=5, least=0.90, recall=0.99, beam=32)
    return near.select(F.least("id", "neighbour").alias("seq_a"), F.greatest("id", "neighbour").alias("seq_b")).distinct()


def p3_knn(spark: SparkSession, d: str) -> DataFrame:
    """Every entry whose seq is divisible by 50, against all entries in all shards."""
    near = vector_graph.similar_vectors(table(spark, d, "wal_entries"), k=5, recall=1, ask="id % 50 = 0", beam=64)
    return near.select(F.col("id").alias("seq"), "rank", F.col("neighbour").alias("neighbour_seq"), F.round("similarity", 6).alias("similarity"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_dup.expanded(*near_dup.near_duplicates(table(spark, d, "wal_entries")))
    return pairs.select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.groups(*near_dup.near_duplicates(table(spark, d, "wal_entries"))).withColumnsRenamed({"id": "seq", "rep": "class_id"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return template.markup_kinds(table(spark, d, "wal_entries")).select(F.col("id").alias("seq"), F.explode("kinds").alias("markup"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return template.clean_texts(table(spark, d, "wal_entries")).withColumnRenamed("id", "seq")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("id").alias("doc_id"), F.explode("items").alias("item_id"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return contamination.without_spans(table(spark, d, "documents"), _leaks(spark, d)).withColumnRenamed("id", "doc_id")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0].withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_targets(spark: SparkSession, d: str) -> DataFrame:
    """What the report says of each target, and whether its source is repeated no more than it may be."""
    report = p7_report(spark, d)
    kept = (F.col("most_copies") <= F.col("max_repeats")) & (F.col("actual_tokens") <= F.col("source_tokens") * F.col("max_repeats"))
    return report.select("plan_id", "source", F.round("target_share", 9).alias("target_share"), F.round("target_tokens", 3).alias("target_tokens"), kept.alias("kept"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"), with_text=False).select(F.col("id").alias("doc_id"), "end_pos")


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


_ENTRIES = "entries AS (SELECT seq, min(coll_name) AS coll_name, min(text) AS text FROM wal_entries WHERE text IS NOT NULL AND seq IS NOT NULL GROUP BY seq)"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
            WITH {_ENTRIES},
            big AS (SELECT seq, text, chunk_size FROM entries JOIN chunk_specs USING (coll_name) WHERE length(text) > chunk_size)
            SELECT seq, CASE WHEN list_max(list_transform(string_split_regex(text, '[ \\t\\n\\x{{00A0}}\\x{{3000}}。！？]'), lambda x: length(x))) > chunk_size
                        THEN 'forced' ELSE 'natural' END AS cut_kind
            FROM big""",
        "p1_tiles": f"WITH {_ENTRIES} SELECT seq, text, true AS fits FROM entries JOIN chunk_specs USING (coll_name) WHERE length(text) > chunk_size",
        "p7_targets": """
            WITH t AS (SELECT plan_id, lower(trim(source)) AS source, sum(greatest(coalesce(target_weight, 0), 0)) AS w, max(total_tokens) AS total FROM mix_targets GROUP BY ALL),
            s AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY plan_id) > 0 THEN w / sum(w) OVER (PARTITION BY plan_id) ELSE 0 END AS share FROM t)
            SELECT plan_id, source, round(share, 9) AS target_share, round(share * total, 3) AS target_tokens, true AS kept FROM s""",
        "p2_found": f"""
            WITH {_ENTRIES},
            tok AS (SELECT seq, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM entries),
            post AS (SELECT seq, term, count(*) AS tf FROM tok GROUP BY seq, term),
            terms AS (SELECT term, count(*) AS n FROM post GROUP BY term)
            SELECT seq, term FROM post JOIN terms USING (term) WHERE tf >= 3 AND n BETWEEN 2 AND 6""",
        "p6_found": """
            WITH doc AS (SELECT doc_id, ' ' || list_aggregate(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 'string_agg', ' ') || ' ' AS s FROM documents WHERE text IS NOT NULL),
            item AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM eval_items WHERE text IS NOT NULL),
            gram AS (SELECT DISTINCT item_id, ' ' || list_aggregate(t[i : i + least(len(t), 12) - 1], 'string_agg', ' ') || ' ' AS g
                     FROM item, range(1, 100000) r(i) WHERE len(t) > 0 AND i <= len(t) - least(len(t), 12) + 1)
            SELECT DISTINCT doc_id, item_id FROM doc JOIN gram ON contains(s, g)""",
        "p4_found": f"""
            WITH {_ENTRIES},
            tok AS (SELECT seq, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM entries),
            sh AS (SELECT DISTINCT seq, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS s FROM tok WHERE len(t) >= 20),
            n AS (SELECT seq, count(*) AS n FROM sh GROUP BY seq),
            c AS (SELECT x.seq AS seq_a, y.seq AS seq_b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.seq < y.seq GROUP BY x.seq, y.seq)
            SELECT seq_a, seq_b FROM c JOIN n p ON p.seq = seq_a JOIN n q ON q.seq = seq_b WHERE c * 5 >= 3 * (p.n + q.n - c)""",
    }
