"""Documents to chunk records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vsearch.functions.text import chunks


def chunk_documents(
    docs: DataFrame, size: int | Column = 500, overlap: int | Column = 50, separator: str | Column | None = None, prefix: str = "doc_id", text: str = "text", metadata: str | None = "metadata",
) -> DataFrame:
    """(doc_id, text, metadata, chunk_index, total_chunks, source_doc), one row a chunk.

    Chunk ids are ``<prefix>_chunk_<i>``; metadata is JSON, the document's keys
    with those of the chunk put over them. NULL or broken metadata counts as
    empty; blank documents give no rows. Nothing is shuffled.
    """
    base = F.col(metadata) if metadata else F.lit(None).cast("string")
    cut = docs.select(F.col(prefix).alias("source_doc"), base.alias("_meta"), chunks(F.col(text), size, overlap, separator).alias("_chunks"))
    rows = cut.select("source_doc", "_meta", F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "text"))
    mine = F.to_json(F.struct("chunk_index", "total_chunks", "source_doc"))
    return rows.select(
        F.concat("source_doc", F.lit("_chunk_"), "chunk_index").alias("doc_id"), "text", merge_json(F.col("_meta"), mine).alias("metadata"), "chunk_index", "total_chunks", "source_doc"
    )


def merge_json(base: Column, over: Column) -> Column:
    """Two JSON objects as one, the second winning; a base that is no object counts as empty."""
    b = F.try_parse_json(base)
    held = F.from_json(F.when(F.schema_of_variant(b).startswith("OBJECT"), F.to_json(b)), "map<string,variant>")
    top = F.from_json(over, "map<string,variant>")
    kept = F.map_filter(F.coalesce(held, F.create_map().cast("map<string,variant>")), lambda k, _: ~F.map_contains_key(top, k))
    return F.to_json(F.to_variant_object(F.map_concat(kept, top)))
