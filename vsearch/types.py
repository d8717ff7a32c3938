"""Errors and schemas shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T


class VsearchError(Exception):
    """Base of all errors raised here."""


class StoreError(VsearchError):
    """A write that breaks the rules of a collection, or a store that can't be read."""


class RequestError(VsearchError):
    """A search request that can't be answered."""


class VectorError(VsearchError):
    """A vector, metric or index that doesn't fit."""


class ChunkError(VsearchError):
    """Chunk sizes that contradict each other."""


class SourceError(VsearchError):
    """A file that can't be read as text."""


class EmbedError(VsearchError):
    """A text that can't be embedded, or an embedder that is missing."""


#: A committed collection. ``slot`` is the insertion order and breaks all ties; ``metadata`` is JSON.
DOCS = T.StructType(
    [
        T.StructField("slot", T.LongType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("active", T.BooleanType(), False),
    ]
)

#: One entry of the write-ahead log.
LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StringType()),
    ]
)
