"""Text functions as Columns: terms, stripping, chunks. Lengths and positions are in characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vsearch.types import ChunkError

#: A term is a maximal run of letters, digits and "_".
TERM_PATTERN = r"[\p{L}\p{N}_]+"
_SPACE = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"


def tokenize(text: Column) -> Column:
    """Lower-cased terms in order; none for NULL or blank text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, F.lit(_SPACE), F.lit(""))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?U)^[\s\x{1c}-\x{1f}]+"), F.lit(""))


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x{1c}-\x{1f}]")


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise ChunkError("chunk_size must be positive")
    if overlap < 0:
        raise ChunkError("overlap must not be negative")
    if overlap >= size:
        raise ChunkError("overlap must be below chunk_size")


def _window_chunks(text: Column, size: Column, overlap: Column) -> Column:
    """Windows of ``size`` every ``size - overlap`` characters; blank ones are left out."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, size - overlap)
    return F.filter(F.transform(starts, lambda i: F.substring(text, i + 1, size)), lambda c: ~blank(c))


def _packed_chunks(text: Column, size: Column, overlap: Column, separator: Column) -> Column:
    """Stripped segments packed up to ``size``; a new chunk begins with the last ``overlap`` characters of the one before. Oversized segments stay whole."""
    quoted = F.concat(F.lit("\\Q"), F.replace(separator, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    segments = F.filter(F.transform(F.split(text, quoted, -1), strip), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def step(acc: Column, seg: Column) -> Column:
        joined = strip(F.concat(acc["open"], separator, seg))
        return (
            F.when(acc["open"] == "", F.struct(acc["out"].alias("out"), seg.alias("open")))
            .when(F.length(joined) <= size, F.struct(acc["out"].alias("out"), joined.alias("open")))
            .otherwise(
                F.struct(
                    F.array_append(acc["out"], acc["open"]).alias("out"),
                    F.when(overlap > 0, F.concat(F.right(acc["open"], overlap), separator, seg)).otherwise(seg).alias("open"),
                )
            )
        )

    return F.aggregate(segments, start, step, lambda acc: F.when(acc["open"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["open"])))


def chunks(text: Column, size: int | Column = 500, overlap: int | Column = 50, separator: str | Column | None = None) -> Column:
    """Chunks of a text, in order: none of a blank one, the text itself if it fits.

    Sizes and separator may be columns; a NULL separator means windows of
    characters. Sizes given as numbers are checked.
    """
    if isinstance(size, int) and isinstance(overlap, int):
        check_sizes(size, overlap)
    size_c = size if isinstance(size, Column) else F.lit(size)
    overlap_c = overlap if isinstance(overlap, Column) else F.lit(overlap)
    if separator is None or isinstance(separator, str) and separator == "":
        cut = _window_chunks(text, size_c, overlap_c)
    elif isinstance(separator, str):
        cut = _packed_chunks(text, size_c, overlap_c, F.lit(separator))
    else:
        cut = F.when(separator.isNull() | (separator == ""), _window_chunks(text, size_c, overlap_c)).otherwise(_packed_chunks(text, size_c, overlap_c, separator))
    return F.when(blank(text), F.array().cast("array<string>")).when(F.length(text) <= size_c, F.array(text)).otherwise(cut)
