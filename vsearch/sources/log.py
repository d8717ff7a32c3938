"""The write-ahead log: JSON lines of {op, doc_id, text?, vector?, metadata?}."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vsearch.operators.numbering import dense_number

_LINE = "op string, doc_id string, text string, vector array<float>, metadata string, _bad string"


def parsed_line(line: Column) -> Column:
    """Struct of a line's fields; NULL if the line isn't exactly one JSON object or lacks op or doc_id.

    Blank, cut-off and run-on lines are such lines; white space around is fine.
    """
    one_value = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1
    fields = F.from_json(line, _LINE, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    whole = one_value & F.trim(line).startswith("{") & fields["_bad"].isNull() & fields["op"].isNotNull() & fields["doc_id"].isNotNull()
    return F.when(whole, F.struct(*[fields[c].alias(c) for c in ("op", "doc_id", "text", "vector", "metadata")]))


def parse_lines(lines: DataFrame, line: str = "line", seq: str = "line_no") -> DataFrame:
    """Log entries (seq, op, doc_id, text, vector, metadata) of the lines that can be read."""
    return lines.select(F.col(seq).cast("long").alias("seq"), parsed_line(F.col(line)).alias("e")).filter("e IS NOT NULL").select("seq", "e.*")


def numbered(lines: DataFrame) -> DataFrame:
    """(line_no, line) of rows (file_path, file_block_start, line): dense numbers in the order of (number in the file's name, block, line).

    A file without a number in its name comes last. Files of any size are read
    in blocks, so a line's place is that of its block and its place in it.
    """
    number = F.coalesce(F.try_to_number(F.regexp_extract("file_path", r"(\d+)[^/\d]*$", 1), F.lit("9" * 18)).cast("long"), F.lit((1 << 63) - 1))
    rows = lines.withColumns({"_number": number, "_nth": F.monotonically_increasing_id()})
    return dense_number(rows, ["_number", "file_path", "file_block_start", "_nth"], "line_no").select("line_no", "line")


def log_lines(rows: DataFrame) -> DataFrame:
    """What :func:`numbered` needs of lines read as text."""
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("file_block_start"), F.col("value").alias("line"))


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Log entries of files or a folder of segments, ordered by (number in the file's name, line)."""
    return parse_lines(numbered(log_lines(spark.read.text(path))))


#: A segment is closed when it has so many bytes.
SEGMENT_BYTES = 16 << 20


class LogWriter:
    """Appends entries to a log folder of numbered segments; one writer at a time.

    A single entry is appended to the open segment; several at once are a
    segment of their own, which appears whole or not at all. Either is synced
    before the call returns. A writer begins a new segment, so a line that a
    crash has cut off is no other's begin.
    """

    def __init__(self, path: str):
        self.path = path
        self._open: int | None = None
        self._next: int | None = None

    def _numbers(self) -> list[int]:
        return sorted(int(f.split(".")[0]) for f in os.listdir(self.path) if f.endswith(".jsonl")) if os.path.isdir(self.path) else []

    def _file(self, number: int) -> str:
        return os.path.join(self.path, f"{number:012d}.jsonl")

    def next_number(self) -> int:
        """That of the next new segment; whatever is appended later goes there or beyond."""
        self._open = None
        if self._next is None:
            self._next = max(self._numbers(), default=0) + 1
        return self._next

    def _new(self) -> int:
        number = self.next_number()
        self._next = number + 1
        return number

    def append(self, entries: list[dict[str, Any]]) -> None:
        for e in entries:
            if e.get("op") not in ("insert", "update", "delete") or not e.get("doc_id"):
                raise ValueError("an entry needs an op and a doc_id")
        if not entries:
            return
        body = "".join(json.dumps({k: v for k, v in e.items() if v is not None}, ensure_ascii=False) + "\n" for e in entries).encode("utf-8")
        os.makedirs(self.path, exist_ok=True)
        if len(entries) > 1:
            at = self._file(self._new())
            self._write(at + ".tmp", body)
            os.replace(at + ".tmp", at)
            return
        if self._open is None:
            self._open = self._new()
        at = self._file(self._open)
        self._write(at, body)
        if os.path.getsize(at) >= SEGMENT_BYTES:
            self._open = None

    @staticmethod
    def _write(at: str, body: bytes) -> None:
        with open(at, "ab") as f:
            f.write(body)
            f.flush()
            os.fsync(f.fileno())

    def _segments(self, since: int = 0) -> list[str]:
        return [self._file(n) for n in self._numbers() if n >= since]

    def has_entries(self, since: int = 0) -> bool:
        return self.size(since) > 0

    def size(self, since: int = 0) -> int:
        return sum(map(os.path.getsize, self._segments(since)))

    def read(self, spark: SparkSession, since: int = 0) -> DataFrame:
        """Entries of the segments from number ``since`` on."""
        files = self._segments(since)
        return read_log(spark, files) if files else parse_lines(spark.createDataFrame([], "line_no long, line string"))

    def truncate(self, before: int | None = None) -> None:
        """Delete the segments, or those below number ``before``."""
        self.next_number()  # numbers aren't used again
        for n in self._numbers():
            if before is None or n < before:
                os.remove(self._file(n))
