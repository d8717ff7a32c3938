"""Structured Streaming: log files into a store, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vsearch.operators import mutate
from vsearch.sources.log import log_lines, numbered, parse_lines
from vsearch.store import Store


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of the log files that arrive in ``path``, with the file and block they come from. A file must be complete when it arrives."""
    return log_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def ingest(stream: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a stream of log lines to ``store``, a commit a batch, in the order of (number in the file's name, line); unreadable lines are left out.

    The pointer remembers the last batch, so one that is run again after a
    failure changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if number > store.meta().batch:
            entries = parse_lines(numbered(batch))
            store.commit(mutate.replay(store.load(), entries, revive=True), batch=number, truncate=False)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def op_counts(entries: DataFrame, time: str = "logged_at", window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(start, op, n) of entries per window of event time; those later than ``late`` are dropped by the watermark. For streams and tables."""
    return entries.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.lower("op").alias("op")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "op", "n")
