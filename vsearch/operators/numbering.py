"""Dense numbers over a whole DataFrame without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vsearch.runtime import stage


def dense_number(df: DataFrame, by: list[Column | str], name: str, start: int | Column = 0) -> DataFrame:
    """``df`` with ``name`` = start, start + 1, ... in the order of ``by``.

    Rows are range-partitioned and numbered within their partition; a
    partition's offset is the count of those before, one row a partition.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in by]
    # the id of a row is its partition times 2**33 plus its place in it
    ranged = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright(F.col("_at"), 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    first = start if isinstance(start, Column) else F.lit(start)
    return ranged.withColumn("_part", part).join(offsets, "_part").withColumn(name, first + F.col("_before") + place).drop("_at", "_part", "_before")
