from pyspark.sql import functions as F

from vsearch.runtime import broadcast_if_small, partitions, small


def test_small_counts_rows_and_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.struct("id", F.lit("y").alias("s"))).alias("a"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    assert small(df) and small(df, 100) and not small(df, 99)
    assert small(df, 100, 150_000) and not small(df, 100, 90_000)
    assert small(df.limit(0), 0, 0) and small(spark.createDataFrame([(None, None)], "s string, a array<string>"))


def test_hint_follows_size(spark):
    a, b = spark.range(10), spark.range(10)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(a.join(broadcast_if_small(b, 10), "id"))
    assert "broadcast" not in plan(a.join(broadcast_if_small(b, 9), "id"))


def test_partitions_follow_the_input(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions(spark, 0) == partitions(spark, 1 << 20) == least and partitions(spark, 64 << 30) == 1024
