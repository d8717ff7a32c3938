"""Session helpers shared by every operator: staging tables and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if it is measured and holds no more rows and bytes than these.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Folders of this process, in local mode only; deleted at its end.
_own: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back on a folder of this machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), f"vsearch-{os.getpid()}")
        if own not in _own:
            _own.add(own)
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
    return at.rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a table that outlives the executors which wrote it, so
    an expensive step is computed once however often its result is read.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/stage/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete the tables written by :func:`stage`; results that read them are void after that."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stage")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stage(df: DataFrame) -> None:
    """Delete the tables written by :func:`stage` that ``df`` reads; ``df`` is void after that."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(at))
        if path.getParent().getName() == "stage":
            path.getFileSystem(conf).delete(path, True)


def _bytes(c: Column, t: T.DataType) -> Column:
    """Bytes of a value, roughly: contents of strings and arrays, 8 for all that has a fixed size."""
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda s, x: s + _bytes(x, t.elementType)), F.lit(16).cast("long"))
        return F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 + 16
    if isinstance(t, T.MapType):
        return _bytes(F.map_keys(c), T.ArrayType(t.keyType)) + _bytes(F.map_values(c), T.ArrayType(t.valueType))
    if isinstance(t, T.StructType):
        return row_bytes([(c[f.name], f.dataType) for f in t.fields])
    return F.lit(8).cast("long")


def row_bytes(columns: list[tuple[Column, T.DataType]]) -> Column:
    total = F.lit(8).cast("long")
    for c, t in columns:
        total = total + _bytes(c, t)
    return total


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of ``most_bytes`` bytes in all; reads no more than that many rows."""
    size = row_bytes([(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= rows and held <= most_bytes


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows it, else ``df`` for a shuffled join."""
    return F.broadcast(df) if small(df, rows, most_bytes) else df


#: Bytes that a task of a shuffle shall read, about.
TASK_BYTES = 64 << 20


def partitions(spark: SparkSession, total_bytes: int) -> int:
    """How many tasks a shuffle of so many bytes takes: the session's number, or more where these would be too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // TASK_BYTES))


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, unless it is installed or on their path."""
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in known or "site-packages" in root or getattr(context, "_vsearch_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="vsearch-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = os.path.join(folder, "vsearch.zip")
    with zipfile.PyZipFile(at, "w") as z:  # compiled, subpackages included
        z.writepy(here)
    context.addPyFile(at)
    context._vsearch_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
