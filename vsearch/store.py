"""Versioned snapshots in a folder: each commit writes a new Parquet version, then moves a pointer to it."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vsearch.operators import mutate
from vsearch.runtime import stage
from vsearch.sources.log import LogWriter
from vsearch.types import DOCS, StoreError


@dataclass
class Meta:
    version: int
    dimension: int | None
    metric: str
    index_type: str
    data: str | None
    batch: int = -1  # the last streamed batch that the data holds
    log_from: int = 0  # the first log segment that the data doesn't hold


class Store:
    """One writer at a time; readers keep the version they opened.

    ``path`` is a folder that driver and executors share. A commit is one
    rename of the pointer file, so a crash leaves either version whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log = LogWriter(os.path.join(path, "log"))

    @property
    def _pointer(self) -> str:
        return os.path.join(self.path, "CURRENT")

    def exists(self) -> bool:
        return os.path.isfile(self._pointer)

    def meta(self) -> Meta:
        if not self.exists():
            raise StoreError(f"no collection at {self.path}")
        with open(self._pointer, encoding="utf-8") as f:
            return Meta(**json.load(f))

    def create(self, dimension: int | None = None, metric: str = "cosine", index_type: str = "flat", overwrite: bool = False) -> None:
        if self.exists() and not overwrite:
            raise StoreError(f"a collection exists at {self.path}")
        if dimension is not None and dimension < 1:
            raise StoreError("dimension must be at least 1")
        if not self.exists() and os.path.isdir(self.path) and set(os.listdir(self.path)) - {"log"}:
            raise StoreError(f"{self.path} holds something else than a collection")
        os.makedirs(self.path, exist_ok=True)
        if self.exists():  # its versions stay until they are vacuumed
            since = self.log.next_number()
            self._point(Meta(self.meta().version + 1, dimension, metric, index_type, None, log_from=since))
            self.log.truncate(since)
        else:
            self._point(Meta(0, dimension, metric, index_type, None))

    def _point(self, meta: Meta) -> None:
        at = f"{self._pointer}.{uuid.uuid4().hex}"
        with open(at, "w", encoding="utf-8") as f:
            json.dump(meta.__dict__, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(at, self._pointer)

    def load(self) -> DataFrame:
        meta = self.meta()
        if meta.data is None:
            return self.spark.createDataFrame([], DOCS)
        return self.spark.read.schema(DOCS).parquet(os.path.join(self.path, meta.data))

    def commit(self, docs: DataFrame, dimension: int | None = None, batch: int | None = None, truncate: bool = True, metric: str | None = None, index_type: str | None = None) -> int:
        """Write ``docs`` as the next version and, unless told otherwise, empty the log, whose entries it holds.

        The pointer moves when the data is written, and names the first log
        segment that counts from then on: after a crash no entry is applied twice.
        """
        meta = self.meta()
        version = meta.version + 1
        since = self.log.next_number() if truncate else meta.log_from
        data = f"v{version:08d}-{uuid.uuid4().hex[:8]}"
        docs.select(*DOCS.names).write.option("compression", "zstd").parquet(os.path.join(self.path, data))
        self._point(Meta(version, dimension or meta.dimension, metric or meta.metric, index_type or meta.index_type, data, meta.batch if batch is None else batch, since))
        if truncate:
            self.log.truncate(since)
        return version

    def has_log(self) -> bool:
        """Whether the log holds entries that the data doesn't."""
        return self.log.has_entries(self.meta().log_from if self.exists() else 0)

    def recover(self) -> DataFrame:
        """The snapshot with the log applied; if the log holds entries, the result is committed."""
        docs = self.load()
        if not self.has_log():
            return docs
        whole = stage(mutate.replay(docs, self.log.read(self.spark, self.meta().log_from), revive=True), "recovered")
        self.commit(whole, self.meta().dimension or whole.agg(F.max(F.size("vector"))).first()[0])
        return self.load()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` versions; returns their names."""
        versions = sorted(d for d in os.listdir(self.path) if re.fullmatch(r"v\d{8}-[0-9a-f]{8}", d))
        gone = [d for d in versions[:-keep] if d != self.meta().data]
        for d in gone:
            shutil.rmtree(os.path.join(self.path, d))
        return gone

    def size(self) -> int:
        return sum(os.path.getsize(os.path.join(a, f)) for a, _, fs in os.walk(self.path) for f in fs)
