"""A collection as an object: add, change, search, commit."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vsearch.embed import Embedder, HashingEmbedder
from vsearch.operators import ann, graph, mutate
from vsearch.operators.knn import check_metric
from vsearch.plans import search as plans
from vsearch.runtime import ship, stage
from vsearch.store import Store
from vsearch.types import DOCS, LOG, RequestError, StoreError, VectorError

INDEX_TYPES = ("flat", "cells", "hnsw")
#: Ids of a batch are looked up in blocks of so many.
ID_BLOCK = 10_000


@dataclass
class Hit:
    doc_id: str
    text: str
    score: float
    metadata: dict[str, Any]

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def _json(metadata: Mapping[str, Any] | None) -> str:
    try:
        return json.dumps(dict(metadata or {}), ensure_ascii=False)
    except TypeError as e:
        raise StoreError(f"metadata must be JSON: {e}") from e


class Collection:
    """Documents with vectors and metadata, in memory or in a :class:`Store`.

    Changes are checked, logged and kept until a search or commit applies them
    together, as one plan. For bulk loads use :meth:`add_frame`.
    """

    def __init__(
        self, spark: SparkSession | None = None, path: str | None = None, embedder: Embedder | None = None, metric: str = "cosine", index_type: str = "flat", dimension: int | None = None, cells: int | None = None,
        m: int = graph.M, ef_construction: int = graph.EF_CONSTRUCTION, ef_search: int = graph.EF_SEARCH,
    ):
        check_metric(metric)
        if index_type not in INDEX_TYPES:
            raise VectorError(f"index_type must be one of {INDEX_TYPES}")
        self.spark = spark or SparkSession.builder.getOrCreate()
        ship(self.spark)
        self.embedder = embedder or HashingEmbedder(dimension or 384)
        self.metric, self.index_type, self.cells = metric, index_type, cells
        self.m, self.ef_construction, self.ef_search = m, ef_construction, ef_search
        self.store = Store(self.spark, path) if path else None
        self._dimension = dimension
        self._pending: list[tuple] = []
        self._known: dict[str, bool] = {}  # state of the ids that pending changes touch
        self._index: tuple[int, ann.CellIndex | graph.GraphIndex] | None = None
        self._changes = 0
        if self.store and self.store.exists():
            meta = self.store.meta()
            self.metric, self.index_type, self._dimension = meta.metric, meta.index_type, meta.dimension or dimension
            self._base = self.store.recover()
        else:
            if self.store:
                self.store.create(dimension, metric, index_type)
                if self.store.has_log():
                    self._base = self.store.recover()
            self._base = self.store.load() if self.store else self.spark.createDataFrame([], DOCS)

    # --- state ---------------------------------------------------------------

    @property
    def docs(self) -> DataFrame:
        """All rows, deleted ones too, with the pending changes applied."""
        if self._pending:
            log = self.spark.createDataFrame(self._pending, LOG)
            self._set(mutate.replay(self._base, log, revive=True))
        return self._base

    def _set(self, docs: DataFrame) -> None:
        self._base = stage(docs.select(*DOCS.names), "collection")
        self._pending, self._known = [], {}
        self._changes += 1

    def _state(self, doc_id: str) -> bool | None:
        """True: active, False: deleted, None: absent."""
        if doc_id not in self._known:
            row = self._base.filter(F.col("doc_id") == doc_id).select("active").first()
            self._known[doc_id] = row[0] if row else None
        return self._known[doc_id]

    def _log(self, op: str, rows: Sequence[tuple]) -> None:
        """Rows of (doc_id[, text, vector, metadata]); all of them are logged or none."""
        rows = [(*r, None, None, None)[:4] for r in rows]
        if self.store:
            self.store.log.append([{"op": op, "doc_id": i, "text": t, "vector": v, "metadata": None if m is None else json.loads(m)} for i, t, v, m in rows])
        for row in rows:
            self._pending.append((len(self._pending), op, *row))
            self._known[row[0]] = op != "delete"

    def _vector(self, text: str, vector: Sequence[float] | None) -> list[float]:
        v = np.asarray(self.embedder.embed_batch([text])[0] if vector is None else vector, np.float32)
        if v.ndim != 1:
            raise StoreError("a vector must have one dimension")
        if self._dimension is None:
            self._dimension = len(v)
        if len(v) != self._dimension:
            raise StoreError(f"the vector has {len(v)} elements, the collection's have {self._dimension}")
        if not np.isfinite(v).all():
            raise StoreError("a vector's elements must be finite")
        return [float(x) for x in v]

    @property
    def dimension(self) -> int | None:
        return self._dimension

    # --- changes -------------------------------------------------------------

    def add(self, doc_id: str, text: str, metadata: Mapping[str, Any] | None = None, vector: Sequence[float] | None = None) -> str:
        """Append a document; an id that exists, even deleted, is an error."""
        v, m = self._vector(text, vector), _json(metadata)
        if self._state(doc_id) is not None:
            raise StoreError(f"doc_id {doc_id!r} exists")
        self._log("insert", [(doc_id, text, v, m)])
        return doc_id

    def insert(self, doc_id: str, text: str, metadata: Mapping[str, Any] | None = None, vector: Sequence[float] | None = None) -> bool:
        self.add(doc_id, text, metadata, vector)
        return True

    def add_many(self, documents: Sequence[Mapping[str, Any]]) -> list[str]:
        """Append dicts of doc_id, text and metadata: all of them or, on any error, none."""
        for i, d in enumerate(documents):
            if "doc_id" not in d or "text" not in d:
                raise StoreError(f"document {i} lacks doc_id or text")
        ids = [d["doc_id"] for d in documents]
        if len(set(ids)) < len(ids):
            raise StoreError("a doc_id comes twice")
        there = [i for i in ids if self._known.get(i) is not None]
        for at in range(0, len(ids), ID_BLOCK):
            if there:
                break
            asked = self.spark.createDataFrame([(i,) for i in ids[at : at + ID_BLOCK]], "doc_id string")
            there = [r[0] for r in self._base.join(F.broadcast(asked), "doc_id", "left_semi").select("doc_id").take(1)]
        if there:
            raise StoreError(f"doc_id {there[0]!r} exists")
        if not ids:
            return []
        vectors = self.embedder.embed_batch([d["text"] for d in documents])
        rows = [(d["doc_id"], d["text"], self._vector(d["text"], v), _json(d.get("metadata"))) for d, v in zip(documents, vectors)]
        self._log("insert", rows)
        return ids

    def add_frame(self, rows: DataFrame) -> None:
        """Append a DataFrame (doc_id, text[, vector, metadata]) of any size; texts without a vector are embedded by the executors."""
        from vsearch.embed import embed_documents

        rows = embed_documents(rows, self.embedder)
        if "metadata" not in rows.columns:
            rows = rows.withColumn("metadata", F.lit("{}"))
        rows = stage(rows.select("doc_id", "text", F.col("vector").cast("array<float>").alias("vector"), "metadata", F.col("doc_id").alias("seq")), "incoming")
        sizes = [r[0] for r in rows.select(F.size("vector")).distinct().limit(2).collect()]
        if len(sizes) > 1 or sizes and self._dimension not in (None, sizes[0]):
            raise StoreError("vectors differ in length")
        self._dimension = self._dimension or (sizes[0] if sizes else None)
        self._set(mutate.add(self.docs, rows))

    def update(self, doc_id: str, text: str, metadata: Mapping[str, Any] | None = None, vector: Sequence[float] | None = None) -> str:
        """Replace a document whole; a deleted one becomes active, an absent one is an error."""
        v, m = self._vector(text, vector), _json(metadata)
        if self._state(doc_id) is None:
            raise StoreError(f"doc_id {doc_id!r} doesn't exist")
        self._log("update", [(doc_id, text, v, m)])
        return doc_id

    def upsert(self, doc_id: str, text: str, metadata: Mapping[str, Any] | None = None, vector: Sequence[float] | None = None) -> str:
        """Update an active document, else add it, a deleted one anew at the end."""
        state = self._state(doc_id)
        if state:
            return self.update(doc_id, text, metadata, vector)
        if state is None:
            return self.add(doc_id, text, metadata, vector)
        v, m = self._vector(text, vector), _json(metadata)
        if self.store:
            self.store.log.append([{"op": "insert", "doc_id": doc_id, "text": text, "vector": v, "metadata": json.loads(m)}])
        self._set(mutate.upsert(self.docs, self.spark.createDataFrame([(0, doc_id, text, v, m)], "seq long, doc_id string, text string, vector array<float>, metadata string")))
        return doc_id

    def delete(self, doc_id: str) -> bool:
        """False if it is deleted already; an absent id is an error."""
        state = self._state(doc_id)
        if state is None:
            raise StoreError(f"doc_id {doc_id!r} doesn't exist")
        if state:
            self._log("delete", [(doc_id,)])
        return state

    def compact(self) -> int:
        """Drop deleted documents; returns how many."""
        docs = self.docs
        gone = docs.filter(~F.col("active")).count()
        if gone:
            self._set(mutate.compact(docs))
        return gone

    def clear(self) -> None:
        self._set(self.spark.createDataFrame([], DOCS))

    # --- persistence ---------------------------------------------------------

    def commit(self) -> int:
        """Write the next version of the store; returns its number."""
        if not self.store:
            raise StoreError("an in-memory collection has nowhere to commit to")
        version = self.store.commit(self.docs, self._dimension)
        self._base = self.store.load()
        return version

    def save(self, path: str | None = None) -> None:
        """Commit or, with another ``path``, write a copy there; this collection stays where it is.

        A collection that is there already gets the copy as its next version.
        A folder that holds anything else is an error.
        """
        if path is None or self.store and os.path.realpath(path) == os.path.realpath(self.store.path):
            self.commit()
            return
        other = Store(self.spark, path)
        if not other.exists():
            other.create(self._dimension, self.metric, self.index_type)
        other.commit(self.docs, self._dimension, metric=self.metric, index_type=self.index_type)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None, embedder: Embedder | None = None) -> Collection:
        spark = spark or SparkSession.builder.getOrCreate()
        if not Store(spark, path).exists():
            raise StoreError(f"no collection at {path}")
        return cls(spark, path, embedder)

    # --- search --------------------------------------------------------------

    def index(self) -> ann.CellIndex | graph.GraphIndex | None:
        """The index of the present documents; rebuilt when they changed. None for flat search."""
        docs = self.docs
        if self.index_type == "flat" or docs.isEmpty():
            return None
        if self._index is None or self._index[0] != self._changes:
            version = str(self._changes)
            made = ann.build_cells(docs, self.cells, self.metric, version) if self.index_type == "cells" else graph.build_graph(docs, self.metric, self.m, self.ef_construction, version=version)
            self._index = (self._changes, made)
        return self._index[1]

    def _query_vector(self, query: str | Sequence[float]) -> list[float]:
        if isinstance(query, str):
            plans.check_query(query)
            query = self.embedder.embed_batch([query])[0]
        v = [float(x) for x in query]
        if self._dimension is not None and len(v) != self._dimension:
            raise RequestError(f"the query has {len(v)} elements, the collection's vectors have {self._dimension}")
        return v

    def _hits(self, found: DataFrame) -> list[Hit]:
        return [Hit(r["doc_id"], r["text"], r["score"], json.loads(r["metadata"] or "{}")) for r in found.collect()]

    def search(self, query: str | Sequence[float], top_k: int = 5, filters: Mapping[str, Any] | None = None) -> list[Hit]:
        return self._hits(plans.search(self.docs, self._query_vector(query), top_k, filters, self.metric, self.index(), self.ef_search))

    def search_batch(self, queries: Sequence[str | Sequence[float]], top_k: int = 5, filters: Mapping[str, Any] | None = None) -> list[list[Hit]]:
        if not len(queries):
            return []
        asked = self.spark.createDataFrame([(i, self._query_vector(q)) for i, q in enumerate(queries)], "query_id int, query_vector array<double>")
        out: list[list[Hit]] = [[] for _ in queries]
        for r in plans.search_batch(self.docs, asked, top_k, filters, self.metric).orderBy("query_id", "rank").collect():
            out[r["query_id"]].append(Hit(r["doc_id"], r["text"], r["score"], json.loads(r["metadata"] or "{}")))
        return out

    def keyword_search(self, query: str, top_k: int = 5, filters: Mapping[str, Any] | None = None) -> list[Hit]:
        return self._hits(plans.keyword_search(self.docs, query, top_k, filters))

    def hybrid_search(self, query: str, top_k: int = 5, alpha: float = 0.5, filters: Mapping[str, Any] | None = None, vector: Sequence[float] | None = None) -> list[Hit]:
        plans.check_query(query)
        v = self._query_vector(query if vector is None else vector)
        return self._hits(plans.hybrid_search(self.docs, query, v, top_k, alpha, filters, self.metric, self.index(), self.ef_search))

    # --- lookups -------------------------------------------------------------

    def get(self, doc_id: str) -> dict[str, Any] | None:
        r = mutate.get(self.docs, doc_id).first()
        return {"doc_id": r["doc_id"], "text": r["text"], "vector": r["vector"], "metadata": json.loads(r["metadata"] or "{}")} if r else None

    def get_metadata(self, doc_id: str) -> dict[str, Any] | None:
        """Of a deleted document too."""
        r = mutate.get(self.docs, doc_id, deleted=True).select("metadata").first()
        return json.loads(r[0] or "{}") if r else None

    def get_vector(self, doc_id: str) -> list[float] | None:
        """Of a deleted document too."""
        r = mutate.get(self.docs, doc_id, deleted=True).select("vector").first()
        return r[0] if r else None

    def records(self, include_vector: bool = False) -> DataFrame:
        return mutate.records(self.docs, include_vector)

    def has_document(self, doc_id: str) -> bool:
        """Whether the id exists, deleted or not."""
        return self._state(doc_id) is not None

    def count(self) -> int:
        return self.docs.filter("active").count()

    def info(self) -> dict[str, Any]:
        row = mutate.collection_info(self.docs).first().asDict()
        row["dimension"] = row["dimension"] or self._dimension
        at = self.store
        return row | {
            "path": at.path if at else None, "metric": self.metric, "index_type": self.index_type, "model": self.embedder.model_name,
            "store_bytes": at.size() if at else 0, "log_bytes": at.log.size() if at else 0, "file_exists": bool(at and at.exists()), "wal_exists": bool(at and at.has_log()),
        }

    def __len__(self) -> int:
        return self.count()

    def __contains__(self, doc_id: str) -> bool:
        return self._state(doc_id) is True

    def __getitem__(self, doc_id: str) -> dict[str, Any]:
        found = self.get(doc_id)
        if found is None:
            raise KeyError(doc_id)
        return found

    def __iter__(self) -> Iterator[dict[str, Any]]:
        for r in mutate.order_of(self.docs).toLocalIterator():
            yield {"doc_id": r["doc_id"], "text": r["text"], "metadata": json.loads(r["metadata"] or "{}")}

    def __repr__(self) -> str:
        return f"Collection(path={self.store.path if self.store else None!r}, metric={self.metric!r}, index_type={self.index_type!r}, dimension={self._dimension})"
