"""Embedding texts: a protocol, a deterministic hashing embedder, an adapter for models, and a batch operator."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vsearch.runtime import ship
from vsearch.types import EmbedError

_TERM = re.compile(r"\w+")


class Embedder(Protocol):
    dimension: int
    model_name: str

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray: ...


def check_texts(texts: Sequence[str]) -> None:
    if not isinstance(texts, (list, tuple)) or not texts:
        raise EmbedError("texts must be a list that isn't empty")
    for i, t in enumerate(texts):
        if not isinstance(t, str) or not t.strip():
            raise EmbedError(f"text {i} is blank or no string")


class HashingEmbedder:
    """Signed hashing of terms to a unit vector; needs no model, the same on every machine."""

    def __init__(self, dimension: int = 384):
        if dimension < 1:
            raise EmbedError("dimension must be at least 1")
        self.dimension, self.model_name = dimension, f"hashing-{dimension}"

    def embed(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        check_texts(texts)
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for term in _TERM.findall(text.lower()) or [text]:
                h = zlib.crc32(term.encode("utf-8"))
                row[h % self.dimension] += 1.0 if h & 0x80000000 else -1.0
            n = math.sqrt(float((row * row).sum()))
            if n:
                row /= n
        return out


class ModelEmbedder:
    """A sentence-transformers model, loaded on first use and once a worker."""

    def __init__(self, model_name: str = "all-MiniLM-L6-v2", cache_dir: str | None = None, device: str | None = None, batch_size: int = 32):
        self.model_name, self.cache_dir, self.device, self.batch_size = model_name, cache_dir, device, batch_size
        self._model = None
        self._dimension: int | None = None

    def __getstate__(self):
        return self.__dict__ | {"_model": None}

    @property
    def is_loaded(self) -> bool:
        return self._model is not None

    @property
    def dimension(self) -> int:
        if self._dimension is None:
            self._load()
        return self._dimension

    def _load(self):
        if self._model is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise EmbedError("this embedder needs the package sentence-transformers") from e
            self._model = SentenceTransformer(self.model_name, cache_folder=self.cache_dir, device=self.device)
            self._dimension = self._model.get_sentence_embedding_dimension()
        return self._model

    def unload(self) -> None:
        self._model = None

    def embed(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        check_texts(texts)
        out = np.asarray(self._load().encode(list(texts), batch_size=self.batch_size, convert_to_numpy=True), np.float32)
        if out.shape != (len(texts), self.dimension):
            raise EmbedError("the model returned vectors of another shape")
        return out


def embedding(text: Column, embedder: Embedder) -> Column:
    """Vectors of a text column in Arrow batches; NULL for NULL and blank texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            good = s.map(lambda t: isinstance(t, str) and bool(t.strip()))
            made = iter(embedder.embed_batch(s[good].tolist()) if good.any() else ())
            yield pd.Series([next(made) if g else None for g in good], index=s.index, dtype=object)

    return run(text)


def embed_documents(docs: DataFrame, embedder: Embedder, text: str = "text", vector: str = "vector") -> DataFrame:
    """``docs`` with ``vector`` filled in where it is missing."""
    ship(docs.sparkSession)
    made = embedding(F.col(text), embedder)
    return docs.withColumn(vector, F.coalesce(F.col(vector), made) if vector in docs.columns else made)
