"""Embedders: what turns texts into vectors, by batch on the executors."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmbedderUnavailable(RuntimeError):
    """The backend cannot be reached; searches raise it rather than answer without it."""


class Embedder(ABC):
    name: str
    model: str
    dimensions: int
    most_batch = 100

    @abstractmethod
    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        """One vector a text; kind is 'document' or 'query'."""

    def available(self) -> None:
        """Raises EmbedderUnavailable if texts cannot be embedded now."""


class HashEmbedder(Embedder):
    """Signed feature hashing of words, scaled to length 1: deterministic, without a model or a network."""

    name = "hash"

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.model = dimensions, f"hash-{dimensions}"

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        import xxhash

        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                row[h % self.dimensions] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class TfidfEmbedder(Embedder):
    """Dense TF-IDF vectors over a vocabulary of bounded size: (1 + ln tf) * ln((N + 1) / (df + 1)), scaled to length 1.
    Texts without a known term have the zero vector. Large vocabularies stay sparse (operators.index)."""

    name = model = "tfidf"

    def __init__(self, vocabulary: dict[str, int], n_docs: int, most_terms: int = 50_000):
        if len(vocabulary) > most_terms:
            raise ValueError(f"more than {most_terms} terms; use the sparse index")
        self.places = {term: i for i, term in enumerate(sorted(vocabulary))}
        self.idf = np.array([np.log((n_docs + 1) / (vocabulary[t] + 1)) for t in self.places])
        self.dimensions = len(self.places)

    @classmethod
    def of(cls, vocabulary: DataFrame, n_docs: int, most_terms: int = 50_000) -> TfidfEmbedder:
        """From a vocabulary (term, df)."""
        return cls({r["term"]: r["df"] for r in vocabulary.limit(most_terms + 1).collect()}, n_docs, most_terms)

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        import regex

        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            for term, n in Counter(regex.split(r"[^\p{L}\p{Nd}]+", text.lower())).items():
                if term in self.places:
                    row[self.places[term]] = (1 + np.log(n)) * self.idf[self.places[term]]
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def build_embedder(backend: str = "tfidf", **options) -> Embedder:
    """The embedder of a backend; 'tfidf', the default, takes vocabulary and n_docs, 'hash' dimensions."""
    kinds = {"tfidf": TfidfEmbedder, "hash": HashEmbedder}
    if backend not in kinds:
        raise ValueError(f"unknown backend {backend!r}; there are {sorted(kinds)}")
    return kinds[backend](**options)


def embedded(docs: DataFrame, key: str, text: Column, embedder: Embedder, as_of: str) -> DataFrame:
    """(doc_id, backend, model, dim, vector, created_at): the vectors of docs. Texts go through the embedder in
    batches of at most its most_batch; a wrong number of vectors is an error."""

    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            made: list = []
            for i in range(0, len(batch), embedder.most_batch):
                texts = batch.iloc[i : i + embedder.most_batch].fillna("").tolist()
                vectors = embedder.embed(texts)
                if len(vectors) != len(texts):
                    raise RuntimeError(f"{embedder.name} gave {len(vectors)} vectors for {len(texts)} texts")
                made += vectors
            yield pd.Series(made)

    return docs.select(
        F.col(key).alias("doc_id"), F.lit(embedder.name).alias("backend"), F.lit(embedder.model).alias("model"),
        F.lit(embedder.dimensions).alias("dim"), vector(text).alias("vector"), F.lit(as_of).alias("created_at"),
    )


def rebuild(vectors: DataFrame, fresh: DataFrame, embedder: Embedder) -> DataFrame:
    """The vectors with the embedder's own (backend, model) replaced by fresh ones; all others stay."""
    own = (F.col("backend") == embedder.name) & (F.col("model") == embedder.model)
    return vectors.where(~own).unionByName(fresh)


def migrated(old: DataFrame, backend: str, model: str) -> DataFrame:
    """Vectors of an old table (id, vector) tagged with backend, model and their length."""
    return old.select(
        F.col("id").alias("doc_id"), F.lit(backend).alias("backend"), F.lit(model).alias("model"), F.size("vector").alias("dim"), "vector", F.lit(None).cast("string").alias("created_at")
    )


def from_bytes(blob: Column) -> Column:
    """array<float> of packed little-endian float32; null where the length is no multiple of four."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return decode(blob)
