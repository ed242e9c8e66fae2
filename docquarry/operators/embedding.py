"""Embeddings by content hash: texts seen before are never embedded again."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    name: str
    dimensions: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class HashingProvider:
    """Deterministic and offline: words hashed into signed buckets, unit length."""

    def __init__(self, dimensions: int = 64):
        self.name, self.dimensions = f"hashing-{dimensions}", dimensions

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                row[h % self.dimensions] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


_PROVIDERS: dict[str, Callable[..., EmbeddingProvider]] = {"hashing": HashingProvider}


def register_provider(name: str, make: Callable[..., EmbeddingProvider]) -> None:
    _PROVIDERS[name] = make


def provider_for(name: str, **options: object) -> EmbeddingProvider:
    """The provider registered under a name; an unknown name is an error."""
    if name not in _PROVIDERS:
        raise ValueError(f"{name} is not a known provider")
    return _PROVIDERS[name](**options)


def cache_key(text: str = "content", model: str = "") -> F.Column:
    return F.concat(F.lit(f"embedding:{model}:"), F.md5(F.col(text)))


def cache_misses(texts: DataFrame, cache: DataFrame, provider_name: str, text: str = "content") -> DataFrame:
    """Distinct texts whose key is not in ``cache`` (column key)."""
    keyed = texts.where(F.col(text).isNotNull()).select(cache_key(text, provider_name).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def embed(texts: DataFrame, provider: EmbeddingProvider, batch: int = 100) -> DataFrame:
    """``key, embedding`` of distinct texts (key, text), in calls of ``batch`` texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = [v for at in range(0, len(frame), batch) for v in provider.embed_batch(frame["text"].iloc[at : at + batch].tolist())]
            yield pd.DataFrame({"key": frame["key"], "embedding": vectors})

    return texts.select("key", "text").mapInPandas(run, "key string, embedding array<double>")


def embed_cached(texts: DataFrame, cache: DataFrame, provider: EmbeddingProvider, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """All rows with their ``embedding``, and the rows to append to the cache."""
    fresh = embed(cache_misses(texts, cache, provider.name, text), provider)
    known = cache.select("key", "embedding").unionByName(fresh)
    return texts.withColumn("key", cache_key(text, provider.name)).join(known, "key", "left").drop("key"), fresh


def live_cache(cache: DataFrame, now: F.Column, ttl_seconds: int = 86400) -> DataFrame:
    """Cache rows younger than the time to live (column created_at)."""
    return cache.where(F.col("created_at") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def reembed(chunks: DataFrame, selected: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """Chunks with new vectors and model name for the selected documents (doc_id); others stay as they are.

    A text that occurs in many chunks is embedded once.
    """
    ids = selected.select("doc_id").distinct()
    again = chunks.join(ids, "doc_id", "left_semi").drop("embedding", "model_name")
    none = chunks.sparkSession.createDataFrame([], "key string, embedding array<double>")
    fresh = embed_cached(again, none, provider)[0].withColumn("model_name", F.lit(provider.name))
    return chunks.join(ids, "doc_id", "left_anti").unionByName(fresh.select(*chunks.columns))
