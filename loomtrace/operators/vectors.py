"""Vector search and its fusion with keyword search; embedding of what has no vector yet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
RRF = 60


def similarity_to(query: list[float], dimensions: int | None = None) -> Callable[[Column], Column]:
    """Cosine with one vector, a batch of rows as one matrix product; 0 for other lengths and for no length."""
    wanted = np.asarray(query, np.float64)
    norm = float(np.sqrt((wanted * wanted).sum()))

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v))
        fits = v.map(lambda x: x is not None and len(x) == len(wanted)).to_numpy(bool)
        if norm >= 1e-9 and fits.any():
            m = np.stack(v[fits].to_list()).astype(np.float64)
            own = np.sqrt((m * m).sum(axis=1))
            out[fits] = np.where(own < 1e-9, 0.0, m @ wanted / np.maximum(own * norm, 1e-300))
        return pd.Series(out)

    return score


def top_similar(vectors: DataFrame, key: str, query: list[float], k: int, column: str = "embedding") -> DataFrame:
    """(key, score): the ``k`` nearest; ties by key."""
    return vectors.select(key, similarity_to(query)(F.col(column)).alias("score")).orderBy(F.desc("score"), key).limit(k)


def ranked(hits: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """(key, rank) from 0 in a short list."""
    return hits.select(key, (F.row_number().over(W.orderBy(*order)) - 1).alias("rank"))


def fuse(key: str, *lists: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of lists (key, rank): sum of 1 / (60 + rank + 1); ties by key."""
    each = [x.select(key, (1 / (RRF + F.col("rank") + 1)).alias("part")) for x in lists]
    every = each[0]
    for x in each[1:]:
        every = every.unionByName(x)
    return every.groupBy(key).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), key).limit(k)


def hybrid(key: str, keyword: DataFrame, vector: DataFrame | None, k: int) -> DataFrame:
    """keyword (key, bm25) and vector (key, score), both at three times ``k``; without vectors, keywords alone."""
    by_words = ranked(keyword.orderBy("bm25", key).limit(3 * k), key, [F.col("bm25"), F.col(key)])
    if vector is None:
        return fuse(key, by_words, k=k)
    return fuse(key, by_words, ranked(vector.orderBy(F.desc("score"), key).limit(3 * k), key, [F.desc("score"), F.col(key)]), k=k)


def from_blob(blob: Column) -> Column:
    """Packed little-endian floats as an array."""

    @F.pandas_udf("array<float>")
    def unpack(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return unpack(blob)


def to_blob(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(vector)


def hashed_embedder(dimensions: int = 384) -> Embedder:
    """A stand-in without a model: a hashed bag of tokens at unit length."""

    import zlib
    from functools import lru_cache

    from ..functions.tokens import hybrid_tokens

    @lru_cache(1 << 16)
    def place(token: str) -> int:
        """Where a token counts; up in the first half, down in the second."""
        h = zlib.crc32(token.encode())
        return h % dimensions + (0 if h & 1 << 31 else dimensions)

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            n = np.bincount(np.fromiter(map(place, hybrid_tokens(t or "")), np.int64), minlength=2 * dimensions)
            out[i] = n[:dimensions] - n[dimensions:]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embed(texts: DataFrame, key: str, text: Column, make: Callable[[], Embedder]) -> DataFrame:
    """(key, embedding); ``make`` runs once per worker, so a model is loaded once."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            yield pd.Series(list(model([t or "" for t in part])))

    return texts.select(key, run(text).alias("embedding"))


def missing(memories: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Memories that are not removed and have no vector, with the text to embed."""
    live = memories.where("state <> 'removed'")
    return live.join(embeddings, live["id"] == embeddings["memory_id"], "left_anti").withColumn("embed_text", F.concat("title", F.lit("\n"), "content"))
