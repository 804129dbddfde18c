"""Shared helpers of the training-data operators.

A *word* is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``
(``[^\\x20\\x09-\\x0D]+``); ``bytes.split()`` cuts exactly there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.staging import stored  # noqa: F401  results in the shared folder, for all operators here

SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def bounded_labels(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled documents, those of the smallest hashed ids: (doc_id, label, text).

    ``bound`` rows of (id, label) are what the broadcast join holds. Ids that the
    labels name more than once count once, with the larger label; an id that
    several documents have gives one row, with the text of the least hash.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))


def as_bytes(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias(text)


class WordIds(dict):
    """word -> 64-bit hash, remembered up to ``room`` words, then begun anew."""

    def __init__(self, room: int = 200_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mapped(df: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` over dicts of column lists: ``rows`` gets and yields one dict a batch."""
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in (out[n] for n in names)], names=names)

    return df.mapInArrow(run, schema)
