"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the *set* of its hashed single words, word pairs and
skip pairs (one word left out), taken over lower-cased words with ASCII
punctuation cut off; longer words also count by their first bytes, so that few
labels teach something about all forms of a word. FTRL-proximal (McMahan et al. 2013) learns with a rate per
coordinate; its L1 term leaves few weights other than zero, so the model that
scoring tasks receive is a short list of (index, weight), at most ``2**BITS``.

Learning is bounded: at most ``max_train`` labelled documents take part (those
of the smallest hashed ids), featurised on the executors and learned in one task,
which takes them in order of these hashes until it holds ``MAX_FEATURES``
features (256 MB; some 45,000 documents of ordinary length). Scoring is a single pass over all documents without any shuffle.

Defined results: null or empty text scores the intercept; no labelled rows at
all score 0.0; repeated rows score alike; null ids are scored like others and
held out or not by the crc32 of the empty text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordIds, as_bytes, bounded_labels, mapped

BITS = 18
MAX_TRAIN = 12_000
MAX_FEATURES = 64 << 20

#: Lower-cases A-Z, turns other ASCII marks and controls into spaces, keeps bytes above 127.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

#: Odd multipliers (fixed values) that keep the kinds of feature apart.
ONE, LEFT, RIGHT, SKIP, HEAD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93))
HEADS = (4, 6)


def features(text: bytes, ids: WordIds, bits: int = BITS) -> np.ndarray:
    """Hashed features of a text with repeats, in no order."""
    words = text.translate(PLAIN).split()
    h = ids.of(words)
    heads = [ids.of([w[:k] for w in words if len(w) > k]) * HEAD for k in HEADS]
    pairs, skips = h[:-1] * LEFT + h[1:] * RIGHT, h[:-2] * SKIP + h[2:] * RIGHT
    every = np.concatenate([h * ONE, pairs * ONE, skips * ONE, *heads])
    return ((every ^ (every >> np.uint64(29))) * LEFT >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Model:
    """Sparse weights; ``bias`` is None where nothing could be learned."""

    bias: float | None = None
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def dense(self, bits: int = BITS) -> np.ndarray:
        table = np.zeros(1 << bits)
        table[self.index] = self.weight
        return table


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 7.0
    l2: float = 0.1
    epochs: int = 5
    min_docs: int = 3
    bits: int = BITS

    def learn(self, rows: list[np.ndarray], labels: list[int]) -> Model:
        """rows: distinct feature indexes of each document; index ``2**bits`` is the intercept, free of L1.

        Features in fewer than ``min_docs`` of the rows are left out: they can only be learned by heart.
        """
        if not rows:
            return Model()
        size = 1 << self.bits
        seen = np.zeros(size, np.int32)
        for r in rows:
            seen[r] += 1
        for i, r in enumerate(rows):  # in place: the unpruned rows go one by one
            rows[i] = np.append(r[seen[r] >= self.min_docs], np.int32(size))
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        l1 = np.full(size + 1, self.l1)
        l1[size] = 0.0

        def weights(at: np.ndarray) -> np.ndarray:
            zi, li = z[at], l1[at]
            return np.where(np.abs(zi) <= li, 0.0, (np.sign(zi) * li - zi) / ((self.beta + np.sqrt(n[at])) / self.alpha + self.l2))

        order = np.arange(len(rows))
        for epoch in range(self.epochs):
            np.random.default_rng(epoch).shuffle(order)
            for i in order:
                at = rows[i]
                w = weights(at)
                g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
                grown = np.sqrt(n[at] + g * g)
                z[at] += g - (grown - np.sqrt(n[at])) / self.alpha * w
                n[at] += g * g
        w = weights(np.arange(size + 1))
        kept = np.flatnonzero(w[:size]).astype(np.int32)
        return Model(float(w[size]), kept, w[:size][kept])


def train(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_train: int = MAX_TRAIN, ftrl: Ftrl = Ftrl()) -> Model:
    """Learn ``label`` from the rows of ``labels`` that ``keep`` allows."""
    sample = bounded_labels(docs, labels, label, keep, max_train).select("doc_id", "label", as_bytes())

    def featurise(batches: Iterator[dict]) -> Iterator[dict]:
        ids = WordIds()
        for b in batches:
            found = [np.unique(features(t, ids, ftrl.bits)).tobytes() for t in b["text"].to_pylist()]
            yield {"doc_id": b["doc_id"].cast(pa.int64()), "label": b["label"], "found": pa.array(found, pa.binary())}

    def learn(batches: Iterator[dict]) -> Iterator[dict]:
        rows, ys, total = [], [], 0
        for b in batches:
            for found, label in zip(b["found"], b["label"].to_pylist(), strict=True):
                if total < MAX_FEATURES:
                    rows.append(np.frombuffer(found.as_py(), np.int32))
                    ys.append(label)
                    total += len(rows[-1])
        m = ftrl.learn(rows, ys)
        if m.bias is not None:
            yield {"index": pa.array(np.append(m.index, -1).astype(np.int32)), "weight": pa.array(np.append(m.weight, m.bias))}

    # One task, of at most max_train rows, in an order that does not depend on the partitions.
    few = mapped(sample, "doc_id bigint, label int, found binary", featurise).select(F.xxhash64("doc_id").alias("place"), "label", "found").repartition(1).sortWithinPartitions("place", "found").select("found", "label")
    got = mapped(few, "index int, weight double", learn).toPandas()
    if got.empty:
        return Model()
    index, weight = got["index"].to_numpy(np.int32), got["weight"].to_numpy()
    return Model(float(weight[index == -1][0]), index[index >= 0], weight[index >= 0])


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """Every document's (doc_id, score), in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        ids, m = WordIds(), sent.value
        table = m.dense(bits)
        for b in batches:
            out = []
            for text in b["text"].to_pylist():
                if m.bias is None:
                    out.append(0.0)
                    continue
                at = features(text, ids, bits)
                at = np.unique(at[table[at] != 0.0])
                out.append(float(1.0 / (1.0 + np.exp(-np.clip(m.bias + table[at].sum(), -35, 35)))))
            yield {"doc_id": b["doc_id"].cast(pa.int64()), "score": pa.array(out, pa.float64())}

    return mapped(docs.select("doc_id", as_bytes()), "doc_id bigint, score double", run)


def keep_clean(docs: DataFrame, model: Model, threshold: float, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = WordIds(), sent.value
        table = m.dense(bits)
        bar = np.log(threshold / (1 - threshold))
        for b in batches:
            keep = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                at = features((text or "").encode(), ids, bits)
                keep.append(m.bias is None or m.bias + table[np.unique(at[table[at] != 0.0])].sum() < bar)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
