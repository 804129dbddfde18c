"""Quality classifier: a generalised additive model with pairwise interactions.

The score is a sum of lookups: one table over the bins of each feature, and one
over a coarse grid for each of a few feature pairs (Lou et al. 2013). Tables are
learned by cyclic boosting: round after round, every feature in turn takes a
small step along a tree of a few leaves, fitted to what is left of the labels;
then, with these fixed, the pairs that explain most of the rest are boosted the
same way. Scoring adds table entries, whole batches at a time.

Learning is bounded: at most ``max_train`` labelled documents, those of the
smallest hashed ids, give one row of features each, all that reaches the driver.
Scoring is one pass over all documents without a shuffle.

Defined results: null or empty text has all features zero and is scored like any
other; no labelled rows score 0.0; labels of one kind only score near that kind;
repeated rows score alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import as_bytes, bounded_labels, mapped

MAX_TRAIN = 20_000

FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "distinct_words", "top_word", "twice_in_a_row",
    "digits", "capitals", "stops", "lines", "beyond_ascii", "long_words", "distinct_pairs",
)


def features(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    gone = lambda marks: size - len(text.translate(None, marks))
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        gone(b"#*$%&|<>") / n,
        1 - len(set(lines)) / len(lines),
        len(counts) / n,
        max(counts.values()) / n,
        same / n,
        gone(b"0123456789") / size,
        gone(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
        gone(b".!?") / n,
        len(lines) / n,
        (size - len(text.decode("utf-8", "replace"))) / size,
        sum(len(w) >= 12 for w in words) / n,
        pairs / max(1, n - 1),
    ]


@dataclass
class Gam:
    """edges: bin borders by feature; tables: by feature; pairs: (i, j) -> grid over coarse bins."""

    intercept: float | None = None
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.intercept is None:
            return np.zeros(len(x))
        total = np.full(len(x), self.intercept)
        bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
        for b, table in zip(bins, self.tables, strict=True):
            total += table[b]
        for (i, j), grid in self.pairs.items():
            total += grid[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


@dataclass(frozen=True)
class Boosting:
    bins: int = 32
    grid: int = 8
    rounds: int = 250
    pair_rounds: int = 80
    n_pairs: int = 6
    rate: float = 0.1
    depth: int = 2
    smooth: float = 1.0
    least: float = 2.0

    def _split(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """Gain and place of the best cut of a row of bins; 0 gain: none."""
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        rg, rh = g.sum() - cg, h.sum() - ch
        gain = cg**2 / (ch + self.smooth) + rg**2 / (rh + self.smooth) - g.sum() ** 2 / (h.sum() + self.smooth)
        gain[(ch < self.least) | (rh < self.least)] = 0
        k = int(np.argmax(gain)) if len(gain) else 0
        return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)

    def _tree(self, g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
        gain, at = self._split(g, h) if depth else (0.0, 0)
        if gain <= 0:
            return np.full(len(g), g.sum() / (h.sum() + self.smooth))
        return np.concatenate([self._tree(g[:at], h[:at], depth - 1), self._tree(g[at:], h[at:], depth - 1)])

    def _cross(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best cut along one axis with a best cut along the other on either side."""
        best = (0.0, np.zeros_like(g))
        base = g.sum() ** 2 / (h.sum() + self.smooth)
        for turned in (False, True):
            a, b = (g.T, h.T) if turned else (g, h)
            for at in range(1, len(a)):
                out, gain = np.zeros_like(a), -base
                for part in (slice(0, at), slice(at, len(a))):
                    row, weight = a[part].sum(axis=0), b[part].sum(axis=0)
                    leaf = self._tree(row, weight, 1)
                    gain += float((leaf * (2 * row - leaf * (weight + self.smooth / len(row)))).sum())
                    out[part] = leaf
                if gain > best[0]:
                    best = (gain, out.T if turned else out)
        return best

    def learn(self, x: np.ndarray, y: np.ndarray) -> Gam:
        if not len(y):
            return Gam()
        cuts = np.linspace(0, 1, self.bins + 1)[1:-1]
        edges = [np.unique(np.quantile(x[:, k], cuts)) for k in range(x.shape[1])]
        binned = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        gam = Gam(float(np.log(rate / (1 - rate))), edges, [np.zeros(len(e) + 1) for e in edges])
        logit = np.full(len(y), gam.intercept)

        def residual() -> tuple[np.ndarray, np.ndarray]:
            p = 1.0 / (1.0 + np.exp(-logit))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        for _ in range(self.rounds):
            for b, table in zip(binned, gam.tables, strict=True):
                r, w = residual()
                step = self.rate * self._tree(np.bincount(b, r, len(table)), np.bincount(b, w, len(table)), self.depth)
                table += step
                logit += step[b]

        gam.coarse = [np.minimum(np.arange(len(e) + 1) * self.grid // max(1, len(e) + 1), self.grid - 1) for e in edges]
        rough = [c[b] for c, b in zip(gam.coarse, binned, strict=True)]
        n = self.grid * self.grid
        hist = lambda i, j, v: np.bincount(rough[i] * self.grid + rough[j], v, n).reshape(self.grid, self.grid)
        r, w = residual()
        gains = sorted(((self._cross(hist(i, j, r), hist(i, j, w))[0], i, j) for i, j in combinations(range(len(edges)), 2)), reverse=True)
        gam.pairs = {(i, j): np.zeros((self.grid, self.grid)) for gain, i, j in gains[: self.n_pairs] if gain > 0}
        for _ in range(self.pair_rounds):
            for (i, j), grid in gam.pairs.items():
                r, w = residual()
                step = self.rate * self._cross(hist(i, j, r), hist(i, j, w))[1]
                grid += step
                logit += step[rough[i], rough[j]]
        return gam


def _batch(b: dict) -> np.ndarray:
    return np.array([features(t) for t in b["text"].to_pylist()], np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_train: int = MAX_TRAIN, boosting: Boosting = Boosting()) -> Gam:
    sample = bounded_labels(docs, labels, label, keep, max_train).select("doc_id", "label", as_bytes())

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"].cast(pa.int64()), "label": b["label"], "x": pa.array([v.tobytes() for v in _batch(b)], pa.binary())}

    got = mapped(sample, "doc_id bigint, label int, x binary", run).toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float64).reshape(-1, len(FEATURES))
    return boosting.learn(x, got["label"].to_numpy(np.float64))


def score(docs: DataFrame, gam: Gam) -> DataFrame:
    """Every document's (doc_id, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(gam)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"].cast(pa.int64()), "score": pa.array(sent.value.score(_batch(b)), pa.float64())}

    return mapped(docs.select("doc_id", as_bytes()), "doc_id bigint, score double", run)
