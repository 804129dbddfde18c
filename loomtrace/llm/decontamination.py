"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared in lower case with runs of white space as one space. Every
benchmark item is cut into pieces of ``PIECE`` characters, one every ``STRIDE``
(a shorter item is one piece), so a copied passage of ``PIECE + STRIDE``
characters holds a whole piece. A document holds a piece if some stretch of it is
within ``budget(length)`` edits of the piece.

A piece of ``m`` characters and a stretch within ``k`` edits share at least
``m - q + 1 - k * q`` q-grams, all on diagonals (position in the document less
position in the piece) within ``k`` of one another's middle. So: hash all
q-grams of a document at once (numpy), look them up among the benchmark's, pass
over stretches with too few hits for any piece, count hits per piece in
overlapping bands of diagonals, keep the bands that reach the bound, and align
only there: a banded alignment, free at both ends of the document, gives the
exact number of edits. The lemma loses no match. Hits are expanded ``HITS`` at a
time, so a q-gram that many items share costs time, not memory.

The benchmark is what is broadcast, as an index of 19 to 25 bytes a
character (hash and place of each q-gram, a table of cells before them, the text). It is taken in
blocks of at most ``BLOCK`` characters, counted before: one pass over the
documents for each, with the index of that block alone. Between the passes of
``keep_clean`` its documents are written. Documents are never shuffled.

Defined results: null or empty texts hold nothing, and null or empty items are in
no text; items of fewer than ``Q`` characters are found exactly, as whole words in
a row (``keep_clean`` passes over them unless told otherwise, as a single common
word would reject most of a corpus); items of null id report null; equal items
report each id, equal rows of one id once; an item above ``PART`` characters is
taken in parts that report by themselves; repeated documents each report; very
long texts are searched whole; other columns are ignored, and kept by
``keep_clean``; empty tables give no rows and reject none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored

Q = 8
PIECE = 80
STRIDE = 20
RATE = 0.08
BAND = 32
BLOCK = 8 << 20
PART = 1 << 20
HITS = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: BASE to the powers 1, 2 and 4, modulo 2 ** 64.
POWERS = tuple(np.uint64(pow(int(BASE), e, 1 << 64)) for e in (1, 2, 4))


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams (q = 8), by doubling."""
    h = c.astype(np.uint64) + np.uint64(1)
    for width, power in zip((1, 2, 4), POWERS, strict=True):
        h = h[: len(h) - width] * power + h[width:] if len(h) > width else h[:0]
    return h ^ (h >> np.uint64(32))


def budget(m: int) -> int:
    """Edits allowed in ``m`` characters; as many as leave a useful number of shared q-grams."""
    return max(0, min(int(m * RATE), (m - Q + 1 - Q) // Q))


def _last_row(piece: np.ndarray, region: np.ndarray, k: int, free: bool) -> np.ndarray | None:
    """Least edits between ``piece`` and a stretch of ``region`` by where the stretch ends; None if all are over ``k``.

    The stretch begins anywhere (``free``) or where the region does. Row ``i``
    covers the columns that such a start and ``k`` edits can reach; a row is
    done at once, insertions by a running minimum.
    """
    m, n = len(piece), len(region)
    slack = max(0, n - m) + 2 * k if free else k
    steps = np.arange(n + 1, dtype=np.int32)
    row = np.zeros(n + 1, np.int32) if free else steps
    for i in range(m):
        lo, hi = max(0, i + 1 - k), min(n, i + 1 + slack)
        if lo > n:  # the region is shorter than what is done of the piece, less the budget
            return None
        new = np.full(n + 1, m + 1, np.int32)
        part = np.minimum(row[lo : hi + 1] + 1, np.concatenate([[m + 1] if lo == 0 else row[lo - 1 : lo] + (region[lo - 1] != piece[i]), row[lo:hi] + (region[lo:hi] != piece[i])]))
        new[lo : hi + 1] = np.minimum.accumulate(part - steps[: hi - lo + 1]) + steps[: hi - lo + 1]
        row = new
        if row.min() > k:
            return None
    return row


def band_edits(piece: np.ndarray, region: np.ndarray, k: int) -> int:
    """Least edits between ``piece`` and any stretch of ``region``, more than ``k`` if over ``k``."""
    row = _last_row(piece, region, k, free=True)
    return k + 1 if row is None else int(row.min())


def stretch(piece: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int] | None:
    """(edits, start) of the stretch of ``region`` nearest to ``piece``; None if it is over ``k`` edits off."""
    row = _last_row(piece, region, k, free=True)
    if row is None:
        return None
    edits, stop = int(row.min()), int(row.argmin())
    back = _last_row(piece[::-1], region[:stop][::-1], edits, free=False)
    return edits, stop - int(back.argmin())


@dataclass
class Index:
    """A block of the benchmark: its texts end to end, their pieces by place, and all q-grams by hash."""

    text: str
    items: list[list[int | None]]  # per text, the ids that have it
    owner: np.ndarray  # per piece: its text
    start: np.ndarray
    length: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    hashes: np.ndarray
    where: np.ndarray
    maybe: np.ndarray
    shift: np.uint64
    short: dict[int, dict[str, list[int | None]]]  # by number of words

    @classmethod
    def build(cls, items: list[tuple[int | None, str]]) -> Index:
        ids: dict[str, list[int | None]] = defaultdict(list)
        for i, t in items:
            if t and i not in ids[t]:
                ids[t].append(i)
        short: dict[int, dict[str, list[int | None]]] = defaultdict(dict)
        for t in [t for t in ids if len(t) < Q]:
            short[t.count(" ") + 1][t] = ids.pop(t)
        owner, start, length, gram, at = [], [], [], [], 0
        for k, t in enumerate(ids):
            last = max(0, len(t) - PIECE)
            own = [*range(0, last, STRIDE), last]
            owner += [k] * len(own)
            start += [at + s for s in own]
            length += [min(PIECE, len(t))] * len(own)
            gram.append(grams(codes(t)))
            at += len(t)
        first = np.cumsum([0, *map(len, ids)])
        every = np.concatenate(gram) if gram else np.zeros(0, np.uint64)
        where = np.concatenate([np.arange(s, s + len(g), dtype=np.int32) for s, g in zip(first.tolist(), gram)]) if gram else np.zeros(0, np.int32)
        order = np.argsort(every, kind="stable")
        long = np.array(length, np.int64)
        edits = np.array([budget(m) for m in length], np.int64)
        bits = max(10, int(6 * len(every)).bit_length())
        shift = np.uint64(64 - bits)
        maybe = np.zeros(1 << bits, np.bool_)
        maybe[(every * BASE) >> shift] = True
        return cls("".join(ids), list(ids.values()), np.array(owner, np.int32), np.array(start, np.int64), long, edits, long - Q + 1 - edits * Q, every[order], where[order], maybe, shift, dict(short))

    def _hits(self, h: np.ndarray) -> np.ndarray:
        """Positions that may be in the index, in some stretch as long as a match with as many of them as the least demanding piece needs."""
        hit = self.maybe[(h * BASE) >> self.shift]
        need, width, n = int(self.need.min()), PIECE + int(self.edits.max()), len(hit)
        if np.count_nonzero(hit) < need:
            return np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        starts = np.flatnonzero(before[np.minimum(np.arange(n) + width, n)] - before[:-1] >= need)
        cover = np.zeros(n + width + 1, np.int32)
        cover[starts] += 1
        cover[starts + width] -= 1
        return np.flatnonzero(hit & (np.cumsum(cover)[:n] > 0))

    def _crowded(self, diagonal: np.ndarray) -> np.ndarray:
        """Which hits lie on diagonals of the whole block with as many hits as the least demanding piece needs."""
        band, inside = np.divmod(diagonal, BAND)
        also = inside < 2 * int(self.edits.max())
        keys, counts = np.unique(np.concatenate([band, band[also] - 1]), return_counts=True)
        full = keys[counts >= self.need.min()]
        if not len(full):
            return np.zeros(len(band), np.bool_)
        here = lambda b: full[np.minimum(np.searchsorted(full, b), len(full) - 1)] == b
        return here(band) | (also & here(band - 1))

    def _bands(self, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(piece, band) with as many hits as the lemma asks for."""
        pos = self._hits(h)
        if not len(pos):
            return
        lo, hi = (np.searchsorted(self.hashes, h[pos], side) for side in ("left", "right"))
        if np.count_nonzero(hi > lo) < self.need.min():
            return
        before = np.concatenate([[0], np.cumsum(hi - lo)])
        wide = len(h) // BAND + PIECE
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for f in range(0, int(before[-1]), HITS):
            flat = np.arange(f, min(f + HITS, int(before[-1])))
            p = np.searchsorted(before, flat, "right") - 1
            place = self.where[lo[p] + flat - before[p]].astype(np.int64)
            if before[-1] <= HITS:  # all at once: what no piece can have is passed over before pieces are told apart
                near = self._crowded(pos[p] - place)
                if not near.any():
                    return
                p, place = p[near], place[near]
            piece = np.searchsorted(self.start, place, "right") - 1
            got = [keys]
            # The pieces that hold a q-gram are the last few that begin at or before it.
            for back in range(-(-PIECE // STRIDE) + 1):
                own = piece - back
                ok = own >= 0
                ok[ok] = self.start[own[ok]] + self.length[own[ok]] >= place[ok] + Q
                own, diagonal = own[ok], pos[p[ok]] - (place[ok] - self.start[own[ok]]) + PIECE
                # Band b holds diagonals BAND * b up to BAND * (b + 1) + 2 k: a hit near a band's start is in the band before, too.
                band = diagonal // BAND
                also = (diagonal % BAND < 2 * self.edits[own]) & (band > 0)
                got += [own * wide + band, (own * wide + band - 1)[also]]
            more, inverse = np.unique(np.concatenate(got), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, np.ones(len(inverse) - len(counts), np.int64)]), len(more)).astype(np.int64)
            # Later hits lie on diagonals beyond their position: bands that end before the next one are complete.
            end = f + HITS >= before[-1]
            done = np.ones(len(more), bool) if end else BAND * (more % wide + 1) + 2 * self.edits[more // wide] < pos[np.searchsorted(before, f + HITS, "right") - 1]
            for k in more[done & (counts >= self.need[more // wide])].tolist():
                yield divmod(k, wide)
            keys, counts = more[~done], counts[~done]

    def found(self, plain: str) -> Iterator[tuple[int, int, int]]:
        """(piece, edits, start) for each band of a text, in normal form, that holds a piece."""
        if not len(self.hashes):
            return
        c = codes(plain)
        for p, b in self._bands(grams(c)):
            e, m, s = int(self.edits[p]), int(self.length[p]), int(self.start[p])
            lo = max(0, b * BAND - PIECE - e)
            hi = b * BAND - PIECE + BAND + 2 * e + m + e
            piece = self.text[s : s + m]
            at = plain.find(piece, lo, hi)
            if at >= 0:
                yield p, 0, at
            elif got := stretch(codes(piece), c[lo:hi], e):
                yield p, got[0], lo + got[1]

    def words(self, plain: str) -> Iterator[tuple[int | None, int]]:
        """(item, start) for the short items that stand in a text as whole words."""
        if self.short:
            words = plain.split(" ")
            for k, wanted in self.short.items():
                runs = words if k == 1 else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
                for t in wanted.keys() & set(runs):
                    for i in wanted[t]:
                        yield i, f" {plain} ".find(f" {t} ")

    def search(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item, pieces found, least edits, first place of such a piece) for each item that the text holds."""
        plain = normal(text)
        best: dict[int, tuple[int, int]] = {}
        for p, e, at in self.found(plain):
            best[p] = min(best.get(p, (e, at)), (e, at))
        out: dict[int, tuple[int, int, int]] = {}
        for p, (e, at) in best.items():
            n, least, first = out.get(self.owner[p], (0, e, at))
            out[self.owner[p]] = (n + 1, min(least, e), min(first, at))
        return [(i, *v) for k, v in out.items() for i in self.items[k]] + [(i, 1, 0, at) for i, at in self.words(plain)]

    def holds(self, text: str) -> bool:
        plain = normal(text)
        return any(True for _ in self.found(plain)) or any(True for _ in self.words(plain))


def parts(benchmark: DataFrame, least: int = 1) -> DataFrame:
    """(item_id, text): items of at least ``least`` characters in normal form, cut where they are above PART, each once; written."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = [(i, t[s : s + PART]) for i, raw in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True) if raw and len(t := normal(raw)) >= max(1, least) for s in range(0, max(1, len(t) - PIECE), PART - PIECE)]
            yield {"item_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}

    return stored(mapped(benchmark.select("item_id", "text"), "item_id bigint, text string", run).distinct())


def blocks(benchmark: DataFrame, least: int = 1) -> tuple[int, Iterator[Index]]:
    """How many indexes the benchmark makes, each of at most BLOCK characters, and these, each built when it is asked for.

    Parts fall by hash into bins, some for each block; the driver sees the sizes of the bins and joins neighbours up.
    """
    items = parts(benchmark, least)
    size = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    bins = -(-size // BLOCK) * 16
    of = lambda bins: F.pmod(F.xxhash64("item_id", "text"), F.lit(bins))
    while bins:
        sums = dict(items.groupBy(of(bins)).agg(F.sum(F.char_length("text"))).collect())
        if max(sums.values()) <= max(BLOCK, PART):
            break
        bins *= 2
    cuts, held = [0] if bins else [], 0
    for k in range(bins):
        if held and held + sums.get(k, 0) > BLOCK:
            cuts.append(k)
            held = 0
        held += sums.get(k, 0)
    key = lambda r: (r.item_id is None, r.item_id or 0, r.text)
    rows = lambda lo, hi: sorted(items.where(of(bins).between(lo, hi - 1)).collect(), key=key)
    return len(cuts), (Index.build([(r.item_id, r.text) for r in rows(lo, hi)]) for lo, hi in zip(cuts, [*cuts[1:], bins]))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_pieces, edits, start): a row for each item that a document holds; start in its normal form."""
    schema = "doc_id bigint, item_id bigint, n_pieces int, edits int, start bigint"
    spark = docs.sparkSession
    n, indexes = blocks(benchmark)
    out = spark.createDataFrame([], schema)
    for i, index in enumerate(indexes):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[dict], sent=sent) -> Iterator[dict]:
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) if t for hit in sent.value.search(t)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield {n: pa.array(list(v), kind) for n, v, kind in zip(("doc_id", "item_id", "n_pieces", "edits", "start"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)}

        got = mapped(docs.select("doc_id", "text"), schema, run)
        if n > 1:
            got = stored(got)
            sent.destroy()
        out = got if i == 0 else out.unionByName(got)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = Q) -> DataFrame:
    """The rows of ``docs`` that hold no item of at least ``least`` characters, with all their columns."""
    n, indexes = blocks(benchmark, least)
    for i, index in enumerate(indexes, 1):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not (t and sent.value.holds(t)) for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if i < n:
            docs = stored(docs)
            sent.destroy()
    return docs
