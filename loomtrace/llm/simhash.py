"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has 64 bits: bit ``b`` is set if over half of its 4-word
shingles (A-Z lower-cased, joined by one space, repeats included) have it set in
their XXH64 (seed 42). Two fingerprints link if they differ in at most
``RADIUS`` bits.

Equal fingerprints are one vertex from the start, so groups of copies of any
size cost one row. Distinct fingerprints are compared exactly, in tiles: numpy
exclusive-or of tile against tile, then bit counts; tile pairs whose population
counts differ by more than the radius are skipped. To keep the number of tile
pairs from growing with the square of the corpus, the tiles lie in *buckets*:
the 64 bits are cut into ``RADIUS + c`` blocks, of which two linked fingerprints
share at least ``c``, so a bucket for each choice of ``c`` blocks and their
value loses no link. ``c`` follows from the number of fingerprints. A bucket of
up to ``CELL`` rows is compared in one place. A larger one is cut finer in the
same way, by the bits its rows need not share (``LEVELS`` times at most, for
fingerprints that have most bits in common). What is too large even then is dealt
out: its rows fall into tiles by population count and hash, and each pair of
tiles within the radius becomes a cell of its own.

A cell reports a spanning forest of its links, no more rows than it has, and
star contraction (`components`) joins the forests up. Nothing but the number of
fingerprints reaches the driver.

Defined results: null or empty text has fingerprint zero, linked like any other;
texts of one to three words have one shingle; very long texts are read whole;
repeated rows each get a row; null ids name no group: ``component_id`` is the
least id reachable other than null, null if there is none; other columns are
ignored, and kept by ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mapped, stored
from .components import components

RADIUS = 4
CELL = 4096
LEVELS = 3
TILE = 256
SHINGLE = 4


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    h = np.fromiter((digest(whole[s:e], 42) for s, e in cuts), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp, *more): the fingerprint as a signed long; ``more`` are columns of longs to carry along."""
    kept = docs.select("doc_id", as_bytes(), *more)
    names = kept.columns[2:]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"].to_pylist()], np.uint64)
            yield {"doc_id": b["doc_id"].cast(pa.int64()), "fp": pa.array(fp.view(np.int64)), **{n: b[n] for n in names}}

    return mapped(kept, ", ".join(f"{n} bigint" for n in ("doc_id", "fp", *names)), run)


def block_masks(n: int) -> list[int]:
    """Masks of the blocks that make up a bucket's key, for ``n`` distinct fingerprints.

    c = 1, 2, 3 of RADIUS + c blocks: keys of 12, 21, 27 bits, for a few thousand rows a bucket at most.
    """
    c = 1 if n <= 1 << 23 else 2 if n <= 1 << 31 else 3
    blocks, at = [], 0
    for i in range(RADIUS + c):
        width = 64 // (RADIUS + c) + (i < 64 % (RADIUS + c))
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [sum(pick) for pick in combinations(blocks, c)]


def finer(mask: int) -> list[int]:
    """The bits outside ``mask`` in RADIUS + 1 parts, of which two linked fingerprints share one at least."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in rest[i :: RADIUS + 1]) for i in range(RADIUS + 1)]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of a (rows) and b (columns) differ in at most ``radius`` bits."""
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def forest(fps: np.ndarray, side: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links in one cell; side 0 rows meet all, side 1 and 2 rows only each other."""
    pop = np.bitwise_count(fps)
    order = np.lexsort((fps, pop))
    fps, pop, side = fps[order], pop[order].astype(np.int64), side[order]
    cut = list(range(0, len(fps), tile))
    label = np.arange(len(fps))
    parent = label.tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(cut):
        for t in cut[i:]:
            a, b = slice(s, s + tile), slice(t, t + tile)
            if pop[t] - pop[min(s + tile, len(pop)) - 1] > radius:
                break
            linked = tile_links(fps[a], fps[b], radius) & ((side[a][:, None] == 0) | (side[a][:, None] != side[b][None, :]))
            if s == t:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            # Components of this tile pair: least labels run back and forth until they stand still.
            la, lb = label[a].copy(), label[b].copy()
            while True:
                na = np.minimum(la, np.where(linked, lb[None, :], len(fps)).min(axis=1))
                nb = np.minimum(lb, np.where(linked, na[:, None], len(fps)).min(axis=0))
                if (na == la).all() and (nb == lb).all():
                    break
                la, lb = na, nb
            for x, y in [*zip(range(s, s + len(la)), la.tolist()), *zip(range(t, t + len(lb)), lb.tolist())]:
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    roots = np.array([root(x) for x in range(len(fps))], dtype=np.int64)
    child = np.flatnonzero(roots != np.arange(len(fps)))
    return fps[child], fps[roots[child]]


def _compare(rows: DataFrame) -> DataFrame:
    """rows (cell, side, fp) -> (u, v), a forest of links for each cell; cells are whole within a partition."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held = None
        for b in batches:
            got = [b["cell"].to_numpy(zero_copy_only=False), b["side"].to_numpy(zero_copy_only=False), b["fp"].to_numpy(zero_copy_only=False)]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            edges = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            if len(edges):
                yield from emit([x[: edges[-1]] for x in held], edges[:-1])
                held = [x[edges[-1] :] for x in held]
        if held is not None:
            yield from emit(held, np.zeros(0, np.int64))

    def emit(held: list[np.ndarray], edges: np.ndarray) -> Iterator[dict]:
        us, vs = [], []
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(held[0])], strict=True):
            if hi - lo > 1:
                u, v = forest(held[2][lo:hi].view(np.uint64), held[1][lo:hi])
                us.append(u)
                vs.append(v)
        if us:
            yield {"u": pa.array(np.concatenate(us).view(np.int64)), "v": pa.array(np.concatenate(vs).view(np.int64))}

    return mapped(rows.repartition("cell").sortWithinPartitions("cell").select("cell", "side", "fp"), "u bigint, v bigint", run)


def _keyed(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """rows (no, bucket, fp) -> the same of the next level: a row for each mask in ``masks[no]``."""
    table = F.array(*[F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in own]) for own in masks])
    parts = rows.select("no", "bucket", "fp", F.posexplode(F.get(table, F.col("no"))).alias("at", "mask"))
    no = (F.col("no") * len(masks[0]) + F.col("at")).alias("no")
    return parts.select(no, F.xxhash64("bucket", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "fp")


def links(fps: DataFrame, n: int) -> DataFrame:
    """(u, v): a forest that connects exactly the distinct fingerprints ``fp`` that links connect."""
    used = block_masks(n)
    rows = _keyed(fps.select(F.lit(0).alias("no"), F.lit(0).cast("bigint").alias("bucket"), "fp"), [used])
    found, cell = None, lambda *parts: F.xxhash64(*parts).alias("cell")
    for level in range(LEVELS):
        large = stored(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("bucket"))
        near = _compare(rows.join(large, "bucket", "left_anti").select(cell("bucket"), F.lit(0).alias("side"), "fp"))
        found = near if found is None else found.unionByName(near)
        if large.isEmpty():
            return found
        rows = stored(rows.join(large, "bucket", "left_semi"))
        if level + 1 < LEVELS:
            parts = [finer(m) for m in used]
            rows, used = _keyed(rows, parts), [m | x for m, own in zip(used, parts, strict=True) for x in own]
    return found.unionByName(_compare(_dealt(rows)))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (bucket, fp) of large buckets -> (cell, side, fp): each in tiles, a cell for each pair of tiles."""
    rows = rows.select("bucket", "fp", F.bit_count("fp").alias("pop"))
    large = stored(rows.groupBy("bucket", "pop").agg(F.ceil(F.count("*") / (CELL // 2)).alias("subs")))
    tiles = large.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("subs") - 1)))
    a, b = (tiles.select("bucket", F.col("pop").alias(f"pop_{x}"), F.col("sub").alias(f"sub_{x}")) for x in "ab")
    near = (F.col("pop_b") - F.col("pop_a")).between(0, RADIUS) & ((F.col("pop_a") < F.col("pop_b")) | (F.col("sub_a") <= F.col("sub_b")))
    pairs = a.join(b, "bucket").where(near).withColumn("cell", F.xxhash64("bucket", "pop_a", "sub_a", "pop_b", "sub_b"))
    same = (F.col("pop_a") == F.col("pop_b")) & (F.col("sub_a") == F.col("sub_b"))
    end = lambda side, x: F.struct(F.lit(side).alias("side"), F.col(f"pop_{x}").alias("pop"), F.col(f"sub_{x}").alias("sub"))
    ends = pairs.select("bucket", "cell", F.explode(F.when(same, F.array(end(0, "a"))).otherwise(F.array(end(1, "a"), end(2, "b")))).alias("e")).select("bucket", "cell", "e.*")
    dealt = rows.join(large, ["bucket", "pop"]).withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")))
    return dealt.join(ends, ["bucket", "pop", "sub"]).select("cell", "side", "fp")


def _rooted(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp, ...), written, with the root of each fingerprint's component."""
    star = components(links(distinct.select("fp"), distinct.count()))
    return distinct.join(star, distinct["fp"] == star["u"], "left").withColumn("root", F.coalesce("v", "fp")).drop("u", "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = stored(fingerprints(docs))
    rooted = _rooted(stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))))
    # A group's least id: summed up before it is shuffled, as one group may hold most rows, and
    # written before the join, so that the join stands alone and the group's rows can be split.
    least = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = stored(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group: that of the least id, null the last, and of that id's rows that of the least hash of all columns.

    Rows are told apart by id and hash (64 bits; maps are left out), so texts that share an id
    are judged each by itself, and equal rows count as one.
    """
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    row = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    prints = stored(fingerprints(docs, row.alias("row")))
    each = prints.groupBy("fp", "doc_id", "row").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n"))
    rooted = _rooted(stored(each.groupBy("fp").agg(best.alias("best"))))
    chosen = stored(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.*"))
    named = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("own_id"), row.alias("own_row"))
    rows = lambda which: named.join(chosen.where(which), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_row") == F.col("row")), "left_semi")
    once = rows("n = 1").select("whole.*")
    if chosen.where("n > 1").isEmpty():
        return once
    again = stored(rows("n > 1")).groupBy("own_id", "own_row").agg(F.first("whole").alias("whole"))
    return once.unionByName(again.select("whole.*"))
