"""Substring dedup: remove passages that an earlier document holds.

A *window* is ``SPAN`` consecutive words of one document; a word goes if some
window over it also starts in a document of smaller id. Windows are judged on
the input.

Suffix automata of the whole corpus, each met by every document, would cost its
size squared. So texts are first routed:

1. *Anchors.* Of the ``SPAN - GRAM + 1`` word grams in a window, the one of least
   hash is its anchor. Equal windows have equal anchors, so a window can only
   repeat where its anchor occurs in two texts. One gram in twenty or so is an
   anchor; they are summed up by hash to the least id that holds each, its
   *first* document.
2. *Reference shards.* What a first document holds around its anchors is a
   reference shard, as large as that document at most; that of a document of
   many anchors is cut by anchor into parts of about ``PART_ANCHORS``. A suffix
   automaton is built of it, and every other document streams the stretches whose
   anchors lead there through it for matching statistics: windows where these
   reach ``SPAN`` are removed. Shards that many documents meet are sent to many
   tasks, each of which gets ``MEET_BYTES`` or ``MEET_ROWS`` of the documents or so.
3. *The rest.* Stretches that share an anchor with the first document but do not
   match it may still match a third one. Their windows, mostly those that stick
   out at the ends of a repeated passage, are routed once more, now by 128-bit
   hashes of the windows themselves: the least id that holds a window is its first
   document, what that holds of such windows its shard, and the others stream
   theirs through the automaton of it. So hashes only say where to look; what is
   removed is what an automaton has matched. (Two windows that differ and have
   equal hashes could hide a third; hashes of words have 64 bits, so that may
   happen once in some 2^64 pairs of words.)

Exact copies are found first, by md5, and go as a whole; only the first copy
takes part in the rest. Joins are by key only, so hot keys split at run time.
An automaton takes some 500 bytes a word of its shard; of a shard above
``LARGE`` states only windows that it has not yet are added, so endless
repetition adds nothing.

Defined results: null or empty text has no words; texts shorter than ``SPAN``
words keep all; rows of null ids keep all and remove nothing; rows of one id do
not remove each other's words; repeated rows are treated alike; very long texts
are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import as_bytes, mapped, stored

SPAN = 50
GRAM = 10
MEET_BYTES = 1 << 20
MEET_ROWS = 100
TASK_BYTES = 64 << 20
PART_ANCHORS = 1024
LARGE = 50_000
CHUNK = 5_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BLOCK = 4 << 20


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word in order, by bytes at once: no word becomes an object. Long texts go in blocks, cut at spaces."""
    whole, at, parts = np.frombuffer(text, np.uint8), 0, []
    while at < len(whole):
        stop = next((i for i in range(at + BLOCK, len(whole)) if SPACE[whole[i]]), len(whole))
        parts.append(_hashed(whole[at:stop]))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _hashed(b: np.ndarray) -> np.ndarray:
    inside = ~SPACE[b]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate([[0] if inside[0] else [], turn, [len(b)] if inside[-1] else []]).astype(np.int64)
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), MIX[0]))
    h = np.add.reduceat((b[inside].astype(np.uint64) + np.uint64(1)) * powers[place], first)
    return (h ^ (h >> np.uint64(29))) * MIX[1]


def rolled(h: np.ndarray, width: int, mix: np.uint64 = MIX[0]) -> np.ndarray:
    """Polynomial hashes of all runs of ``width``, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, size, power = np.zeros(n, np.uint64), 0, h, 1, int(mix)
    while done < width:
        if width >> (size.bit_length() - 1) & 1:
            out = out * np.uint64(power) + part[done : done + n]
            done += size
        if 2 * size <= width:
            part = part[: len(part) - size] * np.uint64(power) + part[size:]
            power = power * power % (1 << 64)
        size *= 2
    return (out ^ (out >> np.uint64(31))) * MIX[1]


def anchors(h: np.ndarray) -> np.ndarray:
    """For every window the hash of its anchor: least values of ever wider runs of grams, by doubling."""
    least, size, width = rolled(h, GRAM), 1, SPAN - GRAM + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:])


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, anchor): the distinct anchors of each document of a known id."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = []
            for text in b["text"].to_pylist():
                h = word_hashes(text)
                found.append(np.unique(anchors(h)) if len(h) >= SPAN else h[:0])
            many = [len(x) for x in found]
            yield {
                "doc_id": pa.array(np.repeat(b["doc_id"].to_numpy(zero_copy_only=False), many)),
                "th": pa.array(np.repeat(b["th"].to_numpy(zero_copy_only=False), many)),
                "anchor": pa.array((np.concatenate(found) if found else np.zeros(0, np.uint64)).view(np.int64)),
            }

    return mapped(docs.select("doc_id", "th", "text"), "doc_id bigint, th bigint, anchor bigint", run)


FOUND = "first bigint, part bigint, meets boolean, doc_id bigint, th bigint, start bigint, words binary"


def _runs(to: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [start, stop) of windows that lead to one shard; windows of -1 lead nowhere."""
    turn = np.flatnonzero((to[1:] != to[:-1]) | (part[1:] != part[:-1])) + 1
    for s, e in zip([0, *turn.tolist()], [*turn.tolist(), len(to)], strict=True):
        if part[s] >= 0:
            yield s, e


def _columns(rows: list[tuple], schema: str) -> dict:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return {n: pa.array(list(v), kinds[k]) for (n, k), v in zip(fields, cols, strict=True)}


def _stretches(docs: DataFrame) -> DataFrame:
    """docs (doc_id, th, text, led): the stretches of windows whose anchors lead to one shard of a first document."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = []
            for doc, th, text, led in zip(b["doc_id"].to_pylist(), b["th"].to_pylist(), b["text"].to_pylist(), b["led"].to_pylist(), strict=True):
                words = text.split()
                keys, first, part = (np.array([x[n] for x in led], np.int64) for n in ("anchor", "first", "part"))
                order = np.argsort(keys)
                keys, first, part = keys[order], first[order], part[order]
                mine = anchors(word_hashes(text)).view(np.int64)
                slot = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                known = keys[slot] == mine
                to = np.where(known, first[slot], 0)
                for s, e in _runs(to, np.where(known, part[slot], -1)):
                    rows.append((int(to[s]), int(part[slot[s]]), int(to[s]) != doc, doc, th, s, b" ".join(words[s : e + SPAN - 1])))
            yield _columns(rows, FOUND)

    return mapped(docs.select("doc_id", "th", "text", "led"), FOUND, run)


def _left_stretches(left: DataFrame) -> DataFrame:
    """left (doc_id, th, start, words, led): of runs that matched nothing, the stretches whose windows lead to one document that has them."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = []
            for doc, th, start, text, led in zip(*(b[n].to_pylist() for n in ("doc_id", "th", "start", "words", "led")), strict=True):
                words = text.split()
                to, part = np.zeros(len(words) - SPAN + 1, np.int64), np.full(len(words) - SPAN + 1, -1)
                at = [x["at"] for x in led]
                to[at], part[at] = [x["least"] for x in led], 0
                rows += [(int(to[s]), 0, int(to[s]) != doc, doc, th, start + s, b" ".join(words[s : e + SPAN - 1])) for s, e in _runs(to, part)]
            yield _columns(rows, FOUND)

    return mapped(left.select("doc_id", "th", "start", "words", "led"), FOUND, run)


def _learn(machine: SuffixAutomaton, words: list[int]) -> None:
    """Add a stretch; once the automaton is large, only pieces that hold a window it has not."""
    for s in range(0, len(words) - SPAN + 1, CHUNK):
        piece = words[s : s + CHUNK + SPAN - 1]
        if len(machine.length) < LARGE or min(machine.matching(piece)[SPAN - 1 :]) < SPAN:
            machine.add(piece)


MET = "doc_id bigint, th bigint, start bigint, stop bigint, words binary, one array<bigint>, two array<bigint>"


def _matched(dealt: DataFrame) -> DataFrame:
    """dealt (first, part, salt, ...), a shard's own stretches before those that meet it: what each stretch matches.

    Runs of windows [start, stop): matched, or left over and then with their words and two hashes of each window.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        here, machine, number = None, None, {}
        for b in batches:
            out = []
            for *key, meets, doc, th, start, text in zip(*(b[n].to_pylist() for n in ("first", "part", "salt", "meets", "doc_id", "th", "start", "words")), strict=True):
                if key != here:
                    here, machine, number = key, SuffixAutomaton(), {}
                words = text.split()
                if not meets:
                    _learn(machine, [number.setdefault(w, len(number)) for w in words])
                    continue
                stats = np.array(machine.matching([number.get(w, -1) for w in words]))
                hit = stats[SPAN - 1 :] >= SPAN
                turn = np.flatnonzero(hit[1:] != hit[:-1]) + 1
                hashes = None if hit.all() else [rolled(word_hashes(text), SPAN, m).view(np.int64) for m in MIX]
                for s, e in zip([0, *turn.tolist()], [*turn.tolist(), len(hit)], strict=True):
                    more = (None, None, None) if hit[s] else (b" ".join(words[s : e + SPAN - 1]), hashes[0][s:e], hashes[1][s:e])
                    out.append((doc, th, start + s, start + e, *more))
            yield _columns(out, MET)

    return mapped(dealt, MET, run)


def _met(found: DataFrame) -> DataFrame:
    """Stretches dealt out by the shard they lead to, and what they match; written."""
    size = lambda own: F.sum(F.when(F.col("meets") != own, F.length("words")).otherwise(0))
    wanted = F.greatest(size(False) / MEET_BYTES, F.count_if("meets") / MEET_ROWS)
    # A shard is sent out again only for as many bytes, at least, that meet it.
    load = stored(found.groupBy("first", "part").agg(F.ceil(F.greatest(F.least(wanted, size(False) / size(True)), F.lit(1.0))).alias("salts")))
    salts = F.when(F.col("meets"), F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))
    salted = found.join(load, ["first", "part"]).withColumn("salt", F.explode(salts))
    # Automata take more time than their bytes suggest, so these partitions are not to be put together.
    total = found.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    key = ["first", "part", "salt"]
    return stored(_matched(salted.repartition(tasks, *key).sortWithinPartitions(*key, "meets").select(*key, "meets", "doc_id", "th", "start", "words")))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans): for documents that lose words, the runs of windows to remove; null spans: the whole text.

    ``docs`` has doc_id, th (a hash of the text) and text, none of them null.
    """
    known = stored(docs.select("doc_id", "th", F.md5("text").alias("digest")))
    # Sums that a join follows are written first: the join stands alone then, and keys of many rows can be split.
    firsts = stored(known.groupBy("digest").agg(F.min("doc_id").alias("least")))
    placed = stored(known.join(firsts, "digest").select("doc_id", "th", (F.col("doc_id") == F.col("least")).alias("leads")).distinct())
    copies = placed.where("NOT leads").select("doc_id", "th")

    rows = stored(_anchor_rows(docs))
    shared = stored(rows.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").select("anchor", "first"))
    cuts = stored(shared.groupBy("first").agg(F.ceil(F.count("*") / PART_ANCHORS).alias("parts")))
    shared = stored(shared.join(cuts, "first").select("anchor", "first", F.pmod("anchor", "parts").alias("part")))
    led = rows.join(shared, "anchor").groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "first", "part")).alias("led"))
    led = led.join(placed.where("leads").select("doc_id", "th"), ["doc_id", "th"])
    met = _met(stored(_stretches(docs.join(led, ["doc_id", "th"]))))

    key = ["doc_id", "th", "start"]
    left = met.where("words IS NOT NULL")
    windows = left.select(*key, F.posexplode(F.arrays_zip("one", "two")).alias("at", "w")).select(*key, "at", "w.one", "w.two")
    least = stored(windows.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("one", "two", "least"))
    again = stored(windows.join(least, ["one", "two"]).select(*key, "at", "least")).groupBy(*key).agg(F.collect_list(F.struct("at", "least")).alias("led"))
    rest = _met(stored(_left_stretches(left.select(*key, "words").join(again, key))))
    runs = met.unionByName(rest).where("words IS NULL").select("doc_id", "th", F.struct("start", "stop").alias("run"))
    partly = runs.groupBy("doc_id", "th").agg(F.collect_list("run").alias("spans"))
    return partly.unionByName(copies.withColumn("spans", F.lit(None).cast(partly.schema["spans"].dataType)))


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of ``docs``; kept words are joined by one space."""
    texts = docs.select("doc_id", as_bytes()).withColumn("th", F.xxhash64("text"))
    gone = spans(texts.where("doc_id IS NOT NULL")).withColumn("known", F.lit(True))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, known, runs in zip(b["text"].to_pylist(), b["known"].to_pylist(), b["spans"].to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if known and len(words) >= SPAN:
                    goes = np.zeros(len(words) + 1, np.int32)
                    for r in runs if runs is not None else [{"start": 0, "stop": len(words) - SPAN + 1}]:
                        goes[r["start"]] += 1
                        goes[r["stop"] + SPAN - 1] -= 1
                    stays = np.cumsum(goes[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield {"doc_id": b["doc_id"].cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}

    joined = texts.join(gone, ["doc_id", "th"], "left").select("doc_id", "text", "known", "spans")
    return mapped(joined, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string", run)
