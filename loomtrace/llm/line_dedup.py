"""Line dedup by pairwise alignment.

Lines are cut at ``\\n``; a line counts if it has a word, and is compared without
white space at its ends. A *block* is a run of lines that stands in two documents
and has ``MIN_LINES`` lines or ``MIN_WORDS`` words. A document loses the blocks
it has in common with an earlier document (smaller id).

Which documents are aligned: those that share a *key*, the hash of two lines in a
row or of one line of ``MIN_WORDS`` words; every block has one. Each holder of a
key meets the earliest. Where a key is in more than ``RARE`` documents, these are
dealt by hash into about as many groups as a group has rows; each meets the
earliest of its group, and that one the earliest of all. So every holder of a key
but the first meets an earlier one that has it, the pairs number at most the keys
held, and no document meets more than about the square root of a key's holders.

How a pair is aligned: patience diff, then, for what one alignment leaves (a
passage held twice, or in another order), the widest common run around each key
that is still there. So a pair's common blocks all go; and as each key of a
document is met in some earlier holder, the result is that of aligning every
document with all earlier ones in this way.

Exact copies are found first, by md5; they lose every block against the first
copy at once, and only the first copy is aligned with others. Alignments see
line hashes (64 bits); texts are read once to hash and once to cut. Joins are by
key only, so hot keys split at run time.

Defined results: null or empty text has no lines; rows of null ids keep all and
take nothing; rows of one id do not meet; repeated rows are treated alike; very
long texts are read whole; an empty table gives no rows; other columns are
ignored. Blocks are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mapped, stored
from .patience import align, anchored, blocks

RARE = 64
MIN_LINES = 2
MIN_WORDS = 20


def cut(text: bytes) -> tuple[list[bytes], list[int], list[bytes]]:
    """All lines; the indexes of those with a word; these without white space at their ends."""
    lines = text.split(b"\n")
    kept = [(i, s) for i, x in enumerate(lines) if (s := x.strip())]
    return lines, [i for i, _ in kept], [s for _, s in kept]


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, h, words): hashes and numbers of words of each document's lines."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            hs, ns = [], []
            for text in b["text"].to_pylist():
                lines = cut(text)[2]
                hs.append(np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64).view(np.int64))
                ns.append(np.array([len(x.split()) for x in lines], np.int32))
            yield {"doc_id": b["doc_id"].cast(pa.int64()), "th": b["th"], "h": pa.array(hs, pa.list_(pa.int64())), "words": pa.array(ns, pa.list_(pa.int32()))}

    return mapped(docs.select("doc_id", "th", "text"), "doc_id bigint, th bigint, h array<bigint>, words array<int>", run)


def _holders(lines: DataFrame) -> DataFrame:
    """(who, key, least, sub): the holders of each key that brings documents together, with its earliest and their group."""
    single = F.filter(F.transform("h", lambda x, i: F.when(F.get("words", i) >= MIN_WORDS, F.xxhash64(x))), lambda k: k.isNotNull())
    double = F.transform(F.slice("h", 1, F.greatest(F.size("h") - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("h", i + 1)))
    keys = lines.select(F.struct("doc_id", "th").alias("who"), F.explode(F.array_distinct(F.concat(single, double))).alias("key"))
    held = stored(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("who").alias("least")).where("n > 1"))
    subs = F.when(F.col("n") <= RARE, F.lit(1).cast("bigint")).otherwise(F.ceil(F.sqrt("n")))
    # Written, so that the join stands alone and a key of many holders can be split.
    return stored(keys.join(held, "key").select("who", "key", "least", F.pmod(F.xxhash64("who"), subs).alias("sub")))


def meetings(dealt: DataFrame) -> DataFrame:
    """(late, early): which documents, as structs of id and text hash, are aligned."""
    tops = stored(dealt.groupBy("key", "sub").agg(F.min("who").alias("top")))
    met = dealt.join(tops, ["key", "sub"])
    # The earliest of a group, and others of its id, meet the earliest of all.
    early = F.when(F.col("top.doc_id") < F.col("who.doc_id"), F.col("top")).otherwise(F.col("least"))
    return met.select(F.col("who").alias("late"), early.alias("early")).where("early.doc_id < late.doc_id").distinct()


def common(h: list[int], words: list[int], other: list[int]) -> list[tuple[int, int]]:
    """The runs [start, stop) of h that are blocks in common with ``other``."""
    enough = lambda s, e: e - s >= MIN_LINES or sum(words[s:e]) >= MIN_WORDS
    runs = [r for r in blocks(align(h, other)) if enough(*r)]
    return runs + [r for r in anchored(h, other, runs) if enough(*r)]


def _aligned(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, th, h, words, other): the blocks [start, stop) of h to go."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = []
            for doc, th, h, words, other in zip(*(b[n].to_pylist() for n in ("doc_id", "th", "h", "words", "other")), strict=True):
                out += [(doc, th, s, e) for s, e in common(h, words, other)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield {n: pa.array(list(v), pa.int64()) for n, v in zip(("doc_id", "th", "start", "stop"), cols, strict=True)}

    return mapped(pairs, "doc_id bigint, th bigint, start bigint, stop bigint", run)


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, th, blocks): for documents that lose lines; null blocks: all lines, if they are enough for one."""
    lines = stored(_hashed(docs))
    digests = docs.select("doc_id", "th", F.md5("text").alias("digest"))
    firsts = stored(digests.groupBy("digest").agg(F.min("doc_id").alias("least")))
    placed = stored(digests.join(firsts, "digest").select("doc_id", "th", (F.col("doc_id") == F.col("least")).alias("leads")).distinct())
    leads = stored(lines.where(F.size("h") > 0).join(placed.where("leads").select("doc_id", "th"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]))
    partly = _blocks(leads, stored(meetings(_holders(leads))))
    copies = placed.where("NOT leads").select("doc_id", "th").withColumn("blocks", F.lit(None).cast(partly.schema["blocks"].dataType))
    return partly.unionByName(copies)


def _blocks(leads: DataFrame, met: DataFrame) -> DataFrame:
    """(doc_id, th, blocks): what the documents lose by the alignments ``met``."""
    pairs = met.select("late.doc_id", "late.th", F.col("early.doc_id").alias("e_id"), F.col("early.th").alias("e_th"))
    early = leads.select(F.col("doc_id").alias("e_id"), F.col("th").alias("e_th"), F.col("h").alias("other"))
    both = pairs.join(early, ["e_id", "e_th"]).join(leads, ["doc_id", "th"]).select("doc_id", "th", "h", "words", "other")
    return _aligned(both).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("blocks"))


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) for every row of ``docs``; lines without a word stay."""
    texts = docs.select("doc_id", as_bytes()).withColumn("th", F.xxhash64("text"))
    gone = removals(texts.where("doc_id IS NOT NULL")).withColumn("known", F.lit(True))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            n_lines, n_removed, kept = [], [], []
            for text, known, runs in zip(b["text"].to_pylist(), b["known"].to_pylist(), b["blocks"].to_pylist(), strict=True):
                lines, at, own = cut(text)
                goes: set[int] = set()
                if known and runs is None:
                    whole = len(own) >= MIN_LINES or sum(len(x.split()) for x in own) >= MIN_WORDS
                    goes = set(at) if whole else goes
                elif known:
                    goes = {at[i] for r in runs for i in range(r["start"], r["stop"])}
                n_lines.append(len(own))
                n_removed.append(len(goes))
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in goes) if goes else text)
            yield {"doc_id": b["doc_id"].cast(pa.int64()), "n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}

    joined = texts.join(gone, ["doc_id", "th"], "left").select("doc_id", "text", "known", "blocks")
    return mapped(joined, "doc_id bigint, n_lines bigint, n_removed bigint, kept_text string", run)
