"""Mixing sources to target weights by a low-discrepancy schedule.

1. *Targets*: every source's share of all words by weight, but at most
   ``cap`` times its own size; what is cut off is shared out again by weight.
2. *Schedule*: the mix is a row of slots of equal size. Slot ``i`` stands at the
   golden-ratio point ``frac(i * 0.618...)``, which falls into one source's part
   of the cumulated targets. Any run of slots holds each source in proportion,
   to within a few slots. The ``r``-th slot of a source takes its block
   ``r mod blocks``, in pass ``r div blocks``; slots past ``cap`` passes stay empty.
3. *Blocks*: each source's documents, in an order shuffled by a hash, form one
   stream of words, cut into blocks of equal size (the last may be short).
4. *Small sources*: blocks grow with the corpus. Where they are above the least
   size, a source whose size or target is less than ``FEW`` of them has blocks of
   its own, about ``1 / FEW`` of the lesser; as many as make up its target are
   spread evenly over the row, several to a slot, in place of the slots drawn for
   it. So its words taken are its target to within half a block of its own.

Slots meet blocks in an equi-join on (source, block). A document's words taken
are its overlaps with the blocks taken, once for each time.

Nothing is ranked as a whole: slots are ranked in (source, run of slots) groups
and documents summed in (source, bucket) groups; sums over the small tables of
these groups place each group. So a source with any share of the rows is dealt
out over all tasks. A slot finds its source by an equi-join on a grid of
``GRID`` cells, in place of a range join.

Defined results: null or empty text has size 0 and none of it is taken; a null
source is a source, the last; repeated rows count each; with no words at all
every target is 0; an empty table gives no rows; ties in the shuffle fall to
doc_id, then to a hash of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

GOLDEN = 0.6180339887498949
GRID = 4096
SLOTS = 1 << 18
BLOCK_RANGE = (16, 1 << 16)
FEW = 1024
RUN = 8192
ROWS_PER_BUCKET = 50_000
LEAST_BUCKETS = 256


@dataclass
class Mix:
    """docs: a row per document with its offset in its source's stream; schedule: a row per block taken (for sources of the common block: per slot)."""

    docs: DataFrame
    sources: DataFrame
    schedule: DataFrame
    block: int


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size in words, hash of the text)."""
    return docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_hash"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source_no, source, source_size, target, lo, hi): one row per source, in code point order, null last.

    A source is capped if, at the level where it fills, all that fills no later
    and the others' shares together need no more than there is.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    by_level = W.orderBy("level", "source_no")
    whole = W.partitionBy()
    listed = (
        rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(every) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("most", (F.col("source_size") * cap).cast("double"))
        .withColumn("level", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("full", F.sum("most").over(by_level))
        .withColumn("rest", F.sum("weight").over(whole) - F.sum("weight").over(by_level))
        .withColumn("capped", F.col("full") + F.col("level") * F.col("rest") <= F.col("total"))
    )
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(whole)
    share = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(whole)
    placed = listed.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * left / share))
    to_here = W.orderBy("source_no")
    hi = F.sum("target").over(to_here) / F.when(F.col("total") > 0, F.col("total")).otherwise(1)
    last = F.col("source_no") == F.max("source_no").over(whole)
    return placed.withColumn("hi", F.when(last, F.lit(1.0)).otherwise(hi)).withColumn("lo", F.coalesce(F.lag("hi").over(to_here), F.lit(0.0))).select(
        "source_no", "source", "source_size", "target", "lo", "hi"
    )


def steps(sources: DataFrame, block: int) -> DataFrame:
    """``sources`` with step: the block of each source."""
    least = F.least(F.col("source_size").cast("double"), "target")
    few = (least < FEW * block) & F.lit(block > BLOCK_RANGE[0])
    return sources.withColumn("step", F.when(few, F.greatest(F.floor(least / FEW), F.lit(1))).otherwise(F.lit(block)).cast("bigint"))


def _own(small: DataFrame, slots: int, cap: int) -> DataFrame:
    """(slot, source_no, pass, block) of sources with blocks of their own, as many as make up the target."""
    blocks = F.ceil(F.col("source_size") / F.col("step"))
    full = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))
    n = F.least(full * blocks + F.round((F.col("target") - full * F.col("source_size")) / F.col("step")), blocks * cap).cast("bigint")
    each = small.where("source_size > 0").select("source_no", blocks.alias("blocks"), n.alias("n")).where("n > 0")
    ranked = each.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return ranked.select(F.floor((F.col("rank") + 0.5) * slots / F.col("n")).alias("slot"), "source_no", F.floor(F.col("rank") / F.col("blocks")).alias("pass"), (F.col("rank") % F.col("blocks")).alias("block"))


def schedule(sources: DataFrame, slots: int, block: int, cap: int) -> DataFrame:
    """(slot, source_no, pass, block): what each slot takes."""
    spark = sources.sparkSession
    cells = sources.where((F.col("hi") > F.col("lo")) & (F.col("step") == block)).select(
        "source_no", "source_size", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)))).alias("cell"),
    )
    point = F.col("id") * GOLDEN
    at = spark.range(slots).withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * GRID)).withColumn("run", F.floor(F.col("id") / RUN))
    drawn = at.join(cells, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("id", "run", "source_no", "source_size")
    before = W.partitionBy("source_no").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = drawn.groupBy("source_no", "run").agg(F.count("*").alias("n")).select("source_no", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = drawn.withColumn("place", F.row_number().over(W.partitionBy("source_no", "run").orderBy("id"))).join(runs, ["source_no", "run"])
    rank, blocks = F.col("first") + F.col("place") - 1, F.ceil(F.col("source_size") / block)
    common = ranked.select(F.col("id").alias("slot"), "source_no", F.floor(rank / blocks).alias("pass"), (rank % blocks).alias("block")).where(F.col("pass") < cap)
    return common.unionByName(_own(sources.where(F.col("step") < block), slots, cap))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 0) -> Mix:
    rows = stored(sizes(docs))  # narrow: no text
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    block = min(max(total // SLOTS, BLOCK_RANGE[0]), BLOCK_RANGE[1])
    sources = stored(steps(targets(rows, weights, cap), block))  # a row per source
    buckets = max(LEAST_BUCKETS, -(-n // ROWS_PER_BUCKET))
    known = rows.join(sources.select("source_no", "source", "source_size", "target", "step"), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    name = F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("text_hash"))
    draw = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("bigint")
    dealt = known.withColumn("draw", draw).withColumn("bucket", F.col("draw") % buckets)
    before = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    first = dealt.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).select("source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = W.partitionBy("source_no", "bucket").orderBy("draw", F.col("doc_id").asc_nulls_last(), "text_hash", "size")
    own = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    placed = dealt.withColumn("own", own).join(first, ["source_no", "bucket"]).withColumn("start", F.col("first") + F.col("own"))
    return Mix(placed.select("doc_id", "text_hash", "source_no", "size", "source_size", "target", "step", "start"), sources, schedule(sources, -(-total // block), block, cap), block)


def taken(m: Mix) -> DataFrame:
    """(doc_id, text_hash, size, source_size, target, taken): a row per document."""
    times = m.schedule.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    end = F.col("start") + F.col("size")
    parts = m.docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("step")), F.floor((end - 1) / F.col("step")))))
    words = F.least(end, (F.col("block") + 1) * F.col("step")) - F.greatest(F.col("start"), F.col("block") * F.col("step"))
    got = (
        parts.withColumn("words", words).join(times, ["source_no", "block"], "left")
        .groupBy("source_no", "start", "doc_id", "text_hash", "size", "source_size", "target")
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("bigint").alias("taken"))
    )
    columns = ["doc_id", "text_hash", "size", "source_size", "target", "taken"]
    return got.select(columns).unionByName(m.docs.where("size = 0").withColumn("taken", F.lit(0).cast("bigint")).select(columns))


def copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The mix in whole documents: each row of ``docs`` as often as ``taken / size``, rounded, half up.

    Only documents at the ends of a source's blocks are taken in part. Rows of
    equal id and text share what is taken of them evenly.
    """
    times = F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int")
    got = taken(mix(docs, weights, cap)).where("taken > 0").groupBy("doc_id", "text_hash").agg(times.alias("times")).where("times > 0")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("own_hash"))
    on = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
    return keyed.join(got, on).select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
