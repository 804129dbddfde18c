"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The tree has three levels: regions, racks, shards. At each level a row draws one
number per child, from the md5 of its id and the child's name, and takes the
child with the least ``-ln(u) / weight`` (weighted rendezvous hashing): child
``c`` wins with probability ``weight(c) / sum of weights``. If one child's weight
grows, rows move only into that child; so a change of weights moves rows only
within subtrees whose weight changed. A tree is *grown* by a region of its own
for the new shard: rows then move into the new shard and nowhere else, which is
the law called ``key``: the id and the tree decide, and nothing about other rows.

Slots are gapless within each shard. No shard is ever sorted as a whole: rows
are ranked in (shard, bucket) groups, and the buckets' counts, summed up in
order, give each group its first slot. Buckets grow in number with the rows, so
groups stay small however large or uneven the shards are.

Defined results: null ids draw as empty text; null text has size 1 and crc32 0;
repeated rows get one slot each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Rack = dict[int, float]
Region = dict[str, Rack]

ROWS_PER_BUCKET = 50_000
LEAST_BUCKETS = 256


@dataclass(frozen=True)
class Tree:
    """regions: region -> rack -> shard -> weight. A node weighs what is below it."""

    regions: dict[str, Region]

    @classmethod
    def regular(cls, regions: int, racks: int, shards: int) -> Tree:
        return cls({
            f"g{g}": {f"g{g}.r{r}": {(g * racks + r) * shards + s: 1.0 for s in range(shards)} for r in range(racks)}
            for g in range(regions)
        })

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own."""
        n = sum(len(rack) for region in self.regions.values() for rack in region.values())
        return Tree(self.regions | {f"g+{n}": {f"g+{n}.r0": {n: weight}}})

    def levels(self) -> list[dict[str, dict[str, float]]]:
        """For each level: node -> child -> weight. Shards are named by their number."""
        racks = {rack: {str(s): w for s, w in shards.items()} for region in self.regions.values() for rack, shards in region.items()}
        regions = {g: {r: sum(racks[r].values()) for r in region} for g, region in self.regions.items()}
        return [{"": {g: sum(x.values()) for g, x in regions.items()}}, regions, racks]


def draw(key: Column, child: Column) -> Column:
    """A number in (0, 1) from 52 bits of md5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), child).cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def descend(key: Column, tree: Tree) -> list[Column]:
    """The region, rack and shard (as strings) of ``key``."""
    path: list[Column] = []
    node = F.lit("")
    for level in tree.levels():
        children = F.create_map(*[x for name, below in level.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(w)).alias("w")) for c, w in below.items()]))])
        draws = F.transform(F.element_at(children, node), lambda x: F.struct((-F.ln(draw(key, x["c"])) / x["w"]).alias("d"), x["c"].alias("c")))
        node = F.array_min(draws)["c"]
        path.append(node)
    return path


def shard_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """Each row of (doc_id, text): its size, crc32, path, shard and slot, and its shard in the ``grown`` tree."""
    ids = docs.select("doc_id")
    buckets = max(LEAST_BUCKETS, -(-ids.count() // ROWS_PER_BUCKET))
    key = shard_key()
    bucket = (F.conv(F.substring(F.md5(F.concat(F.lit("slot/"), key).cast("binary")), 1, 13), 16, 10).cast("bigint") % buckets).alias("bucket")

    # Only ids are read here.
    counts = ids.select(descend(key, tree)[2].cast("int").alias("shard"), bucket).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    region, rack, leaf = descend(key, tree)
    rows = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        region.alias("region"), rack.alias("rack"), leaf.cast("int").alias("shard"),
        (descend(key, grown)[2].cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
        bucket,
    )
    place = W.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    ranked = rows.withColumn("place", F.row_number().over(place))
    return ranked.join(first, ["shard", "bucket"]).withColumn("slot", (F.col("first") + F.col("place") - 1).cast("bigint")).drop("bucket", "first", "place")
