"""Tables in a folder that Spark writes: versions that name the data folders they consist of.

A table's data lie in folders that are written once and never changed. A version
is a small file that lists them, by bucket; it is put in place by a rename, so a
reader sees a change whole or not at all, and a reader of an older version is not
disturbed. Tables that grow with the transcripts (``BUCKETED``) lie in buckets by
a hash of the session: an append adds folders, a replacement rewrites only the
buckets that its sessions lie in, and what is asked of some sessions reads no
other bucket. Once ``FAN`` folders of one level have gathered in a bucket they are
merged into one of the next, so a row is rewritten a logarithmic number of times.

One writer at a time: a second that makes the same version fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import KEYS, TABLES

BUCKETS = 64
FAN = 16
#: Tables in buckets, and the column they are dealt by.
BUCKETED = {"session_messages": "session_id", "sessions": "id", "file_state": "session_id", "calls": "session_id"}

Parts = dict[str, list[str]]


class Keys:
    """Sessions (one column, none twice) that several tables are asked for: the buckets they lie in are found once for all tables."""

    def __init__(self, rows: DataFrame):
        self.rows, self.found = rows, {}

    def named(self, column: str) -> DataFrame:
        return self.rows.select(F.col(self.rows.columns[0]).alias(column))


class Store:
    """``buckets``: how many a table gets when it is first written, or written as a whole."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _children(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    # Versions

    def _versions(self, name: str) -> list[int]:
        return [int(x) for x in self._children(f"{self.root}/{name}/versions") if x.isdigit()]

    def _version(self, name: str, number: int | None = None) -> dict:
        """{"buckets": how many, "parts": bucket -> folders, "last": [batch, its folders]}."""
        found = self._versions(name) if number is None else [number]
        if not found:
            return {"buckets": self.buckets, "parts": {}, "last": [None, []]}
        fs, at = self._fs(f"{self.root}/{name}/versions/{found[-1]:08d}")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, name: str, version: dict, keep: int = 2) -> None:
        """The next version; folders that none of the ``keep`` newest names go."""
        top, found = f"{self.root}/{name}", self._versions(name)
        fs, draft = self._fs(f"{top}/versions/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(json.dumps(version).encode())
        out.close()
        _, final = self._fs(f"{top}/versions/{(found[-1] + 1 if found else 1):08d}")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another writer has changed {name}")
        kept = [*found, found[-1] + 1 if found else 1][-keep:]
        for old in found:
            if old not in kept:
                fs.delete(self._fs(f"{top}/versions/{old:08d}")[1], True)
        named = {p.split("/")[0] for n in kept for folders in self._version(name, n)["parts"].values() for p in folders}
        for folder in set(self._children(f"{top}/data")) - named:
            fs.delete(self._fs(f"{top}/data/{folder}")[1], True)

    # Data

    def empty(self, name: str) -> DataFrame:
        # A plan that is empty by its text: joins with it are planned away.
        return self.spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[name])])

    def _shaped(self, rows: DataFrame, name: str) -> DataFrame:
        schema = StructType.fromDDL(TABLES[name])
        have = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def _bucket(self, column: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(buckets)).cast("int")

    def _load(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{name}/data/{x}" for x in folders]) if folders else self.empty(name)

    def _put(self, name: str, rows: DataFrame, buckets: int, level: int = 0) -> Parts:
        """Rows in a new folder: bucket -> its folder."""
        folder, column = f"L{level}-{uuid.uuid4().hex}", BUCKETED.get(name)
        path, shaped = f"{self.root}/{name}/data/{folder}", self._shaped(rows, name)
        if column is None:
            shaped.write.parquet(path)
            return {"0": [folder]}
        # Within a bucket rows lie by session, so a session's rows are found by file statistics.
        dealt = shaped.withColumn("bucket", self._bucket(column, buckets)).repartition("bucket", F.pmod(F.xxhash64(column, F.lit(1)), F.lit(8)))
        dealt.sortWithinPartitions("bucket", *KEYS[name]).write.partitionBy("bucket").parquet(path)
        return {x.removeprefix("bucket="): [f"{folder}/{x}"] for x in self._children(path) if x.startswith("bucket=")}

    def _touched(self, name: str, keys: DataFrame | Keys, buckets: int) -> list[str]:
        """The buckets of ``keys`` (the column that the table is dealt by); as many as there are buckets at most."""
        column, known = BUCKETED[name], keys.found if isinstance(keys, Keys) else {}
        if buckets not in known:
            rows = keys.named(column) if isinstance(keys, Keys) else keys
            known[buckets] = [str(r.b) for r in rows.select(self._bucket(column, buckets).alias("b")).distinct().collect()]
        return known[buckets]

    def _once(self, name: str, keys: DataFrame | Keys) -> DataFrame:
        return keys.named(BUCKETED[name]) if isinstance(keys, Keys) else keys.select(BUCKETED[name]).distinct()

    def _merged(self, name: str, version: dict) -> None:
        """Where FAN folders of a level have gathered they become one of the next."""
        parts, level = version["parts"], 0
        while True:
            own = {b: [p for p in folders if p.startswith(f"L{level}-")] for b, folders in parts.items()}
            full = {b: p for b, p in own.items() if len(p) >= FAN}
            if full:
                made = self._put(name, self._load(name, [x for p in full.values() for x in p]), version["buckets"], level + 1)
                for b, gone in full.items():
                    parts[b] = [p for p in parts[b] if p not in gone] + made.get(b, [])
            elif not any(p.startswith(f"L{n}-") for folders in parts.values() for p in folders for n in range(level + 1, level + 9)):
                return
            level += 1

    def read(self, name: str) -> DataFrame:
        return self._load(name, [p for folders in self._version(name)["parts"].values() for p in folders])

    def of(self, name: str, keys: DataFrame | Keys) -> DataFrame:
        """The rows of ``keys`` in a table in buckets; only the buckets that they lie in are read."""
        version, column = self._version(name), BUCKETED[name]
        touched = self._touched(name, keys, version["buckets"])
        rows = self._load(name, [p for b in touched for p in version["parts"].get(b, [])])
        return rows.join(self._once(name, keys), column, "left_semi")

    def write(self, name: str, rows: DataFrame, keep: int = 2) -> None:
        """``rows`` become the whole table; the versions before, all but the ``keep`` newest, go."""
        self._commit(name, {"buckets": self.buckets, "parts": self._put(name, rows, self.buckets), "last": [None, []]}, keep)

    def append(self, name: str, rows: DataFrame, batch: str | None = None, keys: Keys | None = None) -> None:
        """Rows are added; messages only where their key is not there yet. The last named ``batch`` may come again: it counts once.

        ``keys``: the sessions of messages, where they are known without a look at the rows.
        """
        version = self._version(name)
        if batch is not None and version["last"][0] == batch:
            version["parts"] = {b: [p for p in folders if p not in version["last"][1]] for b, folders in version["parts"].items()}
        if name == "session_messages":
            known = self.of(name, keys or rows.select("session_id")).select(KEYS[name])
            rows = rows.dropDuplicates(KEYS[name]).join(known, KEYS[name], "left_anti")
        self._merged(name, version)  # what was there before: the last batch stays in folders of its own
        made = self._put(name, rows, version["buckets"])
        for b, folders in made.items():
            version["parts"][b] = [*version["parts"].get(b, []), *folders]
        version["last"] = [batch, [p for folders in made.values() for p in folders]]
        self._commit(name, version)

    def has_batch(self, name: str, batch: str | None) -> bool:
        """This batch is the last that was added."""
        return batch is not None and self._version(name)["last"][0] == batch

    def replace(self, name: str, rows: DataFrame, keys: DataFrame | Keys) -> None:
        """All rows of ``keys`` give way to ``rows``; buckets they do not lie in stay untouched and unread."""
        version, column = self._version(name), BUCKETED[name]
        touched = self._touched(name, keys, version["buckets"])
        old = self._load(name, [p for b in touched for p in version["parts"].get(b, [])])
        rest = old.join(self._once(name, keys), column, "left_anti")
        made = self._put(name, rest.unionByName(self._shaped(rows, name)), version["buckets"], level=1)
        for b in touched:
            version["parts"][b] = made.get(b, [])
        self._commit(name, version | {"last": [None, []]})

    def ready(self) -> Store:
        """Singletons written once: settings and the instance's own id."""
        now = F.current_timestamp()
        if not self._versions("instance_metadata"):
            one = self.spark.range(1).select(F.lit(1).alias("id"), F.expr("uuid()").alias("uuid"), F.lit(None).alias("instance_name"), now.alias("created_at"))
            self.write("instance_metadata", one)
            self.write("memory_settings", self.spark.range(1).select(F.lit(1).alias("id"), F.lit(False).alias("model_downloaded"), F.lit(0).alias("total_memories_extracted")))
        return self
