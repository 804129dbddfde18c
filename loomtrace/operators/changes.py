"""Row changes as joins: upserts, patches, cascading deletes, ids, validation. Each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CHECKS, CHILDREN, KEYS
from .staging import stored


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """``new`` rows take the place of ``old`` ones of their key, but for the columns in ``keep``."""
    if not keep:
        return old.join(new.select(keys), keys, "left_anti").unionByName(new)
    n = new.select(*keys, F.struct([c for c in new.columns if c not in keys]).alias("_new"))
    o = old.select(*keys, F.struct([c for c in old.columns if c not in keys]).alias("_old"))
    both = o.join(n, keys, "full_outer")
    value = lambda c: F.when(F.col("_old").isNotNull() & F.lit(c in keep), F.col(f"_old.{c}")).when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The ``new`` rows whose key ``old`` has not, one per key."""
    return new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti")


def replace_for(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` are replaced by ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def patch(old: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return old.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(tables: dict[str, DataFrame], name: str, where: Column) -> dict[str, DataFrame]:
    """The tables without the rows that match and without what belongs to them."""
    out = dict(tables)
    key = KEYS[name][0]
    gone = tables[name].where(where).select(key)
    out[name] = tables[name].join(gone, key, "left_anti").select(tables[name].columns)
    todo = [(name, gone)]
    while todo:
        parent, ids = todo.pop()
        for child, column in CHILDREN.get(parent, ()):
            if child not in out:
                continue
            mine = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
            if child in CHILDREN:
                todo.append((child, out[child].join(mine, column, "left_semi").select(KEYS[child][0])))
            out[child] = out[child].join(mine, column, "left_anti").select(out[child].columns)
    return out


def numbered(new: DataFrame, old: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """``new`` with ids that follow the largest of ``old``; ranked in buckets, no sort of the whole."""
    first = F.coalesce(old.agg(F.max(key)).scalar(), F.lit(0))
    # Written, as the buckets are the partitions of this one run.
    spread = stored(new.withColumn("_b", F.spark_partition_id()).withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(*order))))
    sizes = spread.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_f"))
    return spread.join(F.broadcast(before), "_b").withColumn(key, (first + F.col("_f") + F.col("_r")).cast("bigint")).drop("_b", "_r", "_f")


def violations(table: DataFrame, name: str) -> DataFrame:
    """Rows that hold what a checked column may not, or a key twice."""
    bad = F.lit(False)
    for (t, c), allowed in CHECKS.items():
        if t == name:
            bad = bad | (F.col(c).isNotNull() & ~F.col(c).isin(*allowed))
    keys = KEYS[name]
    twice = table.groupBy(keys).count().where("count > 1").select(keys)
    return table.where(bad).unionByName(table.join(twice, keys, "left_semi"))


def merged_session(old: DataFrame, new: DataFrame) -> DataFrame:
    """A full read of a file: what the reader found replaces what was stored, but not title, project, path or creation."""
    return upsert(old, new, ["id"], ["title", "created_at", "project_id", "file_path", "title_edited", "title_ai_generated", "is_hidden", "archived_file_path", "archived_at", "memories_extracted_at", "memories_extracted_count", "skills_extracted_at", "skills_extracted_count"])


def grown_session(old: DataFrame, more: DataFrame) -> DataFrame:
    """A read on: counts add up and flags stay set. ``more``: id, message_count, has_code, has_errors, file_size, indexed_at."""
    m = more.select("id", F.struct([c for c in more.columns if c != "id"]).alias("_m"))
    hit = F.col("_m").isNotNull()
    return old.join(m, "id", "left").withColumns({
        "message_count": F.when(hit, F.coalesce("message_count", F.lit(0)) + F.col("_m.message_count")).otherwise(F.col("message_count")),
        "has_code": F.when(hit, F.coalesce("has_code", F.lit(False)) | F.col("_m.has_code")).otherwise(F.col("has_code")),
        "has_errors": F.when(hit, F.coalesce("has_errors", F.lit(False)) | F.col("_m.has_errors")).otherwise(F.col("has_errors")),
        "file_size": F.when(hit, F.col("_m.file_size")).otherwise(F.col("file_size")),
        "indexed_at": F.when(hit, F.col("_m.indexed_at")).otherwise(F.col("indexed_at")),
    }).drop("_m").select(old.columns)


def appended(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Messages appended by hand: numbered on from the largest, the first of a session 1. ``new``: session_id, place, ..."""
    top = stored.groupBy("session_id").agg(F.max("sequence_num").alias("_top"))
    order = W.partitionBy("session_id").orderBy("place")
    return new.join(top, "session_id", "left").withColumn("sequence_num", (F.coalesce("_top", F.lit(0)) + F.row_number().over(order)).cast("bigint")).drop("_top", "place")


def agent_summaries(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (session, path) for a helper's tokens, updated or added. ``new``: session_id, tool_summary, tokens."""
    mine = F.col("tool_name") == "agent_summary"
    key = ["session_id", "tool_summary"]
    fresh = new.select(*key, F.struct([c for c in new.columns if c not in key]).alias("_n"))
    changed = stored.where(mine).join(fresh, key).select(*[F.col(f"_n.{c}").alias(c) if c in new.columns and c not in key else F.col(c) for c in stored.columns])
    rest = stored.where(~F.coalesce(mine, F.lit(False))).unionByName(stored.where(mine).join(fresh, key, "left_anti"))
    added = new.join(stored.where(mine).select(key), key, "left_anti").withColumn("place", F.col("tool_summary")).withColumn("tool_name", F.lit("agent_summary")).withColumn("role", F.lit("system"))
    return rest.unionByName(changed).unionByName(appended(stored, added), allowMissingColumns=True)


def with_access(memories: DataFrame, access: DataFrame) -> DataFrame:
    """Memories with the access log (memory_id, accessed_at) folded in."""
    seen = access.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("_n"), F.max("accessed_at").alias("_t"))
    return memories.join(seen, "id", "left").withColumns({
        "access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
        "last_accessed_at": F.greatest("last_accessed_at", "_t"),
    }).drop("_n", "_t").select(memories.columns)


def track(ids: DataFrame, now: Column) -> DataFrame:
    """Rows for the access log."""
    return ids.select(F.col(ids.columns[0]).alias("memory_id"), now.alias("accessed_at"))


def new_projects(sessions: DataFrame, projects: DataFrame, now: Column) -> DataFrame:
    """A project for each folder not known yet, temporary ones left out. ``sessions``: folder_path, folder."""
    from ..functions.text import is_temp_folder, project_name

    fresh = sessions.where(~is_temp_folder(F.col("folder"))).select("folder_path", "folder").dropDuplicates(["folder_path"]).join(projects.select("folder_path"), "folder_path", "left_anti")
    return fresh.select(F.sha2("folder_path", 256).substr(1, 32).alias("id"), project_name(F.col("folder")).alias("name"), "folder_path", F.lit(True).alias("auto_sync"), F.lit(0).cast("bigint").alias("longest_streak"), now.alias("created_at"), now.alias("updated_at"))


def contexts_for(sessions: DataFrame, contexts: DataFrame, now: Column) -> DataFrame:
    """An empty context for sessions without one. ``sessions``: session_id, project_id."""
    none = F.array().cast("array<string>")
    fresh = sessions.dropDuplicates(["session_id"]).join(contexts.select("session_id"), "session_id", "left_anti")
    return fresh.select("session_id", "project_id", F.lit(None).cast("string").alias("active_task"), none.alias("recent_decisions"), none.alias("open_questions"), F.lit(None).cast("string").alias("resume_context"), F.lit("startup").alias("source"), now.alias("created_at"), now.alias("updated_at"))


def lifeboat(contexts: DataFrame, session_id: str, summary: str | None, now: Column) -> DataFrame:
    """Keep a summary for resuming; by default the active task, the number of decisions and the open questions."""
    made = F.concat_ws(
        ". ", F.concat(F.lit("Task: "), F.col("active_task")), F.when(F.size("recent_decisions") > 0, F.concat(F.size("recent_decisions").cast("string"), F.lit(" decisions"))),
        F.when(F.size("open_questions") > 0, F.concat(F.lit("Open: "), F.array_join("open_questions", "; "))),
    )
    return patch(contexts, F.col("session_id") == session_id, resume_context=F.lit(summary) if summary is not None else made, updated_at=now)
