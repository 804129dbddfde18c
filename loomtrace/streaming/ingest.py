"""Incremental ingest: new lines into messages, sessions, projects, file state and events.

`apply_lines` takes one batch of lines, wherever they come from: a streaming
micro-batch of the tail source or a poll by file sizes. It may run twice on the
same batch: messages are added by key, and sessions are rolled up from what is
stored, so nothing is counted twice; events of a batch are told once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tool_display
from ..operators import changes, rollups
from ..operators.extract import Policy
from ..operators.store import Keys, Store
from ..sources import lines as src
from ..sources.messages import Format, errors, of_tool
from ..sources.tail_source import TailSource


#: What is told of a session, by name.
EVENTS = {"new": "session:new", "changed": "session:changed", "parsed": "session:parsed", "error": "watcher:error"}


def sessions_from(messages: DataFrame, files: DataFrame, tool: str, now: Column) -> DataFrame:
    """Session rows rolled up from messages, and max_sequence. ``files``: session_id, path, file_size; other columns stay."""
    both = files.join(rollups.whole(messages), "session_id", "left")
    others = [c for c in files.columns if c not in ("session_id", "path", "file_size")]
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return both.select(
        F.col("session_id").alias("id"), F.sha2(folder, 256).substr(1, 32).alias("project_id"), F.col("path").alias("file_path"),
        F.coalesce("title", F.lit("Untitled session")).alias("title"), tool_display(F.lit(tool)).alias("ai_tool"), F.coalesce("total_events", F.lit(0)).alias("message_count"), "duration_ms",
        F.coalesce("has_code", F.lit(False)).alias("has_code"), F.coalesce("has_errors", F.lit(False)).alias("has_errors"), "file_size", F.lit(False).alias("title_edited"), F.lit(False).alias("title_ai_generated"),
        F.lit("success").alias("import_status"), F.lit(False).alias("is_hidden"), F.coalesce(F.try_to_timestamp("start_time"), now).alias("created_at"), now.alias("indexed_at"),
        F.coalesce("max_sequence", F.lit(-1)).alias("max_sequence"), *others,
    )


def apply_lines(store: Store, batch: DataFrame, tool: str, now: Column | None = None, batch_id: str | None = None) -> None:
    """batch: session_id, path, line_no, byte_offset, byte_length, line, restarted.

    Reads and rewrites only the buckets that the batch's sessions lie in. A batch that comes again under its
    ``batch_id``, after a failure, leaves what it left before.
    """
    fmt: Format | None = of_tool(tool)
    if fmt is None:
        raise ValueError(f"no format for tool {tool!r}")
    now = F.current_timestamp() if now is None else now
    # What is kept in memory is let go at the end: Spark would take it for the next batch's, read from the same paths.
    batch = batch.persist()
    kept = [batch]
    try:
        touched = batch.groupBy("session_id").agg(F.first("path").alias("path"), F.bool_or("restarted").alias("restarted"), F.max(F.col("byte_offset") + F.col("byte_length")).alias("file_size"), (F.max("line_no") + 1).alias("next_line")).persist()
        kept.append(touched)
        keys = Keys(touched.select("session_id"))
        restarted = touched.where("restarted").select("session_id")
        # Calls that later batches may answer; of calls noted twice (a file read anew) the latest counts.
        own = fmt.calls(batch).persist()
        kept.append(own)
        earlier = store.of("calls", keys).groupBy("session_id", "id").agg(F.max_by(F.struct("call_name", "call_input", "is_call", "line_no"), "line_no").alias("c")).select("session_id", "id", "c.*")
        messages = fmt.parse(batch, earlier, own)
        if not restarted.isEmpty():
            messages = messages.persist()  # else they are read once
            kept.append(messages)
            store.replace("session_messages", messages.join(restarted, "session_id", "left_semi"), restarted)
        store.append("session_messages", messages, keys=keys)
        store.append("calls", own, batch_id)

        fresh = sessions_from(store.of("session_messages", keys), touched, tool, now).persist()
        kept.append(fresh)
        old = store.of("sessions", keys)
        if not store.has_batch("service_events", batch_id):  # told before the sessions are written, so that what was new is told as new
            known = keys.named("id").join(old.select("id", F.lit(True).alias("known")), "id", "left")
            told = known.select(F.when(F.col("known"), EVENTS["changed"]).otherwise(EVENTS["new"]).alias("event"), F.col("id").alias("session_id"), F.lit("{}").alias("payload"), now.alias("at"))
            read = fresh.select(F.lit(EVENTS["parsed"]).alias("event"), F.col("id").alias("session_id"), F.to_json(F.struct("message_count")).alias("payload"), now.alias("at"))
            bad = errors(batch).groupBy("session_id").agg(F.count("*").alias("lines")).select(F.lit(EVENTS["error"]).alias("event"), "session_id", F.to_json(F.struct("lines")).alias("payload"), now.alias("at"))
            store.append("service_events", told.unionByName(read).unionByName(bad), batch_id)
        store.replace("sessions", changes.merged_session(old, store._shaped(fresh, "sessions")), keys)
        folders = fresh.select(F.regexp_replace("file_path", "/[^/]*$", "").alias("folder_path")).distinct().withColumn("folder", F.element_at(F.split("folder_path", "/"), -1))
        projects = changes.new_projects(folders, store.read("projects"), now)
        if not projects.isEmpty():
            store.append("projects", projects)
        state = fresh.withColumns({"path": F.col("file_path"), "session_id": F.col("id")})
        store.replace("file_state", changes.upsert(store.of("file_state", keys), store._shaped(state, "file_state"), ["path"]), keys)
    finally:
        for frame in reversed(kept):
            frame.unpersist()


def poll(spark: SparkSession, folder: str, store: Store, tool: str, now: Column | None = None) -> DataFrame:
    """One round over the folder by names and sizes, for any store that Spark reads. Returns what each file needed."""
    path = f"{store.root}/last_poll"
    src.changes(spark, folder, store.read("file_state")).write.mode("overwrite").parquet(path)
    changed = spark.read.parquet(path)
    wanted = changed.where("action <> 'skip'")
    if not wanted.isEmpty():
        apply_lines(store, src.read_changes(spark, folder, wanted).withColumn("restarted", F.col("action") == "full"), tool, now)
    return changed.select("path", "new_size", "action")


def watch(spark: SparkSession, folder: str, store: Store, tool: str, checkpoint: str, seconds: float = 0.2, once: bool = False) -> StreamingQuery:
    """Follow the folder; every micro-batch goes through `apply_lines`."""
    spark.dataSource.register(TailSource)
    stream = spark.readStream.format("jsonl_tail").load(folder)
    writer = stream.writeStream.foreachBatch(lambda batch, n: apply_lines(store, batch, tool, batch_id=f"{checkpoint}/{n}") if not batch.isEmpty() else None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def idle_windows(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Session windows: a gap longer than ``gap`` begins a new one. Works on streams and tables."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def least_recent_out(sessions: DataFrame, keep: int = 100, per_session: int = 50) -> DataFrame:
    """The sessions that a store bounded in memory keeps: those accessed last."""
    from pyspark.sql import Window as W

    return sessions.withColumn("_n", F.row_number().over(W.orderBy(F.desc("last_accessed"), "id"))).where(F.col("_n") <= keep).drop("_n")


def due(sessions: DataFrame, last: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(id, title, extraction): which sessions want model work now. ``last``: id, last_count."""
    both = sessions.join(last, "id", "left")
    found = both.select("id", policy.wants_title().alias("title"), policy.wants_extraction(F.col("last_count")).alias("extraction"))
    return found.where("title OR extraction")
