"""Per-session rollups: counts and tokens; start, end, active time, model and title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cut_bytes

IDLE_MS = 30 * 60 * 1000


def _stats() -> list[Column]:
    role, tool = F.col("role"), F.col("tool_type").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return [
        F.count("*").alias("total_events"),
        F.count_if((role == "user") & ~tool).alias("human_messages"),
        F.count_if((role == "assistant") & ~tool).alias("assistant_messages"),
        F.count_if(role.isin("user", "assistant") & tool).alias("tool_uses"),
        F.bool_or("has_code").alias("has_code"), F.bool_or("has_error").alias("has_errors"),
        total("input_tokens").alias("total_input_tokens"), total("output_tokens").alias("total_output_tokens"),
        total("cache_read_tokens").alias("total_cache_read_tokens"), total("cache_creation_tokens").alias("total_cache_creation_tokens"),
    ]


TITLE_BYTES = 80


def _timed(messages: DataFrame, key: str) -> DataFrame:
    """With times, the gap before each, and what a title may be made of. Dealt by the key alone, as the sums by key are: one shuffle, and of texts no more than a title's length."""
    timed = (F.col("role") != "system") & F.col("ts").isNotNull()
    title = (F.col("role") == "user") & F.col("tool_type").isNull()
    # One character more than the bytes of a title is cut as the whole text is.
    rows = messages.withColumns({"timed": timed, "ms": F.unix_millis("ts"), "head": F.when(title, F.left("search_content", F.lit(TITLE_BYTES + 1)))})
    by_time = W.partitionBy(key).orderBy("timed", "ms", "sequence_num")
    return rows.withColumn("gap", F.when(F.col("timed") & F.lag("timed").over(by_time), F.col("ms") - F.lag("ms").over(by_time)))


def _metadata() -> list[Column]:
    timed, title = F.col("timed"), (F.col("role") == "user") & F.col("tool_type").isNull()
    return [
        F.min_by("timestamp", F.when(timed, F.col("sequence_num"))).alias("start_time"),
        F.max_by("timestamp", F.when(timed, F.col("sequence_num"))).alias("end_time"),
        F.when(F.count_if(timed) > 1, F.coalesce(F.sum(F.when(F.col("gap") <= IDLE_MS, F.col("gap"))), F.lit(0))).cast("bigint").alias("duration_ms"),
        F.min_by("model", F.when(F.col("model").isNotNull(), F.col("sequence_num"))).alias("model"),
        cut_bytes(F.min_by("head", F.when(title, F.col("sequence_num"))), TITLE_BYTES).alias("title"),
    ]


def stats(messages: DataFrame, key: str = "session_id") -> DataFrame:
    return messages.groupBy(key).agg(*_stats())


def metadata(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """Gaps over 30 minutes do not count as active; fewer than two times give no duration."""
    return _timed(messages, key).groupBy(key).agg(*_metadata())


def whole(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """`stats`, `metadata` and max_sequence in one pass over the messages."""
    return _timed(messages, key).groupBy(key).agg(*_stats(), *_metadata(), F.max("sequence_num").alias("max_sequence"))
