"""Analytics over sessions and messages. Messages are summed up before they meet sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


def visible(sessions: DataFrame, include_hidden: bool = False) -> DataFrame:
    return sessions if include_hidden else sessions.where(~F.coalesce("is_hidden", F.lit(False)))


def total(column: str | Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def counts() -> list[Column]:
    role, tool = F.col("role"), F.col("tool_name").isNotNull()
    return [
        F.count("*").alias("total_messages"), F.count_if("has_error").alias("messages_with_errors"),
        F.count_if(role == "user").alias("user_messages"), F.count_if(role == "assistant").alias("assistant_messages"),
        F.count_if((role == "assistant") & tool).alias("tool_uses"), F.count_if((role == "user") & tool).alias("tool_results"),
        *[total(c).alias(c) for c in TOKENS],
    ]


def per_session(messages: DataFrame) -> DataFrame:
    """One row per session with messages: the base of all that follows."""
    return messages.groupBy("session_id").agg(*counts())


COUNTED = ("total_messages", "messages_with_errors", "user_messages", "assistant_messages", "tool_uses", "tool_results", *TOKENS)


def with_counts(sessions: DataFrame, messages: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Visible sessions with their sums, zero for sessions without messages."""
    own = per_session(messages).withColumnRenamed("session_id", "id")
    return visible(sessions, include_hidden).join(own, "id", "left").fillna(0, list(COUNTED))


def project_stats(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return with_counts(sessions, messages).groupBy("project_id").agg(F.count("*").alias("total_sessions"), total("duration_ms").alias("total_duration_ms"), *[F.sum(c).cast("bigint").alias(c) for c in COUNTED])


def models_used(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(project_id, model, n), models unknown left out."""
    own = messages.where("model IS NOT NULL").groupBy("session_id", "model").agg(F.count("*").alias("n"))
    return own.join(visible(sessions).select(F.col("id").alias("session_id"), "project_id"), "session_id").groupBy("project_id", "model").agg(F.sum("n").cast("bigint").alias("n"))


def session_metrics(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return with_counts(sessions, messages).select("project_id", F.col("id").alias("session_id"), "created_at", "duration_ms", "input_tokens", "output_tokens", F.col("total_messages").alias("message_count"), "user_messages", "assistant_messages", "tool_uses")


def _day() -> Column:
    return F.to_date("created_at").alias("date")


def active_dates(sessions: DataFrame) -> DataFrame:
    return visible(sessions).where("created_at IS NOT NULL").select("project_id", _day()).distinct()


def longest_streak(sessions: DataFrame) -> DataFrame:
    """(project_id, longest_streak): the most days in a row."""
    from pyspark.sql import Window as W

    days = active_dates(sessions)
    island = F.date_sub("date", F.row_number().over(W.partitionBy("project_id").orderBy("date")))
    return days.withColumn("island", island).groupBy("project_id", "island").agg(F.count("*").alias("n")).groupBy("project_id").agg(F.max("n").alias("longest_streak"))


def daily_tokens(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """By day of the session, not of the message; cached tokens are not in the total."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in TOKENS]
    return with_counts(sessions, messages).groupBy("project_id", _day()).agg(*sums).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def daily_errors(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return with_counts(sessions, messages).groupBy("project_id", _day()).agg(F.sum("messages_with_errors").cast("bigint").alias("error_count")).where("error_count > 0")


def daily_vibe(sessions: DataFrame, messages: DataFrame, parity: bool = False) -> DataFrame:
    """parity: a session's duration counts once for each of its messages, as the older service had it."""
    times = F.greatest("total_messages", F.lit(1)) if parity else F.lit(1)
    return with_counts(sessions, messages).groupBy("project_id", _day()).agg(
        F.sum("total_messages").cast("bigint").alias("total_messages"), F.sum("user_messages").cast("bigint").alias("user_messages"),
        total(F.col("duration_ms") * times).alias("duration_ms"), *[F.sum(c).cast("bigint").alias(c) for c in TOKENS],
    )


def memory_stats(memories: DataFrame) -> DataFrame:
    """Counts, validation, confidence and sessions of memories not removed, in one pass."""
    return memories.where("state <> 'removed'").groupBy("project_id").agg(
        F.count("*").alias("total"), F.count_if("is_validated").alias("validated"), F.avg("confidence").alias("avg_confidence"), F.count_distinct("session_id").alias("sessions"),
        *[F.count_if(F.col("memory_type") == t).alias(t) for t in ("decision", "fact", "preference", "context", "task")],
    )


def top_tags(memories: DataFrame, k: int = 25) -> DataFrame:
    """Tags trimmed and in lower case; ties by tag."""
    each = memories.where("state <> 'removed'").where(F.size("tags") > 0).select(F.explode("tags").alias("tag"))
    return each.select(F.lower(F.trim("tag")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def skill_stats(skills: DataFrame) -> DataFrame:
    return skills.groupBy("project_id").agg(F.count("*").alias("total"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("name").alias("names"))


def skill_list(skills: DataFrame, links: DataFrame, sessions: DataFrame, order: str = "frequency", limit: int = 20, offset: int = 0) -> DataFrame:
    """Skills with their distinct sessions, own first. The order by frequency counts 1 + links; the figure shown counts sessions."""
    title = sessions.select(F.col("id").alias("session_id"), "title")
    own = skills.select(F.col("id").alias("skill_id"), "session_id", F.lit(0).alias("place"))
    every = own.unionByName(links.select("skill_id", "session_id", F.lit(1).alias("place"))).groupBy("skill_id", "session_id").agg(F.min("place").alias("place"))
    listed = every.join(title, "session_id", "left").groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct("place", "session_id", "title"))).alias("sessions"))
    count = links.groupBy("skill_id").agg((F.count("*") + 1).alias("by_links"))
    rows = skills.withColumnRenamed("id", "skill_id").join(listed, "skill_id", "left").join(count, "skill_id", "left").withColumn("by_links", F.coalesce("by_links", F.lit(1))).withColumn("frequency", F.size("sessions"))
    orders = {"frequency": [F.desc("by_links")], "date_newest": [F.desc("extracted_at")], "date_oldest": [F.asc("extracted_at")], "confidence": [F.desc("confidence")]}
    return rows.orderBy(*orders.get(order, orders["frequency"]), "skill_id").offset(offset).limit(limit)
