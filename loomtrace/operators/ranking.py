"""Ranking: scores and state transitions of memories, all projects in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import Limits, Weights, memory_score, next_state, transition_reason


def batch(memories: DataFrame, now: Column, newest: int | None = None) -> DataFrame:
    """Memories that are not removed; a missing time counts as now; at most ``newest`` per project if given."""
    live = memories.where("state <> 'removed'").withColumn("extracted_at", F.coalesce("extracted_at", now))
    if newest is None:
        return live
    order = W.partitionBy("project_id").orderBy(F.desc("extracted_at"), F.desc("id"))
    return live.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= newest).drop("_n")


def evaluate(memories: DataFrame, now: Column, weights: Weights = Weights(), limits: Limits = Limits()) -> DataFrame:
    """memories with score, to_state (null: stays) and reason."""
    scored = memories.withColumn("score", memory_score(now, weights))
    moved = scored.withColumn("to_state", next_state(now, F.col("score"), limits))
    return moved.withColumn("reason", transition_reason(now, F.col("score"), F.col("to_state"), limits))


def apply(memories: DataFrame, now: Column, **settings) -> DataFrame:
    """All memories after one sweep."""
    moved = evaluate(batch(memories, now), now, **settings).where("to_state IS NOT NULL").select("id", "to_state")
    return memories.join(moved, "id", "left").withColumn("state", F.coalesce("to_state", "state")).drop("to_state").select(memories.columns)


def report(evaluated: DataFrame) -> DataFrame:
    """By project: how many moved up, down, out or stayed, and the moves with their reasons."""
    to = F.col("to_state")
    move = F.when(to.isNotNull(), F.struct(F.col("id").alias("memory_id"), F.col("state").alias("from_state"), "to_state", "score", "reason"))
    return evaluated.groupBy("project_id").agg(
        F.count("*").alias("memories_evaluated"), F.count_if(to == "high").alias("promoted"), F.count_if(to == "low").alias("demoted"), F.count_if(to == "removed").alias("removed"),
        F.count_if(to.isNull()).alias("unchanged"), F.array_sort(F.collect_list(move)).alias("transitions"),
    )


def state_counts(memories: DataFrame) -> DataFrame:
    """By project and state, with the mean confidence of those not removed."""
    return memories.groupBy("project_id", "state").agg(F.count("*").alias("n"), F.avg(F.when(F.col("state") != "removed", F.col("confidence"))).alias("avg_confidence"))
