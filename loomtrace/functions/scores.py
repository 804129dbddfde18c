"""Scores: similarity, retrieval and ranking as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets: two empty ones are alike, one empty one is unlike all."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty or a norm vanishes."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    void = (F.size(a) != F.size(b)) | (F.size(a) == 0) | (na < 1e-9) | (nb < 1e-9)
    return F.when(void, 0.0).otherwise(dot(a, b) / (na * nb))


def relevance(bm25: Column) -> Column:
    """1 / (1 + |score|): falls as the match gets better; kept for compatibility beside ``bm25``."""
    return 1 / (1 + F.abs(bm25))


def whole_days(now: Column, then: Column) -> Column:
    """Whole days from ``then`` to ``now``, towards zero."""
    us = F.unix_micros(now) - F.unix_micros(then)
    return F.when(us >= 0, F.floor(us / DAY_US)).otherwise(-F.floor(-us / DAY_US)).cast("bigint")


@dataclass(frozen=True)
class Weights:
    access: float = 0.35
    confidence: float = 0.25
    recency: float = 0.25
    validated: float = 0.15


@dataclass(frozen=True)
class Limits:
    high: float = 0.7
    accesses_for_high: int = 3
    demote: float = 0.4
    remove: float = 0.3
    stale_days: int = 90
    demote_after_days: int = 14
    remove_after_days: int = 30
    revive: float = 0.6
    accesses_to_revive: int = 5


def memory_score(now: Column, w: Weights = Weights()) -> Column:
    """From confidence, is_validated, access_count, extracted_at and last_accessed_at."""
    idle = F.greatest(whole_days(now, F.coalesce("last_accessed_at", "extracted_at")), F.lit(0))
    return (
        w.access * F.least(F.col("access_count") / 10, F.lit(1.0))
        + w.confidence * F.col("confidence")
        + w.recency * F.greatest(1 - idle / 90, F.lit(0.0))
        + w.validated * F.col("is_validated").cast("double")
    )


def next_state(now: Column, score: Column, k: Limits = Limits()) -> Column:
    """The state a memory moves to, null if it stays. The order of the rules matters."""
    age = whole_days(now, F.col("extracted_at"))
    stale = F.coalesce(whole_days(now, F.col("last_accessed_at")), age)
    state, n = F.col("state"), F.col("access_count")
    return (
        F.when((state == "new") & (score >= k.high) & (n >= k.accesses_for_high), "high")
        .when((state == "new") & (score < k.remove) & (age > k.remove_after_days) & (n == 0), "removed")
        .when((state == "new") & (score < k.demote) & (age > k.demote_after_days), "low")
        .when((state == "low") & (score >= k.revive) & (n >= k.accesses_to_revive), "high")
        .when((state == "high") & (score < k.demote) & (stale > k.stale_days) & ~F.col("is_validated"), "low")
    )


def two_places(x: Column) -> Column:
    """A number with two places, rounded by its exact binary value (``format_string`` rounds its shortest decimal)."""
    return F.format_number(x, 2)


#: How a move is told, by state left and state entered.
REASONS = {
    ("new", "high"): "Score %s >= %s with %d accesses",
    ("new", "removed"): "Score %s < %s after %d days with 0 accesses",
    ("new", "low"): "Score %s < %s after %d days",
    ("low", "high"): "Score improved to %s with %d accesses",
    ("high", "low"): "Score dropped to %s, stale for %d days",
}


def transition_reason(now: Column, score: Column, to: Column, k: Limits = Limits()) -> Column:
    age = whole_days(now, F.col("extracted_at"))
    stale = F.coalesce(whole_days(now, F.col("last_accessed_at")), age)
    figures = {
        ("new", "high"): [two_places(F.lit(k.high)), F.col("access_count")], ("new", "removed"): [two_places(F.lit(k.remove)), age], ("new", "low"): [two_places(F.lit(k.demote)), age],
        ("low", "high"): [F.col("access_count")], ("high", "low"): [stale],
    }
    told = F.when(F.lit(False), F.lit(None).cast("string"))
    for (left, entered), text in REASONS.items():
        told = told.when((F.col("state") == left) & (to == entered), F.format_string(text, two_places(score), *figures[left, entered]))
    return told
