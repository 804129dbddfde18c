"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule compares one measure of a text with a cutoff from a short fixed list,
lenient to strict. What is certified is all rules together: they are tightened
one step at a time along a fixed path (rules in the order below, each from its
most lenient cutoff to its strictest), and at every step the false rejections,
good labelled documents that some rule in force would reject, are counted in each
stratum. A step is *certified* if the exact binomial tail says that rules with a
false rejection rate above ``limit`` would show so few at most with a probability
no greater than the stratum's share of ``delta``. Steps are tested in order until
the first fails (fixed sequence, so no correction along the path); across strata
``delta`` is shared out by the number of good labelled rows (weighted Bonferroni).
So with probability ``1 - delta`` no stratum loses more than ``limit`` of its good
documents to all rules together. Laxer rules reject no more, so within what is
certified each rule takes the cutoff with the best count of bad documents
rejected, less ``cost`` for each good one; a rule that gains nothing is not used.
A stratum needs about ``ln(delta * share) / ln(1 - limit)`` good labelled rows (200
or so) before anything can be certified; below, the base rule stands alone.

The texts are read once: the measures, a few numbers a document, are written to
the shared folder, and all that follows reads them there. Counts are summed up
before they are shuffled; the table of cutoffs has one row per stratum and rule.

Defined results: null text counts as empty; a text without words has zero
measures and fails the base rule; rows whose stratum has no cutoffs, is null or
unlabelled meet the base rule only; repeated rows are judged alike; an id that
labels name twice counts once, as good if either says so; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, stored

#: Rule -> (measure, +1: high is bad, -1: low is bad; cutoffs from lenient to strict). In the order of the path:
#: marks and word lengths that ordinary prose hardly shows come first, repetition, which it does show, last.
RULES: dict[str, tuple[str, int, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", 1, (2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "long_words": ("word_chars / n_words", 1, (40.0, 25.0, 16.0, 12.0, 10.0, 9.0, 8.0)),
    "short_words": ("word_chars / n_words", -1, (1.2, 1.6, 2.0, 2.4, 2.8, 3.2)),
    "dup_lines": ("n_dup_lines / n_lines", 1, (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeats": ("n_repeat_words / n_words", 1, (0.18, 0.15, 0.12, 0.1, 0.07, 0.05, 0.03)),
}
#: Where each rule's steps begin on the path.
BEFORE = {rule: sum(len(c) for _, _, c in list(RULES.values())[:i]) for i, rule in enumerate(RULES)}
STEPS = sum(len(c) for _, _, c in RULES.values())
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Risk:
    limit: float = 0.02
    delta: float = 0.05
    cost: float = 5.0


def measures(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys + n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    Windows of five words are compared by 64-bit hashes. Only texts in which some
    window hash repeats sort them; the sort stays within the row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(
        *keys, F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        lines.alias("lines"), F.filter(F.split(text, SPACES), lambda w: w != "").alias("words"),
    )
    step = step.select(
        *keys, "n_symbols", "lines", F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    n = F.size("h").cast("bigint")
    step = step.select(
        *keys, "word_chars", "n_symbols", n.alias("n_words"), F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(WINDOW)]))).alias("w"),
    )
    repeats = F.coalesce(F.size(F.array_distinct("w")) < F.size("w"), F.lit(False))
    step = step.withColumn("s", F.when(repeats, F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"])
    step = step.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        "p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum")), lambda a: a["sum"],
    )
    out = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("w", "s", "p")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _ratio(measure: str) -> Column:
    a, b = measure.split(" / ")
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def _level(rule: str) -> Column:
    """The first cutoff of the rule, from 1 at the lenient end, that rejects the row; one past the last if none does."""
    measure, sign, cutoffs = RULES[rule]
    return sum(((_ratio(measure) * sign <= c * sign).cast("int") for c in cutoffs), F.lit(1))


def _log_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k) by its exact terms, summed relative to the largest so far."""
    start = F.struct((n * F.log1p(F.lit(-p))).alias("t"), (n * F.log1p(F.lit(-p))).alias("m"), F.lit(1.0).alias("s"))

    def add(a: Column, j: Column) -> Column:
        t = a["t"] + F.ln((n - j + 1) / j * (p / (1 - p)))
        m = F.greatest(a["m"], t)
        return F.struct(t.alias("t"), m.alias("m"), (a["s"] * F.exp(a["m"] - m) + F.exp(t - m)).alias("s"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")), start, add, lambda a: a["m"] + F.ln(a["s"]))


def cutoffs(labelled: DataFrame, stratum: str, risk: Risk = Risk()) -> DataFrame:
    """(stratum, rule, level): the number of the cutoff in use; rows of ``labelled`` carry measures and ``good``."""
    judged = labelled.where(~F.col("base_failed") & F.col(stratum).isNotNull())
    # The step of the path from which a row is rejected; null: never.
    first = F.least(*[F.when(_level(r) <= len(c), F.lit(BEFORE[r]) + _level(r)) for r, (_, _, c) in RULES.items()])
    levels = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _level(r).alias("level")) for r in RULES], F.struct(F.lit("").alias("rule"), F.coalesce(first, F.lit(STEPS + 1)).alias("level"))))
    counts = stored(
        judged.select(F.col(stratum).alias("stratum"), "good", levels.alias("x")).groupBy("stratum", "x.rule", "x.level")
        .agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    )
    # The tables from here on have rows per stratum, rule and level.
    each = counts.groupBy("stratum", "rule").agg(F.sum("n_good").cast("bigint").alias("n"), F.collect_list(F.struct("level", "n_good", "n_bad")).alias("got"))
    total = lambda field: F.aggregate(F.filter("got", lambda x: x["level"] <= F.col("j")), F.lit(0).cast("bigint"), lambda a, x: a + x[field])
    good = counts.where("rule = ''").agg(F.sum("n_good")).scalar()
    steps = each.where("rule = ''").withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(STEPS)))).select("stratum", "j", "n", total("n_good").alias("k"))
    few = F.when(F.col("k") >= F.col("n") * risk.limit, F.lit(0.0)).otherwise(_log_tail(F.col("n"), F.col("k"), risk.limit))
    tested = steps.withColumn("passed", F.coalesce(few <= F.ln(F.lit(risk.delta) * F.col("n") / good), F.lit(False)))
    so_far = W.partitionBy("stratum").orderBy("j")
    certified = tested.withColumn("certified", F.min("passed").over(so_far)).where("certified").groupBy("stratum").agg(F.max("j").alias("steps"))
    size, start = (F.element_at(F.create_map(*[x for r in RULES for x in (F.lit(r), F.lit(of(r)))]), F.col("rule")) for of in (lambda r: len(RULES[r][2]), BEFORE.get))
    tries = each.where("rule <> ''").withColumn("j", F.explode(F.sequence(F.lit(1), size))).join(certified, "stratum").where(start + F.col("j") <= F.col("steps"))
    gain = total("n_bad") - risk.cost * total("n_good")
    return tries.withColumn("gain", gain).where("gain > 0").groupBy("stratum", "rule").agg(F.max_by("j", F.struct("gain", -F.col("j"))).alias("level"))


def judge(measured: DataFrame, chosen: DataFrame, stratum: str) -> DataFrame:
    """``kept`` for each row: it meets the base rule and, in its stratum, all rules in use."""
    per = chosen.groupBy(F.col("stratum").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "level"))).alias("use"))
    fails = lambda r: F.coalesce(_level(r) <= F.try_element_at("use", F.lit(r)), F.lit(False))
    names = F.filter(F.array(*[F.when(fails(r), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    joined = measured.join(per, measured[stratum] == per["of"], "left")
    return joined.withColumn("failed_rules", names).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("use", "of")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """doc_id, stratum, the measures, base_failed, failed_rules and kept for every row of ``docs``."""
    measured = stored(measures(docs, ["doc_id", stratum]))
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    chosen = stored(cutoffs(measured.join(good, "doc_id"), stratum, risk))  # at most a row per stratum and rule
    return judge(measured, chosen, stratum)
