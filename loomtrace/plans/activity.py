"""Activity, usage and rollups over sessions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import analytics, rollups
from ..streaming.ingest import idle_windows
from .registry import query, table
from .tables import TALK_SQL, WORK_SQL, messages, sessions, talk

IDLE_US = 30 * 60 * 1_000_000


@query("active_duration", """
WITH g AS (
  SELECT user_id, event_type, epoch_us(ts) AS us,
         epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
  FROM events)
SELECT user_id, count(*) AS n_events,
       CASE WHEN count(*) >= 2 THEN
         (coalesce(sum(CASE WHEN gap <= 1800000000 THEN gap END), 0) // 1000)::BIGINT END AS active_ms,
       count(*) FILTER (WHERE event_type = 'error') AS n_errors,
       count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases
FROM g GROUP BY user_id""")
def active_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: sum of gaps of at most 30 minutes between consecutive events (ms)."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    by_time = W.partitionBy("user_id").orderBy("us", "event_id")
    gaps = events.withColumn("gap", F.col("us") - F.lag("us").over(by_time))
    active = F.coalesce(F.sum(F.when(F.col("gap") <= IDLE_US, F.col("gap"))), F.lit(0))
    return gaps.groupBy("user_id").agg(
        F.count("*").alias("n_events"),
        F.when(F.count("*") >= 2, F.floor(active / 1000).cast("bigint")).alias("active_ms"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
        F.count_if(F.col("event_type") == "purchase").alias("n_purchases"),
    )


@query("idle_session_windows", """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000 THEN 1 ELSE 0 END AS cut
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS stop_us, count(*) AS n FROM i GROUP BY user_id, island""")
def idle_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return idle_windows(events, "user_id", "ts").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "n")


@query("project_stats", WORK_SQL + """, v AS (SELECT * FROM s WHERE NOT is_hidden)
SELECT project_id, a.total_sessions, a.total_duration_ms, coalesce(b.total_messages, 0) AS total_messages, coalesce(messages_with_errors, 0) AS messages_with_errors,
  coalesce(user_messages, 0) AS user_messages, coalesce(assistant_messages, 0) AS assistant_messages, coalesce(tool_uses, 0) AS tool_uses, coalesce(tool_results, 0) AS tool_results,
  coalesce(b.input_tokens, 0) AS input_tokens, coalesce(b.output_tokens, 0) AS output_tokens, coalesce(b.cache_read_tokens, 0) AS cache_read_tokens, coalesce(b.cache_creation_tokens, 0) AS cache_creation_tokens
FROM (SELECT project_id, count(*) AS total_sessions, coalesce(sum(duration_ms), 0)::BIGINT AS total_duration_ms FROM v GROUP BY 1) a
LEFT JOIN (SELECT project_id, count(*) AS total_messages, count(*) FILTER (WHERE has_error) AS messages_with_errors, count(*) FILTER (WHERE role = 'user') AS user_messages,
  count(*) FILTER (WHERE role = 'assistant') AS assistant_messages, count(*) FILTER (WHERE role = 'assistant' AND tool_name IS NOT NULL) AS tool_uses,
  count(*) FILTER (WHERE role = 'user' AND tool_name IS NOT NULL) AS tool_results, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens,
  coalesce(sum(cache_read_tokens), 0)::BIGINT AS cache_read_tokens, coalesce(sum(cache_creation_tokens), 0)::BIGINT AS cache_creation_tokens
  FROM m JOIN v ON m.session_id = v.id GROUP BY 1) b USING (project_id)""")
def project_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.project_stats(sessions(spark, d), messages(spark, d))


@query("model_histogram", WORK_SQL + """
SELECT project_id, model, count(*) AS n FROM m JOIN s ON m.session_id = s.id WHERE NOT is_hidden AND model IS NOT NULL GROUP BY 1, 2""")
def model_histogram(spark: SparkSession, d: str) -> DataFrame:
    return analytics.models_used(sessions(spark, d), messages(spark, d))


@query("session_metrics", WORK_SQL + """
SELECT s.project_id, s.id AS session_id, epoch_us(s.created_at) AS created_us, any_value(s.duration_ms) AS duration_ms, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens,
  coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, count(m.session_id) AS message_count, count(*) FILTER (WHERE role = 'user') AS user_messages,
  count(*) FILTER (WHERE role = 'assistant') AS assistant_messages, count(*) FILTER (WHERE role = 'assistant' AND tool_name IS NOT NULL) AS tool_uses
FROM s LEFT JOIN m ON s.id = m.session_id WHERE NOT is_hidden GROUP BY 1, 2, 3""")
def session_metrics(spark: SparkSession, d: str) -> DataFrame:
    return analytics.session_metrics(sessions(spark, d), messages(spark, d)).withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


@query("active_dates", WORK_SQL + " SELECT DISTINCT project_id, strftime(created_at, '%Y-%m-%d') AS date FROM s WHERE NOT is_hidden")
def active_dates(spark: SparkSession, d: str) -> DataFrame:
    return analytics.active_dates(sessions(spark, d)).withColumn("date", F.col("date").cast("string"))


@query("longest_streak", WORK_SQL + """, a AS (SELECT DISTINCT project_id, created_at::DATE AS day FROM s WHERE NOT is_hidden),
b AS (SELECT project_id, day - (row_number() OVER (PARTITION BY project_id ORDER BY day))::INT AS island FROM a)
SELECT project_id, max(n) AS longest_streak FROM (SELECT project_id, island, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1""")
def longest_streak(spark: SparkSession, d: str) -> DataFrame:
    return analytics.longest_streak(sessions(spark, d))


DAILY = """ SELECT project_id, strftime(created_at, '%Y-%m-%d') AS date, """
DAILY_FROM = " FROM s LEFT JOIN m ON s.id = m.session_id WHERE NOT is_hidden GROUP BY 1, 2"
SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in analytics.TOKENS)


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("date", F.col("date").cast("string"))


@query("daily_tokens", WORK_SQL + DAILY + SUMS + ", (coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0))::BIGINT AS total_tokens" + DAILY_FROM)
def daily_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _dated(analytics.daily_tokens(sessions(spark, d), messages(spark, d)))


@query("daily_errors", WORK_SQL + DAILY + "count(*) FILTER (WHERE has_error) AS error_count" + DAILY_FROM + " HAVING count(*) FILTER (WHERE has_error) > 0")
def daily_errors(spark: SparkSession, d: str) -> DataFrame:
    return _dated(analytics.daily_errors(sessions(spark, d), messages(spark, d)))


VIBE = "count(m.session_id) AS total_messages, count(*) FILTER (WHERE role = 'user') AS user_messages, "


@query("daily_vibe_parity", WORK_SQL + DAILY + VIBE + "coalesce(sum(duration_ms), 0)::BIGINT AS duration_ms, " + SUMS + DAILY_FROM)
def daily_vibe_parity(spark: SparkSession, d: str) -> DataFrame:
    return _dated(analytics.daily_vibe(sessions(spark, d), messages(spark, d), parity=True))


@query("daily_vibe_fixed", WORK_SQL + ", x AS (SELECT s.*, row_number() OVER (PARTITION BY s.id ORDER BY m.sequence_num) AS nth, m.* EXCLUDE (session_id) , m.session_id FROM s LEFT JOIN m ON s.id = m.session_id WHERE NOT is_hidden)"
       + DAILY + "count(session_id) AS total_messages, count(*) FILTER (WHERE role = 'user') AS user_messages, coalesce(sum(CASE WHEN nth = 1 THEN duration_ms END), 0)::BIGINT AS duration_ms, " + SUMS + " FROM x GROUP BY 1, 2")
def daily_vibe_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _dated(analytics.daily_vibe(sessions(spark, d), messages(spark, d)))


@query("sessions_page", WORK_SQL + " SELECT id, project_id, title FROM s WHERE NOT is_hidden ORDER BY created_at DESC, id LIMIT 50 OFFSET 20")
def sessions_page(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.browse import sessions as listed

    return listed(sessions(spark, d), limit=50, offset=20).select("id", "project_id", "title")


@query("least_recent_out", WORK_SQL + " SELECT id, project_id FROM s ORDER BY created_at DESC, id LIMIT 100")
def least_recent_out(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import least_recent_out as kept

    return kept(sessions(spark, d).withColumn("last_accessed", F.col("created_at"))).select("id", "project_id")


@query("message_flags", """
SELECT 'doc' AS kind, doc_id AS id, 0 AS turn, regexp_matches(text, '```|`[^`]+`|function |class |const |let |var |import |export ') AS has_code,
  regexp_matches(text, '(?i)error|exception|failed|cannot|undefined|null is not') AS has_error FROM documents
UNION ALL SELECT 'turn', conv_id, turn, regexp_matches(text, '```|`[^`]+`|function |class |const |let |var |import |export '),
  regexp_matches(text, '(?i)error|exception|failed|cannot|undefined|null is not') FROM conversations""")
def message_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = [t.has_code(F.col("text")).alias("has_code"), t.has_error(F.col("text")).alias("has_error")]
    docs = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), *flags)
    turns = table(spark, d, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("bigint").alias("turn"), *flags)
    return docs.unionByName(turns)


@query("preview_sanitize", r"""
WITH p AS (SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(replace(text, chr(27), ''), chr(10)), lambda x: regexp_replace(x, '^\s*\d+→', '')), ' '), '\s+', ' ', 'g')) AS p FROM documents)
SELECT doc_id, CASE WHEN strlen(p) <= 200 THEN p ELSE left(p, list_max(list_filter(range(0, 201), lambda k: strlen(left(p, k)) <= 200))) || '...' END AS preview FROM p""")
def preview_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.preview(F.col("text")).alias("preview"))


@query("parse_stats", "WITH " + TALK_SQL + """
SELECT session_id, count(*) AS total_events, count(*) FILTER (WHERE role = 'user' AND tool_type IS NULL) AS human_messages,
  count(*) FILTER (WHERE role = 'assistant' AND tool_type IS NULL) AS assistant_messages, count(*) FILTER (WHERE role IN ('user', 'assistant') AND tool_type IS NOT NULL) AS tool_uses,
  bool_or(has_code) AS has_code, bool_or(has_error) AS has_errors, coalesce(sum(input_tokens), 0)::BIGINT AS total_input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS total_output_tokens,
  0::BIGINT AS total_cache_read_tokens, count(*) AS total_cache_creation_tokens FROM t GROUP BY 1""")
def parse_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = talk(spark, d).withColumn("has_code", t.has_code(F.col("search_content"))).withColumn("has_error", t.has_error(F.col("search_content")))
    return rollups.stats(rows)


@query("session_metadata", "WITH " + TALK_SQL + """, x AS (SELECT *, sec - lag(sec) OVER (PARTITION BY session_id, role <> 'system' ORDER BY sec, sequence_num) AS gap FROM t),
a AS (SELECT session_id, min_by(timestamp, sequence_num) FILTER (WHERE role <> 'system') AS start_time, max_by(timestamp, sequence_num) FILTER (WHERE role <> 'system') AS end_time,
  CASE WHEN count(*) FILTER (WHERE role <> 'system') > 1 THEN coalesce(sum(CASE WHEN gap <= 1800 AND role <> 'system' THEN gap * 1000 END), 0)::BIGINT END AS duration_ms,
  min_by(model, sequence_num) FILTER (WHERE model IS NOT NULL) AS model, min_by(search_content, sequence_num) FILTER (WHERE role = 'user' AND tool_type IS NULL) AS p FROM x GROUP BY 1)
SELECT session_id, start_time, end_time, duration_ms, model, CASE WHEN strlen(p) <= 80 THEN p ELSE left(p, list_max(list_filter(range(0, 81), lambda k: strlen(left(p, k)) <= 80))) || '...' END AS title FROM a""")
def session_metadata(spark: SparkSession, d: str) -> DataFrame:
    return rollups.metadata(talk(spark, d))


@query("event_properties", """
SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k_any, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN json_extract(props, '$.k')::BIGINT END AS k_whole,
  CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN json_extract_string(props, '$.k') END AS k_text, json_exists(props, '$.k') AS k_there FROM events""")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import jsons as j

    v = F.col("v")
    rows = table(spark, d, "events").withColumn("v", j.parsed(F.col("props")))
    return rows.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k_any"), j.whole(v, "$.k").alias("k_whole"), j.text(v, "$.k").alias("k_text"), j.present(v, "$.k").alias("k_there"))
