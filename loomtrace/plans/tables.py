"""The driver's tables in the roles of the engine's: Spark adapters and the same as SQL.

customer / orders / lineitem stand for projects, sessions and messages by volume;
conversations for messages with text; documents and labels for memories;
embeddings for their vectors; part and lineitem for skills and their sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

NOW = "TIMESTAMP '2024-04-01 00:00:00'"


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS project_id", "cast(o_orderdate AS timestamp) AS created_at", "cast(floor(o_totalprice * 100) AS bigint) AS duration_ms",
        "o_orderstatus = 'P' AS is_hidden", "o_orderpriority AS title",
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS session_id", "cast(l_linenumber AS bigint) AS sequence_num", "CASE WHEN l_linenumber % 2 = 1 THEN 'user' ELSE 'assistant' END AS role",
        "l_returnflag = 'R' AS has_error", "CASE WHEN l_linenumber % 3 = 0 THEN 'Bash' END AS tool_name", "CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS model",
        "cast(floor(l_quantity) AS bigint) AS input_tokens", "cast(floor(l_extendedprice / 100) AS bigint) AS output_tokens",
        "cast(floor(l_discount * 100) AS bigint) AS cache_read_tokens", "CASE WHEN l_linenumber % 5 > 0 THEN cast(floor(l_tax * 100) AS bigint) END AS cache_creation_tokens",
    )


SESSIONS_SQL = """s AS (SELECT o_orderkey AS id, o_custkey AS project_id, o_orderdate::TIMESTAMP AS created_at,
  floor(o_totalprice * 100)::BIGINT AS duration_ms, o_orderstatus = 'P' AS is_hidden, o_orderpriority AS title FROM orders)"""
MESSAGES_SQL = """m AS (SELECT l_orderkey AS session_id, l_linenumber::BIGINT AS sequence_num,
  CASE WHEN l_linenumber % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, l_returnflag = 'R' AS has_error,
  CASE WHEN l_linenumber % 3 = 0 THEN 'Bash' END AS tool_name, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS model,
  floor(l_quantity)::BIGINT AS input_tokens, floor(l_extendedprice / 100)::BIGINT AS output_tokens,
  floor(l_discount * 100)::BIGINT AS cache_read_tokens,
  CASE WHEN l_linenumber % 5 > 0 THEN floor(l_tax * 100)::BIGINT END AS cache_creation_tokens FROM lineitem)"""
WORK_SQL = f"WITH {SESSIONS_SQL}, {MESSAGES_SQL}"


def talk(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as messages: some are answers of tools, some calls, times two minutes or an hour apart."""
    return table(spark, d, "conversations").selectExpr(
        "cast(conv_id AS string) AS session_id", "turn AS sequence_num", "role", "text AS search_content", "text AS content_preview",
        "CASE WHEN turn % 5 = 3 THEN CASE WHEN role = 'user' THEN 'result' ELSE 'use' END END AS tool_type", "CASE WHEN turn % 5 = 3 THEN CASE WHEN conv_id % 2 = 0 THEN 'Write' ELSE 'Bash' END END AS tool_name",
        "cast(octet_length(text) AS bigint) AS byte_length", "CASE WHEN role = 'assistant' THEN concat('m', conv_id % 3) END AS model",
        "timestamp_seconds(1704067200 + conv_id * 86400 + turn * 120 + CASE WHEN turn >= 4 THEN 3600 ELSE 0 END) AS ts",
        "CASE WHEN role = 'assistant' THEN cast(length(text) AS bigint) END AS input_tokens", "cast(turn AS bigint) AS output_tokens", "cast(NULL AS bigint) AS cache_read_tokens", "cast(1 AS bigint) AS cache_creation_tokens",
    ).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


TALK_SQL = """t AS (SELECT conv_id::VARCHAR AS session_id, turn AS sequence_num, role, text AS search_content, text AS content_preview,
  CASE WHEN turn % 5 = 3 THEN CASE WHEN role = 'user' THEN 'result' ELSE 'use' END END AS tool_type,
  CASE WHEN turn % 5 = 3 THEN CASE WHEN conv_id % 2 = 0 THEN 'Write' ELSE 'Bash' END END AS tool_name,
  strlen(text) AS byte_length, CASE WHEN role = 'assistant' THEN 'm' || (conv_id % 3) END AS model,
  1704067200 + conv_id * 86400 + turn * 120 + CASE WHEN turn >= 4 THEN 3600 ELSE 0 END AS sec,
  strftime(to_timestamp(1704067200 + conv_id * 86400 + turn * 120 + CASE WHEN turn >= 4 THEN 3600 ELSE 0 END) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
  regexp_matches(text, '```|`[^`]+`|function |class |const |let |var |import |export ') AS has_code,
  regexp_matches(text, '(?i)error|exception|failed|cannot|undefined|null is not') AS has_error,
  CASE WHEN role = 'assistant' THEN length(text) END AS input_tokens, turn AS output_tokens, 1 AS cache_creation_tokens FROM conversations)"""


def memories(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    both = docs.join(labels, "doc_id", "left")
    return both.selectExpr(
        "doc_id AS id", "source AS project_id", "concat('s', doc_id % 37) AS session_id",
        "CASE lang WHEN 'en' THEN 'decision' WHEN 'fr' THEN 'fact' WHEN 'de' THEN 'preference' WHEN 'es' THEN 'context' ELSE 'task' END AS memory_type",
        "left(text, 80) AS title", "text AS content", "array(lang, concat('Src', doc_id % 7), ' odd ') AS tags", "(doc_id % 100) / 100 AS confidence", "coalesce(quality = 1, false) AS is_validated",
        "timestamp_seconds(1704067200 + (doc_id * 7919 % 120) * 86400 - 2592000) AS extracted_at",
        "CASE WHEN toxic = 1 THEN 'removed' WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'low' ELSE 'high' END AS state", "doc_id % 13 AS access_count",
        "CASE WHEN doc_id % 4 = 0 THEN timestamp_seconds(1704067200 + (doc_id * 31 % 80) * 86400) END AS last_accessed_at",
    )


def memory_texts(spark: SparkSession, d: str) -> DataFrame:
    """What memories say, without what the labels add."""
    return table(spark, d, "documents").selectExpr("doc_id AS id", "source AS project_id", "left(text, 80) AS title", "text AS content")


MEMORIES_SQL = """mem AS (SELECT d.doc_id AS id, source AS project_id, 's' || (d.doc_id % 37) AS session_id,
  CASE lang WHEN 'en' THEN 'decision' WHEN 'fr' THEN 'fact' WHEN 'de' THEN 'preference' WHEN 'es' THEN 'context' ELSE 'task' END AS memory_type,
  left(text, 80) AS title, text AS content, [lang, 'Src' || (d.doc_id % 7), ' odd '] AS tags, (d.doc_id % 100) / 100 AS confidence,
  coalesce(quality = 1, false) AS is_validated, 1704067200 + (d.doc_id * 7919 % 120) * 86400 - 2592000 AS extracted,
  CASE WHEN toxic = 1 THEN 'removed' WHEN d.doc_id % 3 = 0 THEN 'new' WHEN d.doc_id % 3 = 1 THEN 'low' ELSE 'high' END AS state,
  d.doc_id % 13 AS access_count, CASE WHEN d.doc_id % 4 = 0 THEN 1704067200 + (d.doc_id * 31 % 80) * 86400 END AS accessed
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def skills(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey AS id", "p_brand AS project_id", "concat('o', p_size) AS session_id", "p_name AS name", "p_type AS description", "round(p_retailprice % 100 / 100, 4) AS confidence", "timestamp_seconds(1704067200 + p_partkey) AS extracted_at")


def skill_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_partkey AS skill_id", "concat('o', l_orderkey % 60) AS session_id").distinct()


SKILLS_SQL = """sk AS (SELECT p_partkey AS id, p_brand AS project_id, 'o' || p_size AS session_id, p_name AS name, p_type AS description,
  round(p_retailprice % 100 / 100, 4) AS confidence, 1704067200 + p_partkey AS extracted FROM part),
ln AS (SELECT DISTINCT l_partkey AS skill_id, 'o' || (l_orderkey % 60) AS session_id FROM lineitem)"""
