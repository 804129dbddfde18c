"""Sampling, chunks, transcripts, titles, policies; row changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import browse, changes, extract
from .registry import query, table
from .tables import MEMORIES_SQL, TALK_SQL, WORK_SQL, memories, messages, sessions, talk

TALK = "WITH " + TALK_SQL


@query("tail_window", TALK + " SELECT session_id, sequence_num FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence_num DESC) AS n FROM t) WHERE n <= 3")
def tail_window(spark: SparkSession, d: str) -> DataFrame:
    return browse.last_messages(talk(spark, d), 3).select("session_id", "sequence_num")


LINE = "'[' || sequence_num || '] ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' END || chr(10) || coalesce(content_preview, '') || CASE WHEN tool_name IS NOT NULL THEN chr(10) || 'Tool: ' || tool_name ELSE '' END"


@query("memory_transcript", TALK + f", l AS (SELECT *, {LINE} AS line FROM t WHERE role IN ('user', 'assistant')) SELECT session_id, string_agg(line, chr(10) || chr(10) ORDER BY sequence_num) AS text FROM l GROUP BY 1 HAVING count(*) >= 3")
def memory_transcript(spark: SparkSession, d: str) -> DataFrame:
    return extract.memory_transcript(talk(spark, d), least=3)


HEAD = "'[' || sequence_num || '] ' || CASE role WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' END"
CUT = "CASE WHEN length(content_preview) > {n} THEN left(content_preview, {n}) || '...' ELSE coalesce(content_preview, '') END"


@query("skill_transcript", TALK + f""", l AS (SELECT *, CASE WHEN tool_name IS NOT NULL AND tool_type = 'use' THEN {HEAD} || ' → ' || tool_name
  WHEN tool_name IS NOT NULL AND tool_type = 'result' THEN {HEAD} || ' ← ' || tool_name || ' ' || {CUT.format(n=100)} ELSE {HEAD} || ': ' || {CUT.format(n=200)} END AS line FROM t WHERE role IN ('user', 'assistant'))
SELECT session_id, string_agg(line, chr(10) ORDER BY sequence_num) AS text FROM l GROUP BY 1 HAVING count(*) >= 3""")
def skill_transcript(spark: SparkSession, d: str) -> DataFrame:
    return extract.skill_transcript(talk(spark, d), least=3)


@query("raw_export", TALK + " SELECT session_id, string_agg('### ' || upper(left(role, 1)) || substr(role, 2) || chr(10) || search_content, chr(10) || chr(10) ORDER BY sequence_num) AS text FROM t GROUP BY 1")
def raw_export(spark: SparkSession, d: str) -> DataFrame:
    return extract.raw_export(talk(spark, d))


def _bytes(p: str, n: int, mark: str) -> str:
    return f"CASE WHEN strlen({p}) <= {n} THEN {p} ELSE left({p}, list_max(list_filter(range(0, {n + 1}), lambda k: strlen(left({p}, k)) <= {n}))) || '{mark}' END"


@query("title_input", TALK + f""", u AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence_num) AS n FROM t WHERE role = 'user' AND tool_type IS NULL),
c AS (SELECT session_id, string_agg({_bytes('search_content', 500, '...')}, chr(10) || chr(10) ORDER BY sequence_num) AS p FROM u WHERE n <= 10 GROUP BY 1)
SELECT session_id, {_bytes('p', 4000, '')} AS text FROM c""")
def title_input(spark: SparkSession, d: str) -> DataFrame:
    return extract.title_input(talk(spark, d))


@query("elide_middle", """
WITH x AS (SELECT doc_id, text AS p, CASE WHEN doc_id % 5 = 0 THEN 800 WHEN doc_id % 2 = 0 THEN 300 ELSE 400 END AS n FROM documents)
SELECT doc_id, CASE WHEN strlen(p) <= n THEN p ELSE left(p, n // 2) || '...[' || (strlen(p) - strlen(left(p, n // 2)) - strlen(right(p, n // 2))) || ' chars omitted]...' || right(p, n // 2) END AS shown FROM x""")
def elide_middle(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("doc_id") % 2 == 0, "user").otherwise("assistant")
    return table(spark, d, "documents").select("doc_id", t.elide(F.col("text"), role, F.col("doc_id") % 5 == 0).alias("shown"))


@query("clean_titles", r"""
WITH a AS (SELECT doc_id, trim(regexp_replace(trim(trim(trim('  "## ' || split_part(text, chr(10), 1) || '"'), '"'), ''''), '^#+', '')) AS p FROM documents),
b AS (SELECT doc_id, p, left(p, list_max(list_filter(range(0, 58), lambda k: strlen(left(p, k)) <= 57))) AS h FROM a)
SELECT doc_id, CASE WHEN strlen(p) <= 60 THEN p WHEN contains(h, ' ') THEN regexp_replace(h, ' [^ ]*$', '') || '...' ELSE h || '...' END AS title FROM b""")
def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    first = F.concat(F.lit('  "## '), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit('"'))
    return table(spark, d, "documents").select("doc_id", t.clean_title(first).alias("title"))


@query("token_estimates", "SELECT doc_id, least((strlen(text) + 100) // 3, 300) AS tokens, least(greatest(n_chars // 40, 5), 20)::INT AS markers FROM documents")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.token_estimate(F.octet_length("text")).alias("tokens"), t.target_markers(F.col("n_chars")).alias("markers"))


@query("token_chunks", TALK + """, w AS (SELECT session_id, sequence_num, least((byte_length + 100) // 3, 300) AS k, row_number() OVER (PARTITION BY session_id ORDER BY sequence_num) AS n FROM t),
r AS (SELECT session_id, list(k ORDER BY n) AS ks, list(sequence_num ORDER BY n) AS ss FROM w GROUP BY 1),
f AS (SELECT session_id, ss, list_reduce(list_prepend({c: 0, u: 0, o: []::INT[]}, list_transform(ks, lambda k: {c: 0, u: k::INT, o: []::INT[]})),
  lambda a, b: CASE WHEN a.u + b.u > 400 AND len(a.o) > 0 THEN {c: a.c + 1, u: b.u, o: list_append(a.o, a.c + 1)} ELSE {c: a.c, u: a.u + b.u, o: list_append(a.o, a.c)} END) AS st FROM r)
SELECT session_id, unnest(ss) AS sequence_num, unnest(st.o) AS chunk FROM f""")
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    return extract.chunks(talk(spark, d), 400).select("session_id", "sequence_num", "chunk")


@query("conversation_sample", TALK + " SELECT session_id, sequence_num FROM t WHERE role IN ('user', 'assistant') AND tool_type IS NULL")
def conversation_sample(spark: SparkSession, d: str) -> DataFrame:
    return extract.sample(talk(spark, d)).select("session_id", "sequence_num")


PEND = TALK + """, se AS (SELECT session_id AS id, count(*) AS message_count, max(sec) AS created, (min(sec) // 86400) % 3 AS k FROM t GROUP BY 1)"""


def _talk_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = talk(spark, d).groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("message_count"), F.max("ts").alias("created_at"), (F.floor(F.unix_seconds(F.min("ts")) / 86400) % 3).alias("k"))
    at = lambda yes: F.when(yes, F.col("created_at"))
    return rows.withColumns({
        "title_ai_generated": F.col("k") == 0, "title_edited": F.lit(False), "memories_extracted_at": at(F.col("k") < 2), "skills_extracted_at": at(F.col("k") == 0), "import_status": F.lit("success"),
        "memories_extracted_count": F.when(F.col("k") < 2, F.lit(2).cast("bigint")),
    })


@query("pending_work", PEND + " SELECT id, message_count FROM se WHERE message_count >= 4 AND k > 0 ORDER BY created DESC, id LIMIT 50")
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    return browse.pending(_talk_sessions(spark, d), least=4).select("id", "message_count")


@query("extraction_worth", PEND + " SELECT id FROM se WHERE k >= 2 OR message_count - 2 >= 5")
def extraction_worth(spark: SparkSession, d: str) -> DataFrame:
    return _talk_sessions(spark, d).where(browse.worth_extracting("memories", 5)).select("id")


@query("trigger_policy", PEND + """ SELECT id, message_count >= 5 AND k > 0 AS title, message_count >= 3 AND (last < 3 OR message_count - last >= 3) AS extraction
FROM (SELECT *, CASE WHEN k < 2 THEN 4 ELSE 0 END AS last FROM se) WHERE (message_count >= 5 AND k > 0) OR (message_count >= 3 AND (last < 3 OR message_count - last >= 3))""")
def trigger_policy(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import due

    rows = _talk_sessions(spark, d)
    return due(rows, rows.where("k < 2").select("id", F.lit(4).alias("last_count")), extract.Policy(5, 3, 3))


@query("append_numbering", TALK + """, o AS (SELECT * FROM t WHERE sequence_num < 3), n AS (SELECT * FROM t WHERE sequence_num >= 3)
SELECT session_id, n.sequence_num AS place, coalesce((SELECT max(sequence_num) FROM o WHERE o.session_id = n.session_id), 0) + row_number() OVER (PARTITION BY session_id ORDER BY n.sequence_num) AS sequence_num FROM n""")
def append_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = talk(spark, d)
    new = rows.where("sequence_num >= 3").select("session_id", F.col("sequence_num").alias("place"))
    shown = changes.appended(rows.where("sequence_num < 3").select("session_id", "sequence_num"), new.withColumn("was", F.col("place")))
    return shown.select("session_id", F.col("was").alias("place"), "sequence_num")


@query("session_upsert", WORK_SQL + """, n AS (SELECT id, project_id + 1 AS project_id, duration_ms + 5 AS duration_ms, 'new ' || title AS title FROM s WHERE id % 3 = 0 UNION ALL SELECT -id, project_id, duration_ms, title FROM s WHERE id % 50 = 1)
SELECT coalesce(s.id, n.id) AS id, coalesce(s.project_id, n.project_id) AS project_id, coalesce(n.duration_ms, s.duration_ms) AS duration_ms, coalesce(s.title, n.title) AS title FROM s FULL JOIN n ON s.id = n.id""")
def session_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A file read anew: what is measured is replaced, title and project stay."""
    old = sessions(spark, d).select("id", "project_id", "duration_ms", "title")
    new = old.where("id % 3 = 0").selectExpr("id", "project_id + 1 AS project_id", "duration_ms + 5 AS duration_ms", "concat('new ', title) AS title")
    new = new.unionByName(old.where("id % 50 = 1").withColumn("id", -F.col("id")))
    return changes.upsert(old, new, ["id"], ["project_id", "title"])


@query("cascading_delete", WORK_SQL + """, g AS (SELECT id FROM s WHERE project_id % 4 = 0)
SELECT 'sessions' AS kind, id, 0 AS n FROM s WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'messages', session_id, sequence_num FROM m WHERE session_id IN (SELECT id FROM s) AND session_id NOT IN (SELECT id FROM g)""")
def cascading_delete(spark: SparkSession, d: str) -> DataFrame:
    """Some projects go, and with them their sessions and messages."""
    s, m = sessions(spark, d), messages(spark, d)
    m = m.join(s.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    after = changes.delete({"projects": s.select(F.col("project_id").alias("id")).distinct(), "sessions": s, "session_messages": m}, "projects", F.col("id") % 4 == 0)
    return after["sessions"].select(F.lit("sessions").alias("kind"), "id", F.lit(0).cast("bigint").alias("n")).unionByName(after["session_messages"].select(F.lit("messages").alias("kind"), F.col("session_id").alias("id"), F.col("sequence_num").alias("n")))


@query("access_tracking", "WITH " + MEMORIES_SQL + """, ac AS (SELECT event_id % 200 AS id, epoch(ts) AS seen FROM events WHERE event_type = 'view')
SELECT mem.id, access_count + count(seen) AS access_count, (greatest(accessed, max(floor(seen)::BIGINT)))::BIGINT AS last_s FROM mem LEFT JOIN ac ON mem.id = ac.id GROUP BY mem.id, access_count, accessed""")
def access_tracking(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").where("event_type = 'view'").select((F.col("event_id") % 200).alias("memory_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("accessed_at"))
    rows = changes.with_access(memories(spark, d), log)
    return rows.select("id", "access_count", F.unix_seconds("last_accessed_at").alias("last_s"))


@query("insert_absent", TALK + " SELECT session_id, sequence_num FROM t WHERE sequence_num % 2 = 1")
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = talk(spark, d).select("session_id", "sequence_num")
    return changes.insert_absent(rows.where("sequence_num % 2 = 0"), rows.unionByName(rows), ["session_id", "sequence_num"])


@query("grown_sessions", WORK_SQL + """ SELECT id, CASE WHEN id % 2 = 0 THEN 15 ELSE 10 END AS message_count, id % 3 = 0 OR id % 4 = 0 AS has_code FROM s""")
def grown_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Files read on: counts add up, flags stay set."""
    none = F.lit(None).cast("timestamp")
    old = sessions(spark, d).select("id", F.lit(10).cast("bigint").alias("message_count"), (F.col("id") % 3 == 0).alias("has_code"), F.lit(False).alias("has_errors"), F.lit(1).cast("bigint").alias("file_size"), none.alias("indexed_at"))
    more = old.where("id % 2 = 0").select("id", F.lit(5).cast("bigint").alias("message_count"), (F.col("id") % 4 == 0).alias("has_code"), F.lit(False).alias("has_errors"), F.lit(2).cast("bigint").alias("file_size"), none.alias("indexed_at"))
    return changes.grown_session(old, more).select("id", "message_count", "has_code")
