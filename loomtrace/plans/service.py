"""Row changes, lookups, model work and sweeps, as the service's requests make them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Engine
from ..functions import jsons as j
from ..functions import text as t
from ..functions.tokens import token_set
from ..operators import browse, changes, extract, similar
from ..operators.staging import shared_folder
from .registry import query, table
from .tables import MEMORIES_SQL, NOW, SKILLS_SQL, TALK_SQL, memories, memory_texts, skills, talk
from .transcripts import cut_sql

TALK = "WITH " + TALK_SQL
MEM = "WITH " + MEMORIES_SQL
now = lambda: F.expr(NOW)


def _engine(spark: SparkSession, **settings) -> Engine:
    e = Engine(spark, shared_folder(spark), now=now(), **settings)
    e.store.buckets = 4
    return e


# Messages, markers, vectors, projects

SUMMED_SQL = TALK + """, st AS (SELECT session_id, sequence_num::BIGINT AS sequence_num, CASE WHEN sequence_num % 4 = 2 THEN 'agent_summary' END AS tool_name, CASE WHEN sequence_num % 4 = 2 THEN '/p' || sequence_num END AS tool_summary,
  role, sequence_num::BIGINT AS input_tokens FROM t),
nw AS (SELECT DISTINCT session_id, '/p2' AS tool_summary, session_id::BIGINT + 1000 AS input_tokens FROM t)
SELECT st.session_id, st.sequence_num, tool_name, st.tool_summary, role, coalesce(nw.input_tokens, st.input_tokens) AS input_tokens FROM st LEFT JOIN nw ON nw.session_id = st.session_id AND nw.tool_summary = st.tool_summary AND tool_name = 'agent_summary'
UNION ALL SELECT session_id, (SELECT max(sequence_num) + 1 FROM st WHERE st.session_id = nw.session_id), 'agent_summary', tool_summary, 'system', input_tokens FROM nw
  WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.session_id = nw.session_id AND st.tool_summary = nw.tool_summary)"""


@query("agent_summaries", SUMMED_SQL)
def agent_summaries(spark: SparkSession, d: str) -> DataFrame:
    """A helper's tokens, one row per session and path: updated where it is there, else added."""
    rows, mine = talk(spark, d), F.col("sequence_num") % 4 == 2
    old = rows.select("session_id", F.col("sequence_num").cast("bigint").alias("sequence_num"), F.when(mine, "agent_summary").alias("tool_name"), F.when(mine, F.concat(F.lit("/p"), F.col("sequence_num").cast("string"))).alias("tool_summary"), "role", F.col("sequence_num").cast("bigint").alias("input_tokens"))
    new = rows.select("session_id").distinct().select("session_id", F.lit("/p2").alias("tool_summary"), (F.col("session_id").cast("bigint") + 1000).alias("input_tokens"))
    return changes.agent_summaries(old, new)


@query("markers_replaced", """
WITH o AS (SELECT conv_id, turn, 'old' AS label FROM conversations WHERE turn < 3), n AS (SELECT conv_id, turn, 'new' AS label FROM conversations WHERE turn >= 2 AND conv_id % 3 = 0)
SELECT conv_id::VARCHAR AS session_id, turn::INT AS event_index, label FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE conv_id NOT IN (SELECT conv_id FROM n))""")
def markers_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Markers of a session give way to its new ones, through the store."""
    e = _engine(spark)
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("event_index"), F.lit("bug").alias("marker_type"), F.lit("d").alias("description"), "conv_id")
    e.set_markers(rows.where("event_index < 3").withColumn("label", F.lit("old")).drop("conv_id"))
    e.set_markers(rows.where("event_index >= 2 AND conv_id % 3 = 0").withColumn("label", F.lit("new")).drop("conv_id"))
    return e.table("session_markers").select("session_id", "event_index", "label")


@query("markers_in_order", "SELECT turn::INT AS event_index FROM conversations WHERE conv_id = 1 ORDER BY turn LIMIT 2")
def markers_in_order(spark: SparkSession, d: str) -> DataFrame:
    e = _engine(spark)
    e.set_markers(table(spark, d, "conversations").where("conv_id = 1").select(F.lit("1").alias("session_id"), F.col("turn").cast("int").alias("event_index"), F.lit("ship").alias("marker_type"), F.lit("x").alias("label"), F.lit("y").alias("description")))
    return e.markers("1").limit(2).select("event_index")


@query("embeddings_upsert", """
WITH o AS (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings WHERE vec_id % 2 = 0), n AS (SELECT vec_id, embedding[2]::DOUBLE AS x FROM embeddings WHERE vec_id % 3 = 0)
SELECT vec_id AS memory_id, round(x, 6) AS x FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE vec_id NOT IN (SELECT vec_id FROM n))""")
def embeddings_upsert(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "memory_id")
    first = lambda k: F.slice("embedding", k, 1).alias("embedding")
    both = changes.upsert(v.where("memory_id % 2 = 0").select("memory_id", first(1)), v.where("memory_id % 3 = 0").select("memory_id", first(2)), ["memory_id"])
    return both.select("memory_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x"))


FOLDERS_SQL = """fo AS (SELECT DISTINCT regexp_replace(url, '/[^/]*$', '') AS folder_path, CASE page_id % 5 WHEN 0 THEN '-tmp-x' || page_id WHEN 1 THEN '-PRIVATE-var-folders-y' WHEN 2 THEN '-' WHEN 3 THEN '-home-me-app' || page_id ELSE 'plain' END AS folder FROM pages),
f1 AS (SELECT folder_path, min(folder) AS folder FROM fo WHERE NOT regexp_matches(folder, '(?i)^-$|^-(private-var-folders-|var-folders-|tmp-|private-tmp-).*|^-tmp$') GROUP BY 1)"""


@query("projects_created", "WITH " + FOLDERS_SQL + """, pr AS (SELECT folder_path FROM f1 WHERE length(folder_path) % 2 = 0)
SELECT left(sha256(folder_path), 32) AS id, list_last(string_split(folder, '-')) AS name, folder_path, true AS auto_sync, epoch_us(TIMESTAMP '2024-04-01 00:00:00') AS created_us FROM f1 WHERE folder_path NOT IN (SELECT folder_path FROM pr)""")
def projects_created(spark: SparkSession, d: str) -> DataFrame:
    """A project for each folder not known yet; temporary folders get none."""
    folder = F.expr("CASE page_id % 5 WHEN 0 THEN concat('-tmp-x', page_id) WHEN 1 THEN '-PRIVATE-var-folders-y' WHEN 2 THEN '-' WHEN 3 THEN concat('-home-me-app', page_id) ELSE 'plain' END")
    rows = table(spark, d, "pages").select(F.regexp_replace("url", "/[^/]*$", "").alias("folder_path"), folder.alias("folder")).where(~t.is_temp_folder(F.col("folder")))
    rows = rows.groupBy("folder_path").agg(F.min("folder").alias("folder"))
    made = changes.new_projects(rows, rows.where("length(folder_path) % 2 = 0").select("folder_path"), now())
    return made.select("id", "name", "folder_path", "auto_sync", F.unix_micros("created_at").alias("created_us"))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.expr("concat('/home/', c_mktsegment, '/', c_custkey)").alias("folder_path"), F.expr("timestamp_seconds(1704067200 + c_custkey * 7919 % 100000)").alias("updated_at"))


CUSTOMERS_SQL = "cu AS (SELECT c_custkey::VARCHAR AS id, c_name AS name, '/home/' || c_mktsegment || '/' || c_custkey AS folder_path, 1704067200 + c_custkey * 7919 % 100000 AS updated FROM customer)"


@query("projects_page", "WITH " + CUSTOMERS_SQL + " SELECT 'changed' AS sort, id, (SELECT count(*) FROM cu) AS total FROM (SELECT * FROM cu ORDER BY updated DESC, id LIMIT 40 OFFSET 10) UNION ALL SELECT 'name', id, (SELECT count(*) FROM cu) FROM (SELECT * FROM cu ORDER BY name, id LIMIT 40 OFFSET 10)")
def projects_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of projects by time of change and by name, with the total."""
    rows = _customers(spark, d)
    pages = [browse.projects(rows, 40, 10, by).select(F.lit("name" if by else "changed").alias("sort"), "id") for by in (False, True)]
    return pages[0].unionByName(pages[1]).withColumn("total", F.lit(rows.count()).cast("bigint"))


@query("project_by_suffix", "WITH " + CUSTOMERS_SQL + " SELECT 'folder' AS by, id FROM cu WHERE ends_with(lower(folder_path), '/automobile/7') OR id = 'Automobile/7' UNION ALL SELECT 'id', id FROM cu WHERE id = '12' OR ends_with(lower(folder_path), '/12')")
def project_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    """By the last parts of the folder, letters of either case, and by id."""
    rows = _customers(spark, d)
    return browse.project_of_suffix(rows, "Automobile/7").select(F.lit("folder").alias("by"), "id").unionByName(browse.project_of_suffix(rows, "12").select(F.lit("id").alias("by"), "id"))


@query("names_and_kinds", r"""
WITH p AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN md5(url)[1:8] || '-' || md5(url)[9:12] || '-' || md5(url)[13:16] || '-' || md5(url)[17:20] || '-' || md5(url)[21:32] WHEN 1 THEN md5(url) || 'abcd' ELSE url END AS u,
  CASE page_id % 6 WHEN 0 THEN ' Pattern ' WHEN 1 THEN 'spec' WHEN 2 THEN 'DECISION' WHEN 3 THEN 'other' WHEN 4 THEN 'bug' ELSE 'task' END AS k,
  CASE page_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'openclaw' WHEN 2 THEN 'cursor' ELSE 'own' END AS tool FROM pages)
SELECT page_id, length(u) = 36 AND substr(u, 9, 1) = '-' AND substr(u, 14, 1) = '-' AS is_uuid,
  CASE lower(trim(k)) WHEN 'pattern' THEN 'fact' WHEN 'spec' THEN 'context' WHEN 'decision' THEN 'decision' WHEN 'bug' THEN 'fact' WHEN 'task' THEN 'task' END AS memory_type,
  CASE tool WHEN 'claude_code' THEN 'Claude Code' WHEN 'openclaw' THEN 'OpenClaw' WHEN 'cursor' THEN 'Cursor' ELSE tool END AS shown, replace(url, '/', '-') AS dashed, list_last(string_split(replace(url, '/', '-'), '-')) AS name FROM p""")
def names_and_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Ids that look like a UUID, memory types with their older names, tool names, folders of projects."""
    h = F.md5("url")
    part = lambda a, n: F.substring(h, a, n)
    u = F.expr("page_id % 4")
    made = F.when(u == 0, F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))).when(u == 1, F.concat(h, F.lit("abcd"))).otherwise(F.col("url"))
    kind = F.expr("CASE page_id % 6 WHEN 0 THEN ' Pattern ' WHEN 1 THEN 'spec' WHEN 2 THEN 'DECISION' WHEN 3 THEN 'other' WHEN 4 THEN 'bug' ELSE 'task' END")
    tool = F.expr("CASE page_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'openclaw' WHEN 2 THEN 'cursor' ELSE 'own' END")
    dashed = t.dash_folder(F.col("url"))
    return table(spark, d, "pages").select("page_id", t.looks_like_uuid(made).alias("is_uuid"), t.memory_type(kind).alias("memory_type"), t.tool_display(tool).alias("shown"), dashed.alias("dashed"), t.project_name(dashed).alias("name"))


@query("json_access", """
WITH v AS (SELECT event_id, event_id % 6 AS c FROM events)
SELECT event_id, CASE c WHEN 0 THEN 5 END::BIGINT AS whole, CASE c WHEN 1 THEN '5' END AS text, CASE c WHEN 2 THEN true END AS flag, c IN (0, 1, 2, 3) AS there, CASE c WHEN 4 THEN 'a,b' ELSE '' END AS list FROM v""")
def json_access(spark: SparkSession, d: str) -> DataFrame:
    """A value of another kind counts as missing; a key with null is there; a list that is none is empty."""
    raw = F.expr("""CASE event_id % 6 WHEN 0 THEN '{"k":5}' WHEN 1 THEN '{"k":"5"}' WHEN 2 THEN '{"k":true}' WHEN 3 THEN '{"k":null}' WHEN 4 THEN '["a","b"]' ELSE '[broken' END""")
    rows = table(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("v", j.parsed(F.col("raw")))
    v = F.col("v")
    listed = F.when(F.col("raw").startswith("["), j.string_list(F.col("raw"))).otherwise(F.array().cast("array<string>"))
    return rows.select("event_id", j.whole(v, "$.k").alias("whole"), j.text(v, "$.k").alias("text"), j.flag(v, "$.k").alias("flag"), F.coalesce(j.present(v, "$.k"), F.lit(False)).alias("there"), F.array_join(listed, ",").alias("list"))


@query("messages_page", "SELECT turn::BIGINT AS sequence_num, text AS search_content FROM conversations WHERE conv_id = 1 ORDER BY turn LIMIT 2 OFFSET 1")
def messages_page(spark: SparkSession, d: str) -> DataFrame:
    e = _engine(spark)
    e.store.write("session_messages", talk(spark, d).withColumn("ts", F.col("ts").cast("timestamp")))
    return e.messages("1", 2, 1).select("sequence_num", "search_content")


# Changes through the service

@query("sessions_changed", TALK + """, se AS (SELECT session_id AS id, count(*) AS n FROM t GROUP BY 1)
SELECT id, CASE id WHEN '1' THEN 'mine' WHEN '2' THEN 'made' ELSE 'T' || id END AS title, id = '1' AS title_edited, id = '2' AS title_ai_generated, id = '3' AS is_hidden,
  CASE WHEN id IN ('2') THEN epoch_us(TIMESTAMP '2024-04-01 00:00:00') END AS indexed_us, CASE id WHEN '4' THEN n END AS memories_extracted_count, CASE id WHEN '4' THEN epoch_us(TIMESTAMP '2024-04-01 00:00:00') END AS memories_us,
  n + CASE id WHEN '5' THEN 2 ELSE 0 END AS message_count FROM se""")
def sessions_changed(spark: SparkSession, d: str) -> DataFrame:
    """A title by hand and one by a model, a session hidden, an extraction noted, messages appended: each touches its session alone."""
    e = _engine(spark)
    s = talk(spark, d).groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("message_count"))
    e.store.write("sessions", s.withColumns({"title": F.concat(F.lit("T"), "id"), "title_edited": F.lit(False), "title_ai_generated": F.lit(False), "is_hidden": F.lit(False)}))
    e.update_session("1", title="mine")
    e.store_title("2", "made")
    e.update_session("3", is_hidden=True)
    e.note_extraction("4", "memories")
    e.append_messages(spark.createDataFrame([("5", 0, "user"), ("5", 1, "user")], "session_id string, place int, role string"))
    us = F.unix_micros
    return e.table("sessions").select("id", "title", "title_edited", "title_ai_generated", "is_hidden", us("indexed_at").alias("indexed_us"), "memories_extracted_count", us("memories_extracted_at").alias("memories_us"), "message_count")


@query("memories_changed", MEM + """ SELECT id, CASE id WHEN 3 THEN 'removed' WHEN 4 THEN 'high' ELSE state END AS state, round(CASE id WHEN 5 THEN 0.125 ELSE confidence END, 6) AS confidence,
  CASE id WHEN 5 THEN true ELSE is_validated END AS is_validated, access_count + CASE WHEN id IN (6, 7) THEN 1 ELSE 0 END AS access_count FROM mem""")
def memories_changed(spark: SparkSession, d: str) -> DataFrame:
    """State, confidence and validation patched, one memory put out of sight, access noted."""
    e = _engine(spark)
    e.store.write("memories", memories(spark, d))
    e.remove_memory(3)
    e.update_memory(4, state="high")
    e.update_memory(5, confidence=0.125, is_validated=True)
    e.track(spark.createDataFrame([(6,), (7,)], "id bigint"))
    return e.table("memories").select("id", "state", F.round("confidence", 6).alias("confidence"), "is_validated", "access_count")


@query("session_contexts", TALK + """, se AS (SELECT DISTINCT session_id FROM t)
SELECT session_id, CASE WHEN session_id::INT % 2 = 0 THEN 'task ' || session_id END AS active_task, CASE session_id WHEN '0' THEN 'Task: task 0. 2 decisions. Open: why; how' WHEN '2' THEN 'said so' END AS resume_context FROM se""")
def session_contexts(spark: SparkSession, d: str) -> DataFrame:
    """A context for every session, empty where there was none; a summary kept for resuming, made or given."""
    rows = talk(spark, d).select("session_id").distinct().withColumn("project_id", F.lit("p"))
    listed = lambda *x: F.array(*map(F.lit, x))
    have = rows.where("cast(session_id AS int) % 2 = 0").select("*", F.concat(F.lit("task "), "session_id").alias("active_task"), listed("a", "b").alias("recent_decisions"), listed("why", "how").alias("open_questions"), F.lit(None).cast("string").alias("resume_context"), F.lit("startup").alias("source"), now().alias("created_at"), now().alias("updated_at"))
    every = have.unionByName(changes.contexts_for(rows, have, now()).select(have.columns))
    return changes.lifeboat(changes.lifeboat(every, "0", None, now()), "2", "said so", now()).select("session_id", "active_task", "resume_context")


# Model work

ANSWER = {
    0: '[{"type":"decision","title":"T@","content":"C@","tags":["x"],"confidence":0.9}]', 1: 'Here:\n```json\n[{"type":"pattern","title":"T@","content":"C@","confidence":0.7}]\n```\nbye', 2: '{"memories":[{"type":"bug","title":"T@","content":"C@"}]}',
    3: 'I found [{"type":"task","title":"T@","content":"C@","confidence":0.95}] in it', 4: '[{"type":"fact","title":"T@","content":"C@","confidence":0.69}]', 5: '[{"type":"unheard","title":"T@","content":"C@","confidence":0.9}]', 6: "no list at all",
}


@query("memories_salvaged", """
WITH c AS (SELECT doc_id, doc_id % 7 AS k FROM documents)
SELECT doc_id::VARCHAR AS session_id, CASE k WHEN 0 THEN 'decision' WHEN 3 THEN 'task' ELSE 'fact' END AS memory_type, 'T' || doc_id AS title, 'C' || doc_id AS content, CASE k WHEN 0 THEN 0.9 WHEN 3 THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence,
  CASE k WHEN 0 THEN 1 ELSE 0 END AS n_tags FROM c WHERE k < 4""")
def memories_salvaged(spark: SparkSession, d: str) -> DataFrame:
    """Answers bare, fenced, wrapped and within prose; too little confidence, an unknown type and no list give nothing."""
    answer = F.when(F.lit(False), F.lit(""))
    for k, text in ANSWER.items():
        answer = answer.when(F.col("doc_id") % 7 == k, F.replace(F.lit(text), F.lit("@"), F.col("doc_id").cast("string")))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("session_id"), answer.alias("answer"))
    return extract.memories_of(rows).select("session_id", "memory_type", "title", "content", "confidence", F.size("tags").alias("n_tags"))


def _marking_model():
    """Stands for a model: marks what the prompt names, and fails where it is asked for session 3."""

    def model(prompt: str) -> str:
        session, turns = prompt.split("|")
        if session == "3":
            raise RuntimeError("no answer")
        marked = [int(x) for x in turns.split(",")]
        return json.dumps({"markers": {"bug": marked[:1], "ship": marked[-1:]}})

    return model


@query("markers_detected", """
WITH s AS (SELECT conv_id, min(turn) AS a, max(turn) AS b FROM conversations WHERE conv_id <> 3 GROUP BY 1),
m AS (SELECT conv_id, a AS event_index, 'bug' AS marker_type FROM s UNION ALL SELECT conv_id, b, 'ship' FROM s)
SELECT conv_id::VARCHAR AS session_id, event_index::INT AS event_index, marker_type, CASE WHEN event_index = 0 AND conv_id % 2 = 0 THEN 'L' || conv_id ELSE upper(left(marker_type, 1)) || substr(marker_type, 2) END AS label,
  CASE WHEN event_index = 0 AND conv_id % 2 = 0 THEN 'D' END AS description FROM m""")
def markers_detected(spark: SparkSession, d: str) -> DataFrame:
    """Two phases: the model names moments, a second answer labels some; a failed call is a row without any."""
    own = F.concat(F.col("session_id"), F.lit("|"), F.array_join(F.transform(F.array_sort(F.collect_list("sequence_num")), lambda x: x.cast("string")), ",")).alias("prompt")
    prompts = talk(spark, d).groupBy("session_id").agg(own)
    found = extract.marker_moments(extract.ask(prompts, _marking_model, ["session_id"]).where("error IS NULL"))
    labels = prompts.where("cast(session_id AS int) % 2 = 0").select("session_id", F.concat(F.lit('{"labels":[{"idx":0,"label":"L'), "session_id", F.lit('","description":"D"}]}')).alias("answer"))
    return extract.labelled_markers(found, labels, now()).drop("created_at")


@query("compact_messages", TALK + """, x AS (SELECT session_id, sequence_num, role, timestamp, search_content AS p, CASE WHEN has_error THEN 800 WHEN role = 'user' THEN 300 ELSE 400 END AS n FROM t WHERE role IN ('user', 'assistant') AND tool_type IS NULL)
SELECT session_id, sequence_num, sequence_num AS idx, role, timestamp AS time,
  CASE WHEN strlen(p) <= n THEN p ELSE left(p, n // 2) || '...[' || (strlen(p) - strlen(left(p, n // 2)) - strlen(right(p, n // 2))) || ' chars omitted]...' || right(p, n // 2) END AS content FROM x""")
def compact_messages(spark: SparkSession, d: str) -> DataFrame:
    """What a message becomes for a model, read back from its JSON."""
    rows = extract.sample(talk(spark, d)).withColumn("has_error", t.has_error(F.col("search_content")))
    kinds = "idx bigint, role string, time string, content string"
    return extract.compact(rows).select("session_id", "sequence_num", F.from_json("compact", kinds).alias("c")).select("session_id", "sequence_num", "c.*")


EXPORT_SQL = TALK + """, e AS (SELECT session_id, string_agg('### ' || upper(left(role, 1)) || substr(role, 2) || chr(10) || search_content, chr(10) || chr(10) ORDER BY sequence_num) AS x FROM t GROUP BY 1),
h AS (SELECT *, left(x, list_max(list_filter(range(0, 601), lambda k: strlen(left(x, k)) <= 600))) AS hd FROM e),
r AS (SELECT *, length(hd) - strpos(reverse(hd), ' ###' || chr(10)) - 3 AS a, length(hd) - strpos(reverse(hd), chr(10)) AS b FROM h)"""


@query("export_cut", EXPORT_SQL + """ SELECT session_id, 'Say' || chr(10) || chr(10) || 'Session content:' || chr(10) || CASE WHEN strlen(x) <= 600 THEN x WHEN contains(hd, chr(10) || '### ') THEN left(hd, a::INT - 1) || chr(10) || chr(10) || '[... content truncated for length ...]'
  WHEN contains(hd, chr(10)) THEN left(hd, b::INT) || chr(10) || chr(10) || '[... content truncated for length ...]' ELSE hd || '...' END AS prompt FROM r""")
def export_cut(spark: SparkSession, d: str) -> DataFrame:
    """Exports cut before the last heading that fits, or at a line's end."""
    return extract.export_prompts(extract.raw_export(talk(spark, d)), "Say", 600).select("session_id", "prompt")


# Likeness with the engine's own tokens

def _stem_sql(w: str) -> str:
    rules = (("ting", 5, 3), ("ing", 4, 3), ("ed", 3, 2), ("es", 3, 2), ("s", 3, 1), ("ly", 4, 2))
    return "CASE " + " ".join(f"WHEN strlen({w}) > {n} AND ends_with({w}, '{x}') THEN left({w}, length({w}) - {k})" for x, n, k in rules) + f" ELSE {w} END"


def tokens_sql(text: str) -> str:
    """The set of tokens: runs of letters and digits of two bytes or more, stemmed (texts without CJK)."""
    return rf"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), lambda w: strlen(w) >= 2), lambda w: {_stem_sql('w')})))"


@query("similarity_tokens", f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents")
def similarity_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(token_set("text"), " ").alias("tokens"))


def _jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


SKILL_SETS = f"sk0 AS (SELECT id, project_id, name, {tokens_sql('name')} AS t1, {tokens_sql('description')} AS t2 FROM sk), sr AS (SELECT project_id, t1, t2, min(id) AS id FROM sk0 GROUP BY ALL)"
SKILL_SIM = f"0.3 * ({_jaccard_sql('a.t1', 'b.t1')}) + 0.7 * ({_jaccard_sql('a.t2', 'b.t2')})"


@query("skill_pairs", f"WITH {SKILLS_SQL}, {SKILL_SETS}, p AS (SELECT a.project_id, a.id AS a, b.id AS b, {SKILL_SIM} AS similarity FROM sr a JOIN sr b ON a.project_id = b.project_id AND a.id < b.id) SELECT project_id, a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.7 - 1e-12")
def skill_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of classes of skills in a project at the threshold of insertion."""
    return similar.pairs(skills(spark, d), similar.SKILL).select("project_id", "a", "b", F.round("similarity", 6).alias("similarity"))


def _admitted_sql(sets: str, name: str, sim: str, threshold: float, live: str) -> str:
    """sets: CTE x with id, project_id, {name}, t1, t2, live; new ones have odd ids. One by one in order of id."""
    return f"""{sets},
li AS (SELECT a.project_id, a.id AS later, b.id AS earlier, b.id % 2 = 0 AS old FROM x a JOIN x b ON a.project_id = b.project_id AND a.id % 2 = 1 AND a.id <> b.id
  AND ((b.id % 2 = 0 AND (a.{name} = b.{name} OR ({live} AND {sim} >= {threshold} - 1e-12))) OR (b.id % 2 = 1 AND b.id < a.id AND (a.{name} = b.{name} OR {sim} >= {threshold} - 1e-12)))),
od AS (SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY id) AS n, EXISTS (SELECT 1 FROM li WHERE later = x.id AND old) AS known FROM x WHERE id % 2 = 1),
le AS (SELECT o1.project_id, o1.n AS nl, o2.n AS ne FROM li JOIN od o1 ON o1.id = li.later JOIN od o2 ON o2.id = li.earlier WHERE NOT li.old),
step(project_id, n, gone) AS (SELECT DISTINCT project_id, 0::BIGINT, []::BIGINT[] FROM od
  UNION ALL SELECT s.project_id, s.n + 1, CASE WHEN (SELECT known FROM od WHERE od.project_id = s.project_id AND od.n = s.n + 1) OR EXISTS (SELECT 1 FROM le WHERE le.project_id = s.project_id AND le.nl = s.n + 1 AND NOT list_contains(s.gone, le.ne)) THEN list_append(s.gone, s.n + 1) ELSE s.gone END
  FROM step s WHERE s.n < (SELECT max(n) FROM od WHERE od.project_id = s.project_id)),
fin AS (SELECT project_id, max_by(gone, n) AS gone FROM step GROUP BY 1)
SELECT od.id, od.project_id, NOT list_contains(gone, n) AS admitted FROM od JOIN fin USING (project_id)"""


MEMORY_SIM = f"0.6 * ({_jaccard_sql('a.t1', 'b.t1')}) + 0.4 * ({_jaccard_sql('a.t2', 'b.t2')})"


@query("insert_dedup", f"WITH RECURSIVE {MEMORIES_SQL}, " + _admitted_sql(f"x AS (SELECT id, project_id, title, state, {tokens_sql('title')} AS t1, {tokens_sql('content')} AS t2 FROM mem)", "title", MEMORY_SIM, 0.65, "b.state <> 'removed'"))
def insert_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Memories of odd ids as new ones, one by one, against those of even ids: equal titles in any state, likeness among live ones."""
    # Texts do not meet the labels: which stored ones are removed is asked by id.
    m, gone = memory_texts(spark, d), memories(spark, d).where("state = 'removed'").select("id")
    verdicts = similar.admit(m.where("id % 2 = 1"), m.where("id % 2 = 0"), similar.MEMORY, live="true", gone=gone)
    return verdicts.select("id", "project_id", F.col("twin").isNull().alias("admitted"))


@query("skills_admitted", f"WITH RECURSIVE {SKILLS_SQL}, " + _admitted_sql(SKILL_SETS.split(", sr AS")[0] + ", x AS (SELECT * FROM sk0)", "name", SKILL_SIM, 0.7, "true"))
def skills_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Skills of odd ids as new ones against those of even ids."""
    s = skills(spark, d)
    verdicts = similar.admit(s.where("id % 2 = 1").select("id", "project_id", "name", "description"), s.where("id % 2 = 0"), similar.SKILL, live="true")
    return verdicts.select("id", "project_id", F.col("twin").isNull().alias("admitted"))


SWEPT_SQL = f"""WITH RECURSIVE {SKILLS_SQL}, {SKILL_SETS.split(', sr AS')[0]},
od AS (SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY id) AS n FROM sk0),
le AS (SELECT a.project_id, o1.n AS nl, o2.n AS ne FROM sk0 a JOIN sk0 b ON a.project_id = b.project_id AND b.id < a.id JOIN od o1 ON o1.id = a.id JOIN od o2 ON o2.id = b.id WHERE {SKILL_SIM} >= 0.8 - 1e-12),
step(project_id, n, gone) AS (SELECT DISTINCT project_id, 0::BIGINT, []::BIGINT[] FROM od
  UNION ALL SELECT s.project_id, s.n + 1, CASE WHEN EXISTS (SELECT 1 FROM le WHERE le.project_id = s.project_id AND le.nl = s.n + 1 AND NOT list_contains(s.gone, le.ne)) THEN list_append(s.gone, s.n + 1) ELSE s.gone END
  FROM step s WHERE s.n < (SELECT max(n) FROM od WHERE od.project_id = s.project_id)),
fin AS (SELECT project_id, unnest(max_by(gone, n)) AS n FROM step GROUP BY 1)
SELECT od.id, od.project_id FROM fin JOIN od USING (project_id, n)"""


@query("skills_swept", SWEPT_SQL)
def skills_swept(spark: SparkSession, d: str) -> DataFrame:
    """What clean-up of skills removes, oldest first, with the engine's tokens."""
    return similar.leaders(skills(spark, d), similar.SKILL_CLEANUP, ["extracted_at"]).select("id", "project_id")


@query("program_answers", TALK + " SELECT DISTINCT session_id, 'say ' || session_id AS answer, NULL::VARCHAR AS error FROM t")
def program_answers(spark: SparkSession, d: str) -> DataFrame:
    """Another program as the model, here one that says what it hears; half of it in an envelope."""
    own = F.concat(F.lit("say "), F.col("session_id"))
    prompts = talk(spark, d).select("session_id").distinct().withColumn("prompt", F.when(F.col("session_id").cast("int") % 2 == 0, F.to_json(F.struct(own.alias("result")))).otherwise(own))
    return extract.ask(prompts, extract.command_model(["cat"]), ["session_id"])


DIMENSIONS = 16


@query("embedded_texts", rf"""
WITH tok AS (SELECT doc_id, unnest(list_transform(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: strlen(w) >= 2), lambda w: {_stem_sql('w')})) AS w FROM documents),
crcs AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
dw AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(regexp_replace(hex(encode(w)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295::BIGINT) AS h
  FROM (SELECT DISTINCT w FROM tok), crcs),
c AS (SELECT doc_id, h % {DIMENSIONS} AS k, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS v FROM tok JOIN dw USING (w) GROUP BY 1, 2),
e AS (SELECT doc_id, k, coalesce(v, 0) AS v FROM (SELECT doc_id, unnest(range({DIMENSIONS})) AS k FROM documents) LEFT JOIN c USING (doc_id, k))
SELECT doc_id, string_agg(CASE WHEN v > 0 THEN '+' WHEN v < 0 THEN '-' ELSE '0' END, '' ORDER BY k) AS signs, sum(v * v) > 0 AS unit FROM e GROUP BY 1""")
def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in for a model: where each text's vector points, and whether it has unit length (or none)."""
    from ..operators import vectors

    rows = vectors.embed(table(spark, d, "documents"), "doc_id", F.col("text"), lambda: vectors.hashed_embedder(DIMENSIONS))
    sign = F.transform("embedding", lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0"))
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select("doc_id", F.array_join(sign, "").alias("signs"), (F.abs(size - 1) < 1e-5).alias("unit"))
