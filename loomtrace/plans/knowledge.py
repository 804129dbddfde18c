"""Memories and skills: lists, statistics, ranking, tags, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Engine
from ..functions.scores import memory_score, next_state, transition_reason
from ..operators import analytics, browse, ranking
from ..operators.staging import shared_folder
from .registry import query, table
from .tables import MEMORIES_SQL, NOW, SKILLS_SQL, memories, skill_links, skills

MEM = "WITH " + MEMORIES_SQL
now = lambda: F.expr(NOW)

SCORE_SQL = """sc AS (SELECT *, greatest((1711929600 - coalesce(accessed, extracted)) // 86400, 0) AS idle, (1711929600 - extracted) // 86400 AS age,
  coalesce((1711929600 - accessed) // 86400, (1711929600 - extracted) // 86400) AS stale FROM mem WHERE state <> 'removed'),
sd AS (SELECT *, 0.35 * least(access_count / 10, 1.0) + 0.25 * confidence + 0.25 * greatest(1 - idle / 90, 0.0) + 0.15 * is_validated::DOUBLE AS score FROM sc),
tr AS (SELECT *, CASE WHEN state = 'new' AND score >= 0.7 AND access_count >= 3 THEN 'high'
  WHEN state = 'new' AND score < 0.3 AND age > 30 AND access_count = 0 THEN 'removed' WHEN state = 'new' AND score < 0.4 AND age > 14 THEN 'low'
  WHEN state = 'low' AND score >= 0.6 AND access_count >= 5 THEN 'high' WHEN state = 'high' AND score < 0.4 AND stale > 90 AND NOT is_validated THEN 'low' END AS to_state FROM sd)"""


@query("memory_browse", MEM + """ SELECT id, project_id, memory_type FROM mem WHERE state <> 'removed' AND project_id = 'src1' AND memory_type IN ('decision', 'fact')
  ORDER BY confidence DESC, extracted DESC, id LIMIT 20""")
def memory_browse(spark: SparkSession, d: str) -> DataFrame:
    return browse.browse(memories(spark, d), "src1", ["decision", "fact"]).select("id", "project_id", "memory_type")


@query("memory_list_paged", MEM + """ SELECT id, state, round(confidence, 6) AS confidence FROM mem WHERE state <> 'removed' AND confidence >= 0.3 AND is_validated
  ORDER BY extracted, id LIMIT 100 OFFSET 10""")
def memory_list_paged(spark: SparkSession, d: str) -> DataFrame:
    rows = browse.memories(memories(spark, d), min_confidence=0.3, validated=True, sort="extracted_at", descending=False, limit=100, offset=10)
    return rows.select("id", "state", F.round("confidence", 6).alias("confidence"))


@query("memory_removed_list", MEM + " SELECT id FROM mem WHERE state <> 'removed' AND state = 'removed'")
def memory_removed_list(spark: SparkSession, d: str) -> DataFrame:
    """Asking for removed ones finds none, as before."""
    return browse.memories(memories(spark, d), state="removed").select("id")


@query("tag_and_filter", MEM + " SELECT id FROM mem WHERE state <> 'removed' AND list_has_all(list_transform(tags, lambda x: lower(x)), ['en', 'src3']) ORDER BY confidence DESC, id LIMIT 100")
def tag_and_filter(spark: SparkSession, d: str) -> DataFrame:
    return browse.memories(memories(spark, d), tags=["EN", "src3"]).select("id")


@query("tag_exact_filter", MEM + " SELECT id FROM mem WHERE state <> 'removed' AND project_id = 'src2' AND list_has_all(tags, ['Src2']) ORDER BY confidence DESC, extracted DESC, id LIMIT 20")
def tag_exact_filter(spark: SparkSession, d: str) -> DataFrame:
    return browse.browse(memories(spark, d), "src2", tags=["Src2"]).select("id")


@query("top5_per_type", MEM + """ SELECT id, project_id, memory_type, place FROM (SELECT *, row_number() OVER (PARTITION BY project_id, memory_type ORDER BY confidence DESC, extracted DESC, id) AS place
  FROM mem WHERE state <> 'removed') WHERE place <= 5""")
def top5_per_type(spark: SparkSession, d: str) -> DataFrame:
    return browse.top_per_type(memories(spark, d)).select("id", "project_id", "memory_type", "place")


@query("memory_stats", MEM + """ SELECT project_id, count(*) AS total, count(*) FILTER (WHERE is_validated) AS validated, round(avg(confidence), 6) AS avg_confidence, count(DISTINCT session_id) AS sessions,
  count(*) FILTER (WHERE memory_type = 'decision') AS decision, count(*) FILTER (WHERE memory_type = 'fact') AS fact, count(*) FILTER (WHERE memory_type = 'preference') AS preference,
  count(*) FILTER (WHERE memory_type = 'context') AS context, count(*) FILTER (WHERE memory_type = 'task') AS task FROM mem WHERE state <> 'removed' GROUP BY 1""")
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.memory_stats(memories(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("top_tags", MEM + """ SELECT tag, count(*) AS n FROM (SELECT lower(trim(unnest(tags))) AS tag FROM mem WHERE state <> 'removed') WHERE tag <> '' GROUP BY 1 ORDER BY n DESC, tag LIMIT 25""")
def top_tags(spark: SparkSession, d: str) -> DataFrame:
    return analytics.top_tags(memories(spark, d))


@query("memory_score", MEM + ", " + SCORE_SQL + " SELECT id, round(score, 6) AS score FROM sd")
def memory_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.batch(memories(spark, d), now())
    return rows.select("id", F.round(memory_score(now()), 6).alias("score"))


@query("state_transitions", MEM + ", " + SCORE_SQL + " SELECT id, state AS from_state, to_state FROM tr WHERE to_state IS NOT NULL")
def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.evaluate(ranking.batch(memories(spark, d), now()), now()).where("to_state IS NOT NULL")
    return rows.select("id", F.col("state").alias("from_state"), "to_state")


@query("transition_tally", MEM + ", " + SCORE_SQL + """ SELECT project_id, count(*) AS memories_evaluated, count(*) FILTER (WHERE to_state = 'high') AS promoted, count(*) FILTER (WHERE to_state = 'low') AS demoted,
  count(*) FILTER (WHERE to_state = 'removed') AS removed, count(*) FILTER (WHERE to_state IS NULL) AS unchanged FROM tr GROUP BY 1""")
def transition_tally(spark: SparkSession, d: str) -> DataFrame:
    return ranking.report(ranking.evaluate(ranking.batch(memories(spark, d), now()), now())).drop("transitions")


@query("transition_reasons", MEM + ", " + SCORE_SQL + """ SELECT id, state, to_state, CASE WHEN state = 'new' AND to_state = 'high' THEN printf('Score %.2f >= 0.70 with %d accesses', score, access_count)
  WHEN state = 'new' AND to_state = 'removed' THEN printf('Score %.2f < 0.30 after %d days with 0 accesses', score, age) WHEN state = 'new' THEN printf('Score %.2f < 0.40 after %d days', score, age)
  WHEN state = 'low' THEN printf('Score improved to %.2f with %d accesses', score, access_count) ELSE printf('Score dropped to %.2f, stale for %d days', score, stale) END AS reason FROM tr WHERE to_state IS NOT NULL""")
def transition_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The moves with their reasons."""
    rows = ranking.batch(memories(spark, d), now()).withColumn("score", memory_score(now()))
    moved = rows.withColumn("to_state", next_state(now(), F.col("score"))).where("to_state IS NOT NULL")
    return moved.select("id", "state", "to_state", transition_reason(now(), F.col("score"), F.col("to_state")).alias("reason"))


TALLY_SQL = """ SELECT project_id, count(*) AS memories_evaluated, count(*) FILTER (WHERE to_state = 'high') AS promoted, count(*) FILTER (WHERE to_state = 'low') AS demoted,
  count(*) FILTER (WHERE to_state = 'removed') AS removed, count(*) FILTER (WHERE to_state IS NULL) AS unchanged FROM tr GROUP BY 1"""


@query("ranking_sweep", MEM + ", " + SCORE_SQL + TALLY_SQL)
def ranking_sweep(spark: SparkSession, d: str) -> DataFrame:
    """All projects in one job of the service; its report."""
    e = Engine(spark, shared_folder(spark), now=now())
    e.store.write("memories", memories(spark, d))
    return e.rank().drop("transitions")


@query("ranking_batch", MEM + " SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY extracted DESC, id DESC) AS n FROM mem WHERE state <> 'removed') WHERE n <= 20")
def ranking_batch(spark: SparkSession, d: str) -> DataFrame:
    """The newest of each project, as a batch parameter takes them."""
    return ranking.batch(memories(spark, d), now(), newest=20).select("id")


@query("ranking_applied", MEM + ", " + SCORE_SQL + " SELECT mem.id, coalesce(to_state, mem.state) AS state FROM mem LEFT JOIN tr ON mem.id = tr.id")
def ranking_applied(spark: SparkSession, d: str) -> DataFrame:
    return ranking.apply(memories(spark, d), now()).select("id", "state")


@query("ranking_stats", MEM + " SELECT project_id, state, count(*) AS n, round(avg(CASE WHEN state <> 'removed' THEN confidence END), 6) AS avg_confidence FROM mem GROUP BY 1, 2")
def ranking_stats(spark: SparkSession, d: str) -> DataFrame:
    return ranking.state_counts(memories(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("skill_stats", "WITH " + SKILLS_SQL + " SELECT project_id, count(*) AS total, count(DISTINCT session_id) AS sessions, count(DISTINCT name) AS names FROM sk GROUP BY 1")
def skill_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.skill_stats(skills(spark, d))


@query("frequency_sort", "WITH " + SKILLS_SQL + """ SELECT id AS skill_id, 1 + (SELECT count(*) FROM ln WHERE ln.skill_id = sk.id) AS by_links,
  (SELECT count(DISTINCT x) FROM (SELECT ln.session_id AS x FROM ln WHERE ln.skill_id = sk.id UNION ALL SELECT sk.session_id)) AS frequency
FROM sk ORDER BY by_links DESC, skill_id LIMIT 20 OFFSET 3""")
def frequency_sort(spark: SparkSession, d: str) -> DataFrame:
    titles = spark.createDataFrame([], "id string, title string")
    return analytics.skill_list(skills(spark, d), skill_links(spark, d), titles, "frequency", 20, 3).select("skill_id", F.col("by_links").cast("bigint").alias("by_links"), F.col("frequency").cast("bigint").alias("frequency"))


@query("skills_by_confidence", "WITH " + SKILLS_SQL + " SELECT id AS skill_id FROM sk ORDER BY confidence DESC, id LIMIT 20")
def skills_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    return analytics.skill_list(skills(spark, d), skill_links(spark, d), spark.createDataFrame([], "id string, title string"), "confidence").select("skill_id")


CTX = MEM + """, cx AS (SELECT session_id, project_id, max(extracted) AS updated FROM mem GROUP BY 1, 2),
o3 AS (SELECT session_id FROM cx WHERE project_id = 'src1' AND session_id <> 's1' ORDER BY updated DESC, session_id LIMIT 3)"""


@query("session_context_parts", CTX + """
SELECT * FROM (SELECT 'session' AS part, id FROM mem WHERE state <> 'removed' AND session_id = 's1' ORDER BY extracted DESC, id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'recent', id FROM mem WHERE state <> 'removed' AND session_id IN (SELECT session_id FROM o3) ORDER BY extracted DESC, id LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'persistent', id FROM mem WHERE project_id = 'src1' AND state = 'high' ORDER BY confidence DESC, extracted DESC, id LIMIT 20)""")
def session_context_parts(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    contexts = m.groupBy("session_id", "project_id").agg(F.max("extracted_at").alias("updated_at"))
    return browse.session_context(m, contexts, "s1", "src1").select("part", "id")


@query("recent_memories", MEM + """, se AS (SELECT session_id, max(extracted) AS created FROM mem WHERE project_id = 'src1' GROUP BY 1 ORDER BY created DESC, session_id LIMIT 3)
SELECT id FROM mem WHERE state <> 'removed' AND session_id IN (SELECT session_id FROM se) ORDER BY extracted DESC, id LIMIT 20""")
def recent_memories(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    s = m.where("project_id = 'src1'").groupBy(F.col("session_id").alias("id"), "project_id").agg(F.max("extracted_at").alias("created_at"))
    return browse.recent_memories(m, s, "src1").select("id")


@query("project_markdown", MEM + """, p AS (SELECT *, row_number() OVER (PARTITION BY project_id, memory_type ORDER BY confidence DESC, extracted DESC, id) AS place FROM mem WHERE state <> 'removed'),
h(memory_type, r, head) AS (VALUES ('decision', 1, '## Key Decisions'), ('fact', 2, '## Facts & Discoveries'), ('preference', 3, '## Preferences'), ('context', 4, '## Context'), ('task', 5, '## Tasks')),
sec AS (SELECT project_id, memory_type, count(*) AS n, string_agg('- **' || title || '**: ' || content, chr(10) ORDER BY place) AS lines FROM p WHERE place <= 5 GROUP BY 1, 2)
SELECT project_id, 'Project Context for ''' || upper(project_id) || ''' (' || sum(n)::BIGINT || ' memories):' || chr(10) || chr(10) || string_agg(head || chr(10) || lines || chr(10) || chr(10), '' ORDER BY r) AS markdown
FROM sec JOIN h USING (memory_type) GROUP BY 1""")
def project_markdown(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    return browse.project_markdown(m, m.select("project_id", F.upper("project_id").alias("name")).distinct())


@query("longest_prefix_resolve", """
WITH f AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS folder FROM pages UNION SELECT DISTINCT upper(regexp_extract(url, '^(https?://[^/]+/[^/]*)', 1)) FROM pages WHERE page_id % 3 = 0),
g AS (SELECT folder, md5(folder) AS pid FROM f WHERE folder <> '')
SELECT page_id, (SELECT pid FROM g WHERE starts_with(lower(url), lower(folder)) ORDER BY length(folder) DESC, pid DESC LIMIT 1) AS project_id FROM pages""")
def longest_prefix_resolve(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    hosts = pages.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("folder_path"))
    parts = pages.where("page_id % 3 = 0").select(F.upper(F.regexp_extract("url", "^(https?://[^/]+/[^/]*)", 1)).alias("folder_path"))
    folders = hosts.union(parts).distinct().where("folder_path <> ''").withColumn("id", F.md5("folder_path"))
    return browse.project_of_path(pages, folders, "url").select("page_id", "project_id")


@query("missing_embeddings", MEM + " SELECT id, title || chr(10) || content AS embed_text FROM mem WHERE state <> 'removed' AND id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.vectors import missing

    return missing(memories(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("memory_id"))).select("id", "embed_text")
