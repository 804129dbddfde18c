"""Lists, filters, pages and context views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TYPES = ("decision", "fact", "preference", "context", "task")
SORTS = {"confidence": "confidence", "extracted_at": "extracted_at", "title": "title", "memory_type": "memory_type", "access_count": "access_count", "last_accessed_at": "last_accessed_at", "state": "state"}
LONG_LIST = 200


def page(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """-1 or none: no limit."""
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None or limit < 0 else rows.limit(limit)


def among(rows: DataFrame, column: str, values: list) -> DataFrame:
    """An IN list; a long one becomes a semi-join."""
    if len(values) <= LONG_LIST:
        return rows.where(F.col(column).isin(*values))
    kind = rows.select(column).schema[0].dataType.simpleString()
    return rows.join(rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} {kind}"), column, "left_semi")


def comma_list(raw: str | None) -> list[str]:
    return [x.strip() for x in (raw or "").split(",") if x.strip()]


def has_all_tags(wanted: list[str], either_case: bool) -> Column:
    """All tags wanted are there; for lists in either case, for search results exactly."""
    if not wanted:
        return F.lit(True)
    own = F.transform("tags", lambda x: F.lower(x)) if either_case else F.col("tags")
    asked = sorted({w.lower() if either_case else w for w in wanted})
    return F.coalesce(F.size(F.array_intersect(own, F.array(*map(F.lit, asked)))) == len(asked), F.lit(False))


def memories(
    table: DataFrame, project_id: str | None = None, types: list[str] = (), min_confidence: float | None = None, validated: bool | None = None, state: str | None = None,
    tags: list[str] = (), sort: str = "confidence", descending: bool = True, limit: int = 100, offset: int = 0,
) -> DataFrame:
    """Memories not removed, whatever state is asked for. Tags are filtered before the limit."""
    rows = table.where("state <> 'removed'")
    if project_id is not None:
        rows = rows.where(F.col("project_id") == project_id)
    if types:
        rows = among(rows, "memory_type", list(types))
    if min_confidence is not None:
        rows = rows.where(F.col("confidence") >= min_confidence)
    if validated:
        rows = rows.where("is_validated")
    if state is not None:
        rows = rows.where(F.col("state") == state)
    rows = rows.where(has_all_tags(list(tags), True))
    column = F.col(SORTS.get(sort, "confidence"))
    down = descending or sort not in SORTS
    return page(rows.orderBy(column.desc() if down else column.asc(), "id"), limit, offset)


def best_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("confidence"), F.desc("extracted_at"), "id")


def browse(table: DataFrame, project_id: str, types: list[str] = (), tags: list[str] = (), limit: int = 20) -> DataFrame:
    rows = table.where((F.col("state") != "removed") & (F.col("project_id") == project_id)).where(has_all_tags(list(tags), False))
    return best_first(among(rows, "memory_type", list(types)) if types else rows).limit(limit)


def top_per_type(table: DataFrame, k: int = 5, by: list[str] = ("project_id", "memory_type")) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("confidence"), F.desc("extracted_at"), "id")
    return table.where("state <> 'removed'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def last_messages(messages: DataFrame, n: int = 50) -> DataFrame:
    order = W.partitionBy("session_id").orderBy(F.desc("sequence_num"))
    return messages.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def sessions(table: DataFrame, project_id: str | None = None, include_hidden: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = table if include_hidden else table.where(~F.coalesce("is_hidden", F.lit(False)))
    rows = rows if project_id is None else rows.where(F.col("project_id") == project_id)
    return page(rows.orderBy(F.desc("created_at"), "id"), limit, offset)


def projects(table: DataFrame, limit: int = 100, offset: int = 0, by_name: bool = False) -> DataFrame:
    return page(table.orderBy("name" if by_name else F.desc("updated_at"), "id"), limit, offset)


def project_of_path(paths: DataFrame, projects: DataFrame, path: str = "path") -> DataFrame:
    """For each path the project of the longest folder that begins it, letters of either case alike.

    Candidates come from an equi-join on the path's own beginnings at the lengths that folders have.
    """
    folders = projects.select(F.col("id").alias("project_id"), "folder_path", F.lower("folder_path").alias("head"), F.length("folder_path").alias("n"))
    lengths = sorted(r.n for r in folders.select("n").distinct().collect() if r.n is not None)  # as many as a path has characters
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(path)), lambda n: F.lower(F.substring(F.col(path), F.lit(1), n)))
    each = paths.select(path).distinct().withColumn("head", F.explode(heads))
    best = each.join(folders, "head").groupBy(path).agg(F.max_by("project_id", F.struct("n", "project_id")).alias("project_id"))
    return paths.join(best, path, "left")


def project_of_suffix(projects: DataFrame, asked: str) -> DataFrame:
    """A project by id, or by the last part of its folder."""
    return projects.where((F.col("id") == asked) | F.lower("folder_path").endswith(f"/{asked.lower()}"))


def pending(sessions: DataFrame, least: int = 25, newest: int = 50) -> DataFrame:
    """Sessions that read well, are long enough and lack a title, memories or skills; newest first."""
    lacks = lambda c: F.col(c).isNull()
    needs = ~F.coalesce("title_ai_generated", F.lit(False)) & ~F.coalesce("title_edited", F.lit(False)) | lacks("memories_extracted_at") | lacks("skills_extracted_at")
    ok = F.coalesce("import_status", F.lit("success")) == "success"
    return sessions.where(ok & (F.col("message_count") >= least) & needs).orderBy(F.desc("created_at"), "id").limit(newest)


def worth_extracting(what: str, least_new: int = 25) -> Column:
    """Not extracted yet, or enough messages since."""
    fresh = F.coalesce("message_count", F.lit(0)) - F.coalesce(f"{what}_extracted_count", F.lit(0))
    return F.col(f"{what}_extracted_at").isNull() | (fresh >= least_new)


def session_context(memories: DataFrame, contexts: DataFrame, session_id: str, project_id: str) -> DataFrame:
    """The session's own 20, 15 of the three other contexts changed last, and 20 of high state: (part, place, memory)."""
    live = memories.where("state <> 'removed'")
    best, last = [F.desc("confidence"), F.desc("extracted_at"), F.col("id")], [F.desc("extracted_at"), F.col("id")]
    newest = lambda rows, n: rows.orderBy(*last).limit(n)
    others = contexts.where((F.col("project_id") == project_id) & (F.col("session_id") != session_id)).orderBy(F.desc("updated_at"), "session_id").limit(3).select("session_id")
    own = newest(live.where(F.col("session_id") == session_id), 20)
    recent = newest(live.join(others, "session_id", "left_semi"), 15)
    lasting = best_first(live.where((F.col("project_id") == project_id) & (F.col("state") == "high"))).limit(20)
    placed = lambda order: F.row_number().over(W.orderBy(*order)).alias("place")  # noqa: E731  of 20 rows
    parts = [x.select(F.lit(p).alias("part"), placed(o), *memories.columns) for p, x, o in (("session", own, last), ("recent", recent, last), ("persistent", lasting, best))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def recent_memories(memories: DataFrame, sessions: DataFrame, project_id: str, n_sessions: int = 3, limit: int = 20) -> DataFrame:
    last = sessions.where(F.col("project_id") == project_id).orderBy(F.desc("created_at"), "id").limit(n_sessions).select(F.col("id").alias("session_id"))
    return memories.where("state <> 'removed'").join(last, "session_id", "left_semi").orderBy(F.desc("extracted_at"), "id").limit(limit)


#: Texts of the views. {} stands for what is filled in.
CONTEXT_HEAD, CONTEXT_NONE = "Project Context for '{}' ({} memories):\n\n", "No memories found for project '{}'."
RESULTS_HEAD, RESULTS_NONE, RESULTS_QUERY = "Found {} memories in project '{}'{}:\n\n", "No memories found{} in project '{}'.", " for query '{}'"
#: Headings of the sections of a project's context.
HEADINGS = {"decision": "## Key Decisions", "fact": "## Facts & Discoveries", "preference": "## Preferences", "context": "## Context", "task": "## Tasks"}


def filled(text: str, *values: Column) -> Column:
    """``text`` with its {} filled in."""
    parts = text.split("{}")
    return F.concat(*[x for part, value in zip(parts, [*values, F.lit("")], strict=True) for x in (F.lit(part), value)])


def project_markdown(table: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """(project_id, markdown): the best ``k`` of each type under its heading. ``names``: project_id, name."""
    best = top_per_type(table, k)
    line = F.concat(F.lit("- **"), "title", F.lit("**: "), "content")
    rank = F.array_position(F.array(*map(F.lit, HEADINGS)), F.col("memory_type"))
    sections = best.groupBy("project_id", "memory_type").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    heading = F.element_at(F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair]), F.col("memory_type"))
    whole = sections.withColumn("text", F.concat(heading, F.lit("\n"), "lines", F.lit("\n\n"))).groupBy("project_id").agg(F.sum("n").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "text"))), lambda x: x["text"]), "").alias("body"))
    found = names.join(whole, "project_id", "left")
    head = filled(CONTEXT_HEAD, F.col("name"), F.col("total").cast("string"))
    none = filled(CONTEXT_NONE, F.col("name"))
    return found.select("project_id", F.coalesce(F.concat(head, "body"), none).alias("markdown"))


def results_markdown(rows: DataFrame, project: str, asked: str | None, order: Column) -> DataFrame:
    """One row: numbered search results with type, confidence, content and tags."""
    place = rows.withColumn("i", F.row_number().over(W.orderBy(order, "id")))
    shown = F.concat(
        F.col("i").cast("string"), F.lit(". ["), F.initcap("memory_type"), F.lit("] "), "title", F.lit(" (confidence: "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%)\n   "), "content", F.lit("\n"),
        F.when(F.size("tags") > 0, F.concat(F.lit("   Tags: "), F.array_join("tags", ", "), F.lit("\n"))).otherwise(""), F.lit("\n"),
    )
    body = place.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", shown.alias("s")))), lambda x: x["s"]), "").alias("body"))
    query = "" if asked is None else RESULTS_QUERY.format(asked)
    found = F.concat(filled(RESULTS_HEAD, F.col("n").cast("string"), F.lit(project), F.lit(query)), "body")
    return body.select(F.when(F.col("n") > 0, found).otherwise(F.lit(RESULTS_NONE.format(query, project))).alias("markdown"))


#: Headings of a session's context, in order.
PARTS = {"persistent": "### Persistent Knowledge (High Importance)", "session": "### This Session's Memories", "recent": "### Recent Memories (Last 3 Sessions)"}


def session_markdown(found: DataFrame, context: DataFrame, project: str, k: int = 5) -> DataFrame:
    """One row: the session's state and the first ``k`` of each part of `session_context`."""
    bullet = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(f"\n**{head}:**\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")))
    state = context.select(F.concat_ws(
        "", F.lit(f"## Session Context for {project}\n\n### Current State\n"), F.concat(F.lit("**Active Task:** "), "active_task", F.lit("\n")), F.concat(F.lit("**Resume Context:** "), "resume_context", F.lit("\n")),
        bullet("recent_decisions", "Recent Decisions"), bullet("open_questions", "Open Questions"),
    ).alias("state"))
    line = F.concat(F.lit("- **["), F.initcap("memory_type"), F.lit("] "), "title", F.lit("**: "), "content", F.lit("\n"))
    listed = found.withColumn("line", line).groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines"))
    own = F.map_from_entries(F.collect_list(F.struct("part", F.array_join(F.slice("lines", 1, k), "").alias("text"))))
    by_part = listed.agg(own.alias("m")).select("m").scalar()
    rows = state.withColumn("m", by_part)
    parts = [F.concat(F.lit(f"\n{head}\n"), F.try_element_at("m", F.lit(part))) for part, head in PARTS.items()]
    return rows.select(F.concat_ws("", "state", *parts).alias("markdown"))
