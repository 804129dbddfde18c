"""The engine's methods, one group for each group of requests. All reads return DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tokens import terms
from .operators import analytics, browse, changes, extract, ranking, search, similar, vectors
from .operators.staging import stored
from .operators.store import Store
from .sources import lines, normalize


class Engine:
    """``now`` is a column, so that runs can be repeated; ``embedder`` makes the callable that embeds texts."""

    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[], vectors.Embedder] | None = None, now: Column | None = None):
        self.spark, self.store = spark, Store(spark, root).ready()
        self.embedder, self.now = embedder, F.current_timestamp() if now is None else now

    def table(self, name: str) -> DataFrame:
        if name == "memories":
            return changes.with_access(self.store.read("memories"), self.store.read("memory_access"))
        return self.store.read(name)

    def _patch(self, name: str, key: str, value, allowed: tuple[str, ...], values: dict, **also: Column) -> None:
        unknown = set(values) - set(allowed)
        if unknown:
            raise ValueError(f"cannot set {sorted(unknown)}")
        if values:
            self.store.write(name, changes.patch(self.store.read(name), F.col(key) == value, **{k: F.lit(v) for k, v in values.items()}, **also))

    def _delete(self, name: str, where: Column) -> None:
        names = {name, *[c for cs in (changes.CHILDREN.get(name, ()), *(changes.CHILDREN.get(c, ()) for c, _ in changes.CHILDREN.get(name, ()))) for c, _ in cs]}
        tables = {n: self.store.read(n) for n in names}
        after = changes.delete(tables, name, where)
        if "session_messages" in after:
            gone = tables["sessions"].join(after["sessions"].select("id"), "id", "left_anti").select(F.col("id").alias("session_id"))
            self.store.replace("session_messages", self.store.empty("session_messages"), gone)
        # Children first: what they are joined with is still there.
        order = sorted((n for n in after if n != "session_messages"), key=lambda n: (n == name, n in changes.CHILDREN))
        for n in order:
            self.store.write(n, after[n], keep=3)

    # Projects

    def projects(self, limit: int = 100, offset: int = 0) -> DataFrame:
        return browse.projects(self.table("projects"), limit, offset)

    def project(self, project_id: str) -> DataFrame:
        return self.table("projects").where(F.col("id") == project_id)

    def create_project(self, folder_path: str) -> None:
        row = self.spark.createDataFrame([(folder_path, folder_path.rsplit("/", 1)[-1])], "folder_path string, folder string")
        old = self.store.read("projects")
        self.store.write("projects", old.unionByName(self.store._shaped(changes.new_projects(row, old, self.now), "projects")))

    def update_project(self, project_id: str, **values) -> None:
        self._patch("projects", "id", project_id, ("name", "description", "repo_url", "language", "framework", "auto_sync"), values, updated_at=self.now)

    def delete_project(self, project_id: str) -> None:
        self._delete("projects", F.col("id") == project_id)

    def resolve(self, path: str) -> DataFrame:
        return browse.project_of_path(self.spark.createDataFrame([(path,)], "path string"), self.table("projects"))

    def project_analytics(self, project_id: str) -> dict[str, DataFrame]:
        s = self.table("sessions").where(F.col("project_id") == project_id)
        m = self.table("session_messages").join(s.select(F.col("id").alias("session_id")), "session_id", "left_semi")
        return {
            "stats": analytics.project_stats(s, m), "models_used": analytics.models_used(s, m), "session_metrics": analytics.session_metrics(s, m).orderBy(F.desc("created_at"), "session_id"),
            "active_dates": analytics.active_dates(s).orderBy(F.desc("date")), "daily_tokens": analytics.daily_tokens(s, m).orderBy(F.desc("date")),
            "daily_errors": analytics.daily_errors(s, m).orderBy(F.desc("date")), "daily_vibe": analytics.daily_vibe(s, m).orderBy(F.desc("date")),
        }

    # Sessions and messages

    def sessions(self, project_id: str | None = None, include_hidden: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
        return browse.sessions(self.table("sessions"), project_id, include_hidden, limit, offset)

    def session(self, session_id: str) -> DataFrame:
        return self.table("sessions").where(F.col("id") == session_id)

    def update_session(self, session_id: str, **values) -> None:
        self._patch("sessions", "id", session_id, ("title", "is_hidden"), values, **({"title_edited": F.lit(True)} if "title" in values else {}))

    def store_title(self, session_id: str, title: str) -> None:
        self._patch("sessions", "id", session_id, ("title",), {"title": title}, title_ai_generated=F.lit(True), indexed_at=self.now)

    def note_extraction(self, session_id: str, what: str) -> None:
        hit = F.col("id") == session_id
        self.store.write("sessions", changes.patch(self.store.read("sessions"), hit, **{f"{what}_extracted_at": self.now, f"{what}_extracted_count": F.col("message_count")}))

    def delete_session(self, session_id: str) -> None:
        self._delete("sessions", F.col("id") == session_id)

    def messages(self, session_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        return browse.page(self.table("session_messages").where(F.col("session_id") == session_id).orderBy("sequence_num"), limit, offset)

    def content(self, session_id: str, sequence_num: int) -> DataFrame:
        """A message's own line, in format A whatever the tool."""
        one = self.table("session_messages").where((F.col("session_id") == session_id) & (F.col("sequence_num") == sequence_num))
        return lines.content_at(self.spark, one, self.table("sessions")).withColumn("content", normalize.to_format_a(F.col("content")))

    def read_bytes(self, session_id: str, offset: int = 0) -> DataFrame:
        path = self.session(session_id).select(F.coalesce("archived_file_path", "file_path")).first()[0]
        return lines.read_bytes(self.spark, path, offset)

    def append_messages(self, rows: DataFrame) -> None:
        """rows: session_id, place, and columns of a message."""
        stored = self.store.of("session_messages", rows)
        self.store.append("session_messages", self.store._shaped(changes.appended(stored, rows), "session_messages"))
        more = rows.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("_n"))
        old = self.store.of("sessions", more)
        self.store.replace("sessions", old.join(more, "id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).select(old.columns), more)

    def agent_summary(self, rows: DataFrame) -> None:
        stored = self.store.of("session_messages", rows)
        self.store.replace("session_messages", changes.agent_summaries(stored, rows), rows.select("session_id").distinct())

    # Search

    def _texts(self, name: str) -> tuple[DataFrame, str, Column]:
        """What is searched of a table: its rows, their key, and their text."""
        if name == "session_messages":
            return self.table(name).withColumn("doc", F.struct("session_id", "sequence_num")), "doc", F.col("search_content")
        columns, lists = {"memories": (("title", "content", "context"), "tags"), "skills": (("name", "description"), "steps")}[name]
        return self.table(name), "id", F.concat_ws(" ", *columns, F.array_join(lists, " "))

    def index(self, name: str = "session_messages") -> DataFrame:
        """Postings of a table, to be stored and given to searches."""
        rows, key, text = self._texts(name)
        return search.postings(rows, key, tokens=terms(text))

    def _hits(self, name: str, query: str, index: DataFrame | None, among: DataFrame | None = None) -> DataFrame:
        """By an index, or without one in a single pass over the texts."""
        rows, key, text = self._texts(name)
        return search.scan_text(rows, key, text, query, among=among) if index is None else search.search(index, key, query, among=among)

    def search_messages(self, query: str, project_id: str | None = None, session_id: str | None = None, role: str | None = None, has_code: bool = False, limit: int = 100, index: DataFrame | None = None) -> DataFrame:
        scoped = self.table("session_messages").where(search.message_scope(role, has_code))
        scoped = scoped if session_id is None else scoped.where(F.col("session_id") == session_id)
        s = self.table("sessions").select(F.col("id").alias("session_id"), "project_id", "title")
        s = s if project_id is None else s.where(F.col("project_id") == project_id)
        scoped = scoped.join(s, "session_id").withColumn("doc", F.struct("session_id", "sequence_num"))
        hits = self._hits("session_messages", query, index)
        return hits.join(scoped, "doc").drop("doc").orderBy("bm25", "session_id", "sequence_num").limit(limit)

    def search_memories(self, query: str | None, project_id: str | None, types: list[str] = (), tags: list[str] = (), limit: int = 20, track: bool = True, index: DataFrame | None = None) -> DataFrame:
        """Keywords fused with vectors where there are some; across projects keywords alone; without a query the best."""
        m = self.table("memories")
        if query is None:
            found = browse.browse(m, project_id, types, tags, limit)
        else:
            own = m.where("state <> 'removed'")
            own = own if project_id is None else own.where(F.col("project_id") == project_id)
            own = browse.among(own, "memory_type", list(types)) if types else own
            own = own.where(browse.has_all_tags(list(tags), False))
            hits = self._hits("memories", search.prefix_query(query), index, own)
            near = None
            if project_id is not None and self.embedder is not None:
                vector = [float(x) for x in self.embedder()([query])[0]]
                near = vectors.top_similar(self.store.read("memory_embeddings").withColumnRenamed("memory_id", "id").join(own.select("id"), "id", "left_semi"), "id", vector, 3 * limit)
            found = vectors.hybrid("id", hits, near, limit).join(own, "id").orderBy(F.desc("score"), "id")
        if track:
            self.track(found.select("id"))
        return found

    def track(self, ids: DataFrame) -> None:
        self.store.append("memory_access", changes.track(ids, self.now))

    # Memories, skills, markers

    def memories(self, **filters) -> DataFrame:
        return browse.memories(self.table("memories"), **filters)

    def add_memories(self, new: DataFrame) -> DataFrame:
        """Those that nothing stands for yet are stored, with vectors. ``new``: session_id, project_id, and fields. Returns the verdicts."""
        old = self.table("memories")
        ready = changes.numbered(new, old, ["project_id", "title"]).withColumns({"state": F.lit("new"), "is_validated": F.lit(False), "access_count": F.lit(0), "extracted_at": self.now})
        shaped = stored(self.store._shaped(ready, "memories"))
        verdicts = similar.admit(shaped, old, similar.MEMORY)
        verdicts = stored(verdicts)
        self.store.append("memories", shaped.join(verdicts.where("twin IS NULL").select("id"), "id", "left_semi"))
        return verdicts

    def add_skills(self, new: DataFrame) -> DataFrame:
        """A skill that is known already gets one more session instead."""
        old = self.store.read("skills")
        ready = changes.numbered(new, old, ["project_id", "name"]).withColumn("extracted_at", self.now)
        shaped = stored(self.store._shaped(ready, "skills"))
        verdicts = stored(similar.admit(shaped, old, similar.SKILL, live="true"))
        self.store.append("skills", shaped.join(verdicts.where("twin IS NULL").select("id"), "id", "left_semi"))
        links = shaped.join(verdicts, ["id", "project_id"]).select(F.coalesce("twin", "id").alias("skill_id"), "session_id", self.now.alias("added_at"))
        known = self.store.read("skill_sessions")
        self.store.append("skill_sessions", changes.insert_absent(known, links, ["skill_id", "session_id"]))
        return verdicts

    def update_memory(self, memory_id: int, **values) -> None:
        self._patch("memories", "id", memory_id, ("state", "confidence", "is_validated"), values)

    def remove_memory(self, memory_id: int) -> None:
        self._patch("memories", "id", memory_id, ("state",), {"state": "removed"})

    def skills(self, **settings) -> DataFrame:
        return analytics.skill_list(self.table("skills"), self.table("skill_sessions"), self.table("sessions"), **settings)

    def delete_skill(self, skill_id: int) -> None:
        self._delete("skills", F.col("id") == skill_id)

    def markers(self, session_id: str) -> DataFrame:
        return self.table("session_markers").where(F.col("session_id") == session_id).orderBy("event_index", "id")

    def set_markers(self, rows: DataFrame) -> None:
        old = self.store.read("session_markers")
        self.store.write("session_markers", changes.replace_for(old, self.store._shaped(changes.numbered(rows, old, ["event_index"]), "session_markers"), "session_id"))

    def delete_marker(self, marker_id: int) -> None:
        self.store.write("session_markers", self.store.read("session_markers").where(F.col("id") != marker_id))

    # Upkeep

    def rank(self) -> DataFrame:
        """One sweep over all projects; returns the report."""
        m = self.table("memories")
        evaluated = ranking.evaluate(ranking.batch(m, self.now), self.now)
        report = stored(ranking.report(evaluated))
        self.store.write("memories", ranking.apply(self.store.read("memories").drop("access_count", "last_accessed_at").join(m.select("id", "access_count", "last_accessed_at"), "id"), self.now))
        self.store.write("memory_access", self.store.empty("memory_access"))
        return report

    def ranking_stats(self) -> DataFrame:
        return ranking.state_counts(self.table("memories"))

    def clean_memories(self) -> None:
        """Near-duplicates of an older memory go out of sight."""
        m = self.store.read("memories")
        gone = similar.leaders(m.where("state <> 'removed'"), similar.MEMORY_CLEANUP, ["extracted_at"]).select("id", F.lit(True).alias("_gone"))
        self.store.write("memories", m.join(gone, "id", "left").withColumn("state", F.when(F.col("_gone"), "removed").otherwise(F.col("state"))).select(m.columns))

    def clean_skills(self) -> None:
        """Near-duplicates of an older skill are deleted with what belongs to them."""
        s = self.store.read("skills")
        gone = similar.leaders(s, similar.SKILL_CLEANUP, ["extracted_at"]).select(F.col("id").alias("skill_id"))
        for name in ("skill_embeddings", "skill_sessions"):
            self.store.write(name, self.store.read(name).join(gone, "skill_id", "left_anti"))
        self.store.write("skills", s.join(gone, s["id"] == gone["skill_id"], "left_anti"))

    def embed_missing(self) -> None:
        if self.embedder is None:
            return
        old = self.store.read("memory_embeddings")
        todo = vectors.missing(self.store.read("memories"), old)
        new = vectors.embed(todo, "id", F.col("embed_text"), self.embedder).withColumnRenamed("id", "memory_id")
        self.store.write("memory_embeddings", changes.upsert(old, new, ["memory_id"]))

    # Context

    def project_context(self, project_id: str) -> DataFrame:
        names = self.table("projects").where(F.col("id") == project_id).select(F.col("id").alias("project_id"), "name")
        own = self.table("memories").where(F.col("project_id") == project_id)
        self.track(browse.top_per_type(own).select("id"))
        return browse.project_markdown(own, names)

    def session_context(self, session_id: str, project_id: str) -> DataFrame:
        have = self.store.read("session_context")
        one = self.spark.createDataFrame([(session_id, project_id)], "session_id string, project_id string")
        self.store.write("session_context", have.unionByName(self.store._shaped(changes.contexts_for(one, have, self.now), "session_context")))
        found = browse.session_context(self.table("memories"), self.store.read("session_context"), session_id, project_id)
        self.track(found.select("id"))
        return found

    def recent_memories(self, project_id: str, sessions: int = 3, limit: int = 20) -> DataFrame:
        return browse.recent_memories(self.table("memories"), self.table("sessions"), project_id, sessions, limit)

    def save_lifeboat(self, session_id: str, summary: str | None = None) -> None:
        self.store.write("session_context", changes.lifeboat(self.store.read("session_context"), session_id, summary, self.now))

    # Model work

    def pending(self, least: int = 25) -> DataFrame:
        return browse.pending(self.table("sessions"), least)

    def extract_memories(self, make: Callable[[], extract.Model], instruction: str, least: int = extract.LEAST_MESSAGES) -> DataFrame:
        """Ask the model about every session worth it; store what it finds. Returns the verdicts."""
        wanted = self.table("sessions").where(browse.worth_extracting("memories")).select(F.col("id").alias("session_id"), "project_id")
        texts = extract.memory_transcript(self.table("session_messages"), least).join(wanted, "session_id")
        answers = extract.ask(texts.withColumn("prompt", F.concat(F.lit(instruction + "\n\n"), "text")), make, ["session_id"])
        found = extract.memories_of(answers).join(wanted, "session_id")
        return self.add_memories(found)
