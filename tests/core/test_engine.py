"""Ingest of growing files, the store, and the facade end to end."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomtrace.api import Engine
from loomtrace.operators import store as store_of
from loomtrace.operators import vectors
from loomtrace.operators.store import Store
from loomtrace.sources.normalize import event_to_a, to_format_a
from loomtrace.streaming import ingest


@pytest.fixture(scope="module")
def now(spark):
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def event(i, kind="user", text="hello", **more):
    return json.dumps({"type": kind, "uuid": f"u{i}", "timestamp": f"2024-01-01T00:{i:02d}:00Z", "message": {"content": text}, **more}) + "\n"


CALL = json.dumps({"type": "assistant", "uuid": "c1", "timestamp": "2024-01-01T00:05:00Z", "message": {"content": [{"type": "tool_use", "name": "Edit", "input": {"file_path": "/x/y.py"}}]}}) + "\n"
RESULT = json.dumps({"type": "user", "parentUuid": "c1", "timestamp": "2024-01-01T00:06:00Z", "message": {"content": [{"type": "tool_result", "content": "done"}]}}) + "\n"


def drive(spark, folder, store, how, now, checkpoint):
    if how == "poll":
        ingest.poll(spark, str(folder), store, "claude_code", now)
    else:
        q = ingest.watch(spark, str(folder), store, "claude_code", str(checkpoint), once=True)
        q.awaitTermination(120)
        assert q.exception() is None


@pytest.mark.parametrize("how", ["poll", "stream"])
def test_a_file_that_grows_and_shrinks(spark, tmp_path, now, how):
    folder = tmp_path / "in" / "-home-me-app"
    folder.mkdir(parents=True)
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    f = folder / "s1.jsonl"
    go = lambda: drive(spark, tmp_path / "in", store, how, now, tmp_path / "ck")
    seqs = lambda: sorted(r.sequence_num for r in store.read("session_messages").where("session_id = 's1'").collect())

    f.write_text(event(0) + event(1, "assistant") + '{"type": "us')  # the last line is not complete
    (folder / "agent-x.jsonl").write_text(event(0))
    go()
    assert seqs() == [0, 1]
    s = store.read("sessions").first()
    assert (s.id, s.message_count, s.duration_ms, s.title, s.ai_tool) == ("s1", 2, 60_000, "hello", "Claude Code")
    assert store.read("projects").first().folder_path.endswith("-home-me-app")

    f.write_text(event(0) + event(1, "assistant") + event(2) + CALL)
    (folder / "s2.jsonl").write_text(event(0, text="other"))
    go()
    assert seqs() == [0, 1, 2, 3] and store.read("sessions").count() == 2

    with f.open("a") as out:  # the answer to a call of an earlier batch
        out.write(RESULT)
    go()
    last = store.read("session_messages").where("session_id = 's1' and sequence_num = 4").first()
    assert (last.tool_name, last.tool_summary, last.has_file_changes) == ("Edit", "Successfully edited y.py", True)
    assert store.read("sessions").where("id = 's1'").first().duration_ms == 6 * 60_000
    raw = f.read_bytes()[last.byte_offset : last.byte_offset + last.byte_length]
    assert json.loads(raw) == json.loads(RESULT)

    go()
    assert seqs() == [0, 1, 2, 3, 4]

    f.write_text(event(7, text="anew"))
    go()
    assert seqs() == [0]
    assert store.read("session_messages").where("session_id = 's2'").count() == 1
    s = store.read("sessions").where("id = 's1'").first()
    assert (s.message_count, s.title) == (1, "hello")  # the title stays, as before
    assert {r.event for r in store.read("service_events").collect()} == {"session:new", "session:changed", "session:parsed"}


def test_a_batch_applied_twice_counts_once(spark, tmp_path, now):
    store = Store(spark, str(tmp_path), buckets=2)
    line = event(0).strip()
    batch = spark.createDataFrame([("s", "/p/s.jsonl", 0, 0, len(line) + 1, line, False)], "session_id string, path string, line_no bigint, byte_offset bigint, byte_length bigint, line string, restarted boolean")
    for _ in range(2):
        ingest.apply_lines(store, batch, "claude_code", now, batch_id="q/0")
    assert store.read("session_messages").count() == 1 and store.read("sessions").first().message_count == 1
    assert sorted(r.event for r in store.read("service_events").collect()) == ["session:new", "session:parsed"]
    with pytest.raises(ValueError):
        ingest.apply_lines(store, batch, "unknown", now)


def test_a_batch_asks_for_its_buckets_once(spark, tmp_path, now, monkeypatch):
    store, asked, own = Store(spark, str(tmp_path), buckets=2), [], Store._bucket
    monkeypatch.setattr(Store, "_bucket", lambda self, column, buckets: asked.append(column) or own(self, column, buckets))
    line = event(0).strip()
    for n in range(2):
        batch = spark.createDataFrame([("s", "/p/s.jsonl", n, n * 99, len(line) + 1, line, False)], "session_id string, path string, line_no bigint, byte_offset bigint, byte_length bigint, line string, restarted boolean")
        asked.clear()
        ingest.apply_lines(store, batch, "claude_code", now, batch_id=f"q/{n}")
        assert len(asked) == 5  # once for the keys, and for the rows of each of four tables
    assert (store.read("sessions").first().message_count, store.read("file_state").first().max_sequence) == (2, 1)


def test_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("skills").count() == 0
    for n in (1, 2, 3):
        store.write("skills", spark.createDataFrame([(n, "p")], "id bigint, project_id string").unionByName(store.read("skills").select("id", "project_id")))
    assert sorted(r.id for r in store.read("skills").collect()) == [1, 2, 3]
    assert len(store._versions("skills")) == 2 and len(store._children(f"{tmp_path}/skills/data")) == 2


def messages(spark, *rows):
    return spark.createDataFrame(list(rows), "session_id string, sequence_num bigint, search_content string")


def test_other_buckets_stay_unread_and_untouched(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    store.append("session_messages", messages(spark, *[(f"s{i}", 0, "a") for i in range(40)]))
    before = store._version("session_messages")["parts"]
    key = messages(spark, ("s7", 0, "b")).select("session_id")
    [own] = store._touched("session_messages", key, 8)
    assert all(f"bucket={own}/" in f for f in store.of("session_messages", key).inputFiles())
    store.replace("session_messages", messages(spark, ("s7", 0, "b"), ("s7", 1, "c")), key)
    store.append("session_messages", messages(spark, ("s7", 1, "again"), ("s7", 2, "d")))
    after = store._version("session_messages")["parts"]
    assert {b for b in after if after[b] != before.get(b)} == {own}
    assert sorted(r.search_content for r in store.read("session_messages").where("session_id = 's7'").collect()) == ["b", "c", "d"]
    assert store.read("session_messages").count() == 42


def test_appends_are_merged_and_a_batch_counts_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_of, "FAN", 3)
    store = Store(spark, str(tmp_path), buckets=2)
    row = lambda i: spark.createDataFrame([(f"s{i}", f"c{i}")], "session_id string, id string")
    for i in range(10):
        for _ in range(2):
            store.append("calls", row(i), f"b{i}")
        assert store.has_batch("calls", f"b{i}")
    assert sorted(r.id for r in store.read("calls").collect()) == sorted(f"c{i}" for i in range(10))
    assert all(len(x) < 6 for x in store._version("calls")["parts"].values())


def test_a_second_writer_fails(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.write("skills", spark.createDataFrame([(1, "p")], "id bigint, project_id string"))
    monkeypatch.setattr(store, "_versions", lambda name: [])
    with pytest.raises(RuntimeError):
        store.write("skills", spark.createDataFrame([(2, "p")], "id bigint, project_id string"))
    monkeypatch.undo()
    assert store.read("skills").first().id == 1


def test_normalised_events(spark):
    b = {"type": "message", "id": "i", "parentId": "p", "timestamp": "t", "message": {"role": "assistant", "model": "m", "content": [{"type": "toolCall", "id": "c", "name": "n", "arguments": {"a": 1}}, {"type": "text", "text": "x"}], "usage": {"input": 1, "cacheRead": 2}}}
    assert event_to_a(b) == {"uuid": "i", "parentUuid": "p", "timestamp": "t", "type": "assistant", "message": {"content": [{"type": "tool_use", "name": "n", "input": {"a": 1}, "id": "c"}, {"type": "text", "text": "x"}], "model": "m", "usage": {"input_tokens": 1, "cache_read_input_tokens": 2}}}
    assert event_to_a({"type": "message", "message": {"role": "toolResult", "toolCallId": "c", "toolName": "n", "content": "r"}}) == {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c", "content": "r"}]}, "toolUseResult": {"toolName": "n"}}
    user = {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "[Mon 2026-02-16 01:30 UTC] hi"}, {"type": "text", "text": "[note that this is no time at all 20] hi"}]}}
    assert [x["text"] for x in event_to_a(user)["message"]["content"]] == ["hi", "[note that this is no time at all 20] hi"]
    assert event_to_a({"type": "session", "id": "s", "timestamp": "t"}) == {"type": "system", "timestamp": "t", "content": '{"id":"s","timestamp":"t","type":"session"}'}
    raw = ["not json", None, '{"type":"user"}', json.dumps(user)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "v string").select(to_format_a(F.col("v"))).collect()]
    assert got[:3] == raw[:3] and json.loads(got[3])["type"] == "user"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory, now):
    top = tmp_path_factory.mktemp("engine")
    folder = top / "in" / "-home-me-app"
    folder.mkdir(parents=True)
    for s, words in (("s1", "fix the queue retries"), ("s2", "write `code` for the parser")):
        lines = [event(i, "user" if i % 2 == 0 else "assistant", f"{words} number {i}") for i in range(30)]
        (folder / f"{s}.jsonl").write_text("".join(lines))
    e = Engine(spark, str(top / "store"), embedder=lambda: vectors.hashed_embedder(32), now=now)
    e.store.buckets = 4
    ingest.poll(spark, str(top / "in"), e.store, "claude_code", now)
    return e


def test_sessions_and_search(engine):
    assert [s.id for s in engine.sessions().collect()] == ["s1", "s2"]
    assert engine.messages("s1", 3, 2).select("sequence_num").collect() == [(2,), (3,), (4,)]
    hits = engine.search_messages("queue retries", limit=100).collect()
    assert len(hits) == 30 and {h.session_id for h in hits} == {"s1"}
    assert {h.session_id for h in engine.search_messages("parser", role="user", has_code=True).collect()} == {"s2"}
    assert json.loads(engine.content("s1", 4).first().content)["uuid"] == "u4"
    assert engine.read_bytes("s1", 0).count() == 30


def test_changing_sessions(engine):
    engine.update_session("s1", title="mine", is_hidden=True)
    s = engine.session("s1").first()
    assert (s.title, s.title_edited, s.is_hidden) == ("mine", True, True)
    assert [x.id for x in engine.sessions().collect()] == ["s2"] and engine.sessions(include_hidden=True).count() == 2
    engine.update_session("s1", is_hidden=False)
    with pytest.raises(ValueError):
        engine.update_session("s1", message_count=1)
    engine.append_messages(engine.spark.createDataFrame([("s1", 0, "user", "by hand"), ("s1", 1, "user", "again")], "session_id string, place int, role string, search_content string"))
    assert [m.sequence_num for m in engine.messages("s1").where("search_content in ('by hand', 'again')").collect()] == [30, 31]
    assert engine.session("s1").first().message_count == 32


def test_analytics(engine):
    project = engine.projects().first().id
    a = engine.project_analytics(project)
    stats = a["stats"].first()
    assert stats.total_sessions == 2 and stats.user_messages >= 30
    assert a["session_metrics"].count() == 2 and a["active_dates"].count() == 1
    path = engine.projects().first().folder_path + "/deep/er"
    assert engine.resolve(path).first().project_id == project


def test_extraction_to_retrieval(engine):
    project = engine.projects().first().id

    def make():
        def model(prompt):
            topic = "queue" if "queue" in prompt else "parser"
            return json.dumps([{"type": "decision", "title": f"Use the {topic}", "content": f"The {topic} decides about retries", "tags": ["T1"], "confidence": 0.9}, {"type": "fact", "title": f"About {topic}", "content": "x" * 30 + topic}])

        return model

    verdicts = engine.extract_memories(make, "Find memories", least=25)
    assert verdicts.count() == 4
    stored = engine.memories().collect()
    assert {m.title for m in stored} >= {"About queue", "About parser"} and all(m.state == "new" for m in stored)
    again = engine.extract_memories(make, "Find memories", least=25)
    assert {r.twin is None for r in again.collect()} == {False}
    engine.embed_missing()
    assert engine.store.read("memory_embeddings").count() == len(stored)
    found = engine.search_memories("queue", project).collect()
    assert "queue" in (found[0].title + found[0].content)
    assert [m.title for m in engine.search_memories(None, project, types=["decision"], tags=["T1"], limit=1).collect()][0].startswith("Use the")
    assert engine.search_memories("queue", project, tags=["t1"]).count() == 0  # tags of results are matched exactly
    assert engine.memories(tags=["t1"]).count() >= 1
    assert engine.table("memories").agg(F.sum("access_count")).first()[0] >= 2
    text = engine.project_context(project).first().markdown
    assert "## Key Decisions" in text and "## Facts & Discoveries" in text
    parts = engine.session_context("s1", project).collect()
    assert {p.part for p in parts} >= {"session"}
    engine.save_lifeboat("s1")
    report = engine.rank().first()
    assert report.memories_evaluated == len(stored)
    engine.update_memory(stored[0].id, confidence=0.1)
    engine.remove_memory(stored[0].id)
    assert engine.memories().count() == len(stored) - 1
    engine.clean_memories()


def test_skills_and_markers(engine):
    project = engine.projects().first().id
    schema = "session_id string, project_id string, name string, description string, steps array<string>, confidence double"
    new = engine.spark.createDataFrame([("s1", project, "Retry queue", "retry the queue when it fails", ["a"], 0.8), ("s2", project, "Parse lines", "parse all lines of the file", ["b"], 0.9)], schema)
    assert {r.twin for r in engine.add_skills(new).collect()} == {None}
    verdict = engine.add_skills(engine.spark.createDataFrame([("s2", project, "Retry queue", "other", ["a"], 0.8)], schema)).first()
    assert verdict.twin is not None
    listed = {r.name: r.frequency for r in engine.skills().collect()}
    assert listed == {"Retry queue": 2, "Parse lines": 1}
    engine.clean_skills()
    engine.delete_skill(verdict.twin)
    assert [r.name for r in engine.skills().collect()] == ["Parse lines"]
    markers = engine.spark.createDataFrame([("s1", 3, "bug", "Found", None), ("s1", 1, "ship", "Out", None)], "session_id string, event_index int, marker_type string, label string, description string")
    engine.set_markers(markers)
    engine.set_markers(markers.limit(1))
    assert [m.label for m in engine.markers("s1").collect()] == ["Found"]
    engine.delete_marker(engine.markers("s1").first().id)
    assert engine.markers("s1").count() == 0


def test_deleting_what_belongs_together(engine):
    engine.delete_session("s2")
    assert engine.messages("s2").count() == 0 and engine.messages("s1").count() > 0
    assert engine.memories().where("session_id = 's2'").count() == 0
    project = engine.projects().first().id
    engine.update_project(project, name="renamed")
    assert engine.project(project).first().name == "renamed"
    engine.delete_project(project)
    assert engine.projects().count() == 0 and engine.sessions().count() == 0 and engine.table("session_messages").count() == 0


def test_idle_windows_on_a_stream(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, 0)), (1, datetime(2024, 1, 1, 0, 30)), (1, datetime(2024, 1, 1, 1, 0, 1)), (2, datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "k int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    q = ingest.idle_windows(stream, "k", "ts").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.k, r.n) for r in spark.table("windows").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_watched_folders_and_jobs(spark, tmp_path, now):
    from loomtrace.streaming import upkeep

    folders = [upkeep.Watched("~/a", "claude_code"), upkeep.Watched("/b", "openclaw", False), upkeep.Watched("/c", "other")]
    assert [w.path for w in upkeep.usable(folders)] == ["~/a"] and not folders[0].folder.startswith("~")
    assert all(w in upkeep.usable(upkeep.DEFAULT_FOLDERS) for w in upkeep.DEFAULT_FOLDERS)
    e = Engine(spark, str(tmp_path), now=now)
    for job in upkeep.EVERY_HOURS:
        upkeep.run(e, job)
    assert e.memories().count() == 0


def test_jobs_fall_due_one_after_another():
    from loomtrace.streaming import upkeep

    assert upkeep.due({}, 100.0, 100.0) == ["ranking"]
    assert upkeep.due({}, 131.0, 100.0) == list(upkeep.EVERY_HOURS)
    last = dict.fromkeys(upkeep.EVERY_HOURS, 0.0)
    assert upkeep.due(last, 6 * 3600.0) == ["ranking"] and upkeep.due(last, 24 * 3600.0) == list(upkeep.EVERY_HOURS)


def test_jobs_are_run_told_and_stopped(spark, tmp_path, now, monkeypatch):
    """The loop runs what is due; a failure and a run that takes too long are events, and the loop goes on."""
    import time
    from threading import Event

    from loomtrace.streaming import upkeep

    e, stop = Engine(spark, str(tmp_path), now=now), Event()

    def slow():
        def rest(parts):
            for p in parts:
                time.sleep(30)
                yield p

        spark.range(4, numPartitions=2).mapInPandas(rest, "id bigint").collect()

    def fails():
        raise ValueError("no")

    monkeypatch.setattr(e, "embed_missing", slow)
    monkeypatch.setattr(e, "clean_memories", fails)
    monkeypatch.setattr(upkeep, "STAGGER", 0)
    monkeypatch.setitem(upkeep.MOST_SECONDS, "embedding_refresh", 2)
    times = iter([0.0] * 6)
    ticks = lambda: next(times, None) if not stop.is_set() else 0.0

    def clock():
        t = ticks()
        if t is None:
            stop.set()
            return 0.0
        return t

    upkeep.keep_up(e, stop, clock, pause=0.0)
    events = [(r.event, json.loads(r.payload)) for r in e.store.read("service_events").collect()]
    by = {(n, p["job"]): p for n, p in events}
    assert {j for n, j in by if n == upkeep.STARTED} == set(upkeep.EVERY_HOURS)
    assert {j for n, j in by if n == upkeep.ENDED} == {"ranking", "skill_cleanup"}
    assert by[upkeep.FAILED, "embedding_refresh"]["error"] == "took too long" and "ValueError" in by[upkeep.FAILED, "duplicate_cleanup"]["error"]
