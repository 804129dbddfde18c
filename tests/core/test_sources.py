"""Line reading, both formats and their rollups."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import rollups
from loomtrace.sources import lines, messages


def rows(spark, events, session="s"):
    out, at = [], 0
    for i, e in enumerate(events):
        line = e if isinstance(e, str) else json.dumps(e, ensure_ascii=False)
        out.append((session, i, at, len(line.encode()), line))
        at += len(line.encode()) + 1
    return spark.createDataFrame(out, "session_id string, line_no bigint, byte_offset bigint, byte_length bigint, line string")


def by_line(frame):
    return {r.sequence_num: r for r in frame.collect()}


def test_files_that_are_sessions(spark):
    names = ["a/x.jsonl", "a/agent-1.jsonl", "a/x-agent-2.jsonl", "a/x.json", "b/agentx.jsonl"]
    got = {r.p: r.ok for r in spark.createDataFrame([(n,) for n in names], "p string").withColumn("ok", lines.is_session_file(F.col("p"))).collect()}
    assert [n for n in names if got[n]] == ["a/x.jsonl", "b/agentx.jsonl"]


def test_offsets_of_lines(spark, tmp_path):
    raw = "{\"a\":\"ü\"}\n\n{\"b\":1}\r\n漢字\nlast".encode()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "s1.jsonl").write_bytes(raw)
    got = lines.scan(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(0, '{"a":"ü"}'), (1, ""), (2, '{"b":1}'), (3, "漢字"), (4, "last")]
    for r in got:
        assert raw[r.byte_offset : r.byte_offset + r.byte_length].decode().rstrip("\r\n") == r.line
    assert lines.scan(spark, str(tmp_path), partial=False).count() == 4
    tail = lines.read_bytes(spark, str(tmp_path / "sub" / "s1.jsonl"), got[2].byte_offset).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in tail] == [(1, '{"b":1}'), (2, "漢字"), (3, "last")]


def test_what_a_file_needs(spark, tmp_path):
    for name, size in (("same", 10), ("grown", 20), ("shrunk", 5), ("new", 7), ("bare", 9)):
        (tmp_path / f"{name}.jsonl").write_text("x" * (size - 1) + "\n")
    at = lambda n: f"file:{tmp_path}/{n}.jsonl"
    state = spark.createDataFrame([(at("same"), 10, 3, 2, 3), (at("grown"), 10, 3, 2, 3), (at("shrunk"), 10, 3, 2, 3), (at("bare"), 4, 0, -1, 0)], "path string, file_size bigint, message_count bigint, max_sequence bigint, next_line bigint")
    got = {r.path.rsplit("/", 1)[1]: (r.action, r.max_sequence) for r in lines.changes(spark, str(tmp_path), state).collect()}
    assert got == {"same.jsonl": ("skip", 2), "grown.jsonl": ("tail", 2), "shrunk.jsonl": ("full", 2), "new.jsonl": ("full", -1), "bare.jsonl": ("full", -1)}


A = [
    {"type": "user", "uuid": "u1", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "how to `fix` it?"}},
    {"type": "assistant", "uuid": "u2", "timestamp": "2024-01-01T00:10:00Z", "message": {"model": "m1", "usage": {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": "7"}, "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "so"}]}},
    {"type": "assistant", "uuid": "u3", "timestamp": "2024-01-01T01:00:00Z", "message": {"content": [{"type": "tool_use", "name": "Write", "input": {"file_path": "/a/b.py", "content": "x\ny"}}]}},
    {"type": "user", "parentUuid": "u3", "timestamp": "2024-01-01T01:10:00+00:00", "message": {"content": [{"type": "tool_result", "content": [{"type": "text", "text": "Error: no"}, {"type": "image"}]}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "content": "ok"}]}, "toolUseResult": {"exitCode": None}},
    {"type": "user", "isMeta": True, "message": {"content": "rules"}},
    {"type": "user", "message": {"content": "a <task-notification>\n done \n</task-notification> b"}},
    {"type": "system", "content": "booted"},
    {"type": "system", "level": 3},
    {"type": "file-history-snapshot"},
    {"type": "queue"},
    "not json",
    "",
    {"type": "user", "content": "top level"},
]


def test_format_a(spark):
    got = by_line(messages.format_a(rows(spark, A)))
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 13]
    assert (got[0].role, got[0].search_content, got[0].has_code, got[0].tool_type) == ("user", "how to `fix` it?", True, None)
    assert (got[1].input_tokens, got[1].output_tokens, got[1].cache_read_tokens, got[1].model) == (10, 5, None, "m1")
    assert got[1].search_content == "Thinking...\n\nhm\n\nso"
    assert (got[2].event_type, got[2].tool_name, got[2].tool_type, got[2].tool_summary) == ("tool_use", "Write", "use", "Writing to b.py...")
    assert got[2].content_preview == "Write b.py: x y..." and got[2].has_file_changes is False
    assert json.loads(got[2].search_content) == A[2]["message"]["content"][0] and got[2].search_content.startswith(" {")
    assert (got[3].tool_name, got[3].tool_summary, got[3].has_error, got[3].has_file_changes, got[3].search_content) == ("Write", "File created successfully at: b.py", True, True, "Error: no")
    assert (got[4].tool_name, got[4].tool_summary, got[4].role) == ("Bash", "Bash command", "user")
    assert (got[5].role, got[5].tool_name) == ("system", "skill-prompt")
    assert (got[6].tool_name, got[6].search_content) == ("task-notification", "done")
    assert got[7].search_content == "booted" and json.loads(got[8].search_content) == A[8]
    assert (got[9].content_preview, got[9].has_file_changes) == ("File history snapshot", True)
    assert got[13].search_content == "top level"
    assert got[3].byte_offset == sum(len(json.dumps(e, ensure_ascii=False).encode()) + 1 for e in A[:3])


def test_lines_that_are_no_json(spark):
    assert sorted((r.line_no, r.error) for r in messages.errors(rows(spark, A)).collect()) == [(11, "Failed to parse line 11"), (12, "Failed to parse line 12")]


def test_call_of_an_earlier_batch(spark):
    first, later = rows(spark, A[:3]), rows(spark, A[3:4])
    stored = messages.A.calls(first)
    assert messages.format_a(later).first().tool_name is None
    assert messages.format_a(later, stored).first().tool_name == "Write"


B = [
    {"type": "session", "id": "s-9", "timestamp": "2026-02-16T01:00:00Z", "cwd": "/w"},
    {"type": "model_change", "id": "x"},
    {"type": "message", "id": "m1", "timestamp": "2026-02-16T01:00:01Z", "message": {"role": "user", "content": [{"type": "text", "text": "[Mon 2026-02-16 01:47 UTC] hello there"}]}},
    {"type": "message", "id": "m2", "timestamp": "2026-02-16T01:00:02Z", "message": {"role": "assistant", "model": "mm", "content": [{"type": "text", "text": "  hi \n"}, {"type": "text", "text": " "}, {"type": "thinking", "thinking": "t" * 300}], "usage": {"input": 100, "output": 20}}},
    {"type": "message", "id": "m3", "timestamp": "2026-02-16T01:00:03Z", "message": {"role": "assistant", "content": [{"type": "toolCall", "id": "c", "name": "bash", "arguments": {"command": "ls " + "x" * 60}}], "usage": {"input": 120, "output_tokens": 30}}},
    {"type": "message", "id": "m4", "parentId": "m3", "timestamp": "2026-02-16T01:00:04Z", "message": {"role": "toolResult", "toolCallId": "c", "isError": True, "content": [{"type": "text", "text": "done"}]}},
    {"type": "message", "message": {"role": "toolResult", "toolName": "edit", "content": "fine"}},
    {"type": "message", "message": {"role": "other"}},
]


def test_format_b(spark):
    got = by_line(messages.format_b(rows(spark, B)))
    assert sorted(got) == [0, 2, 3, 4, 5, 6]
    assert got[0].search_content == "Session started: s-9 (cwd: /w)" and got[0].role == "system"
    assert got[2].search_content == "hello there"
    assert got[3].search_content == "hi\n\nThinking: " + "t" * 200 + "..." and got[3].model == "mm"
    assert (got[4].tool_name, got[4].input_tokens, got[4].output_tokens) == ("bash", 120, 30)
    assert got[4].tool_summary == "ls " + "x" * 47 + "..." == got[4].content_preview
    assert (got[5].role, got[5].tool_type, got[5].tool_name, got[5].has_error, got[5].tool_summary) == ("user", "result", "bash", True, got[4].tool_summary)
    assert (got[6].tool_name, got[6].has_file_changes, got[6].tool_summary) == ("edit", True, "Editing file")
    s = rollups.stats(messages.format_b(rows(spark, B))).first()
    assert (s.total_events, s.human_messages, s.assistant_messages, s.tool_uses, s.total_input_tokens, s.total_output_tokens) == (6, 1, 1, 3, 220, 50)


def test_rollups(spark):
    m = rollups.metadata(messages.format_a(rows(spark, A))).first()
    assert (m.start_time, m.end_time) == ("2024-01-01T00:00:00Z", "2024-01-01T01:10:00+00:00")
    assert m.duration_ms == 20 * 60 * 1000
    assert (m.model, m.title) == ("m1", "how to `fix` it?")
    one = rollups.metadata(messages.format_a(rows(spark, A[:1]))).first()
    assert one.duration_ms is None and one.start_time == "2024-01-01T00:00:00Z"


def test_a_rollup_shuffles_once_and_cuts_titles_as_the_whole_text(spark):
    texts = ["x" * 80, "x" * 81, "ü" * 40, "ü" * 41, "漢" * 200, "x" * 79 + "ü", "x" * 78 + "漢" * 2, "😀" * 90, ""]
    own = spark.createDataFrame([(str(i), n, "user" if n < 2 else "system", t if n == 0 else "later") for i, t in enumerate(texts) for n in range(3)], "session_id string, sequence_num bigint, role string, search_content string")
    none = {c: F.lit(None).cast(k) for c, k in (("tool_type", "string"), ("has_code", "boolean"), ("has_error", "boolean"), ("model", "string"), ("input_tokens", "bigint"), ("output_tokens", "bigint"), ("cache_read_tokens", "bigint"), ("cache_creation_tokens", "bigint"))}
    own = own.withColumns(none).withColumns({"ts": F.timestamp_seconds(F.col("sequence_num") * 60), "timestamp": F.lit("t")})
    found = rollups.metadata(own)
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    want = {str(i): t if len(t.encode()) <= 80 else t.encode()[:80].decode(errors="ignore") + "..." for i, t in enumerate(texts)}
    assert {r.session_id: r.title for r in found.collect()} == want
    assert {(r.total_events, r.max_sequence, r.duration_ms) for r in rollups.whole(own).collect()} == {(3, 2, 60_000)}


def test_registry():
    assert messages.of_tool("claude_code") is messages.of_tool("claude-code") is messages.A
    assert messages.of_tool("openclaw") is messages.B and messages.of_tool("other") is None


@pytest.mark.parametrize("name,source", [("A", A), ("B", B)])
def test_empty_input(spark, name, source):
    fmt = getattr(messages, name)
    assert fmt.parse(rows(spark, source).limit(0), None).collect() == []


def test_tail_pieces_cut_anywhere(tmp_path):
    """However the bytes arrive, every line comes once, whole, with its number and place; nothing but sizes is asked on the driver."""
    import random

    from loomtrace.sources import tail_source

    r = random.Random(3)
    content = b"".join(("x" * r.randint(0, 30) + r.choice(["", "é", "漢"])).encode() + r.choice([b"\n", b"\r\n"]) for _ in range(60))
    want = [(n, at, size, line) for n, at, size, line in lines.cut_lines(content)]
    for remember in (True, False):
        path = tmp_path / f"s{remember}.jsonl"
        reader, start, got = tail_source.TailReader(str(tmp_path)), {}, []
        cuts = sorted({*r.sample(range(1, len(content)), 25), len(content)})
        for stop in cuts:
            path.write_bytes(content[:stop])
            end = {p: v for p, v in reader.latestOffset().items() if p == str(path)}
            for piece in reader.partitions(start, end):
                if not remember:
                    tail_source._COUNTED.clear()
                got += [x[2:6] for x in reader.read(piece)]
            start = end
        assert got == want
        path.write_bytes(b"anew\n")
        end = {p: v for p, v in reader.latestOffset().items() if p == str(path)}
        assert [x[1:] for p in reader.partitions(start, end) for x in reader.read(p)] == [(str(path), 0, 0, 5, "anew", True)]


def test_files_are_written_whole_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"{n % 40}.jsonl", n // 40, f"é {n}") for n in range(4000)], "name string, line_no bigint, line string")
    lines.write_files(rows.repartition(8), f"file://{tmp_path}")
    found = {p.name: p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {f"{k}.jsonl": "".join(f"é {k + 40 * i}\n" for i in range(100)) for k in range(40)}
    assert len(list(tmp_path.iterdir())) <= lines.FOLDERS


def test_a_file_meets_its_messages_once(spark, tmp_path):
    path = tmp_path / "7.jsonl"
    path.write_bytes(b"".join(b'{"n":%d}\n' % n for n in range(500)))
    wanted = lines.scan(spark, str(tmp_path)).select("session_id", F.col("line_no").alias("sequence_num"), "byte_offset", "byte_length")
    sessions = spark.createDataFrame([("7", str(path), None)], "id string, file_path string, archived_file_path string")
    got = lines.content_at(spark, wanted, sessions, [str(tmp_path)])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and {r.content for r in got.collect()} == {f'{{"n":{n}}}' for n in range(500)}


def test_small_files_share_tasks(tmp_path):
    from loomtrace.sources import tail_source

    for n in range(600):
        (tmp_path / f"{n}.jsonl").write_bytes(b"%d\n" % n)
    reader = tail_source.TailReader(str(tmp_path))
    tasks = reader.partitions({}, reader.latestOffset())
    assert len(tasks) == 3 and sorted(int(x[5]) for t in tasks for x in reader.read(t)) == list(range(600))
