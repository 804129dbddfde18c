"""Transcript lines of both formats made from ``conversations``, and what their parsers, readers and store make of them.

Each row of ``conversations`` becomes one line; which kind of line follows from its
ids. The lines are templates that Spark and SQL fill alike, byte for byte. What a
message should look like is known by construction, so the SQL twins say it without
parsing anything.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_folder, stored
from ..operators.store import Store
from ..sources import lines as src
from ..sources import messages, normalize
from ..streaming import ingest
from .registry import query, table

#: In templates: @U own id, @P id of the line before, @T time, @N a number, @X the text as JSON has it, @Y the text itself.
MARK = re.compile(r"@([UPTNXY])")
CALL = '{"message":{"content":[%s{"id":"c@N","input":{%s},"name":"%s","type":"tool_use"}],"model":"m@N","usage":{"input_tokens":@N,"output_tokens":7}},"parentUuid":"@P","timestamp":"@T","type":"assistant","uuid":"@U"}'
BACK = '{"type":"user","uuid":"@U","parentUuid":"@P","timestamp":"@T",%s"message":{"content":[{"type":"tool_result","content":%s}]}}'
LINES_A = [
    '{"type":"user","uuid":"@U","parentUuid":"@P","timestamp":"@T","message":{"role":"user","content":"@X"}}',
    '{"type":"user","uuid":"@U","timestamp":"@T","message":{"content":[{"type":"text","text":"@X"},{"type":"image"},{"type":"text","text":"tail @N"}]}}',
    '{"type":"user","uuid":"@U","content":"@X"}',
    '{"type":"user","isMeta":true,"uuid":"@U","timestamp":"@T","message":{"content":"@X"}}',
    '{"type":"user","uuid":"@U","timestamp":"@T","message":{"content":"<task-notification>\\n  @X \\n</task-notification> more"}}',
    BACK % ("", '"@X"'),
    BACK % ("", '[{"type":"text","text":"@X"},{"type":"text","text":"error @N"}]'),
    BACK % ('"toolUseResult":{"exitCode":null},', '{"n":@N}'),
    BACK % ('"toolUseResult":{"file":{"filePath":"/x"}},', '"@X"'),
    BACK % ('"toolUseResult":{"success":true},', '"failed @N"'),
    '{"type":"assistant","uuid":"@U","timestamp":"@T","message":{"model":"m@N","content":[{"type":"thinking","thinking":"think @N"},{"type":"text","text":"@X"}],"usage":{"input_tokens":@N,"output_tokens":2,"cache_read_input_tokens":"3","cache_creation_input_tokens":4}}}',
    '{"type":"assistant","uuid":"@U","timestamp":"@T","message":{"content":"@X"}}',
    CALL % ("", '"command":"run @N @X"', "Bash"),
    CALL % ("", '"other":1', "Bash"),
    CALL % ("", '"content":"@X","file_path":"/a/b/file@N.txt"', "Write"),
    CALL % ('{"text":"@X","type":"text"},', '"file_path":"/a/f@N.py"', "Edit"),
    CALL % ("", '"file_path":"/a/b/r@N.md"', "Read"),
    CALL % ("", '"pattern":"@X"', "Grep"),
    CALL % ("", '"pattern":"**/*@N.ts"', "Glob"),
    CALL % ("", '"description":"@X"', "Task"),
    CALL % ("", '"url":"u@N"', "WebFetch"),
    '{"type":"system","uuid":"@U","timestamp":"@T","content":"@X"}',
    '{"level":"info","n":@N,"timestamp":"@T","type":"system","uuid":"@U"}',
    '{"type":"file-history-snapshot","uuid":"@U"}',
    '{"type":"progress","uuid":"@U","content":"@X"}',
    '{"type":"user", broken @N',
]
MSG = '{"type":"message","id":"@U","parentId":"@P","timestamp":"@T","message":{"role":"%s",%s}}'
LINES_B = [
    '{"cwd":"/w/@N","id":"@U","timestamp":"@T","type":"session"}',
    '{"type":"model_change","id":"@U"}',
    '{"type":"custom","id":"@U","message":{"role":"user","content":"@X"}}',
    "broken @N",
    MSG % ("user", '"content":"[Mon 2024-01-01 10:00 UTC] @X"'),
    MSG % ("user", '"content":[{"type":"text","text":"@X"},{"type":"thinking","thinking":"why @N"}]'),
    MSG % ("user", '"content":{"a":@N}'),
    MSG % ("assistant", '"model":"m@N","content":[{"type":"thinking","thinking":"@X"},{"type":"text","text":"  said @N "},{"type":"text","text":" "}],"usage":{"input":@N,"output":2,"cacheRead":null,"cacheWrite":4}'),
    MSG % ("assistant", '"content":[{"arguments":{"file_path":"/a/r@N.md"},"id":"c@N","name":"read","type":"toolCall"}],"usage":{"input_tokens":@N,"output_tokens":5,"cache_read_input_tokens":6}'),
    MSG % ("assistant", '"content":[{"text":"@X","type":"text"},{"id":"c@N","input":{"command":"run @N @X"},"name":"Bash","type":"tool_use"}]'),
    MSG % ("assistant", '"content":[{"arguments":{"z":1},"id":"c@N","type":"toolCall"}]'),
    MSG % ("toolResult", '"toolName":"write","isError":false,"content":"@X"'),
    MSG % ("toolResult", '"toolCallId":"c@N","content":"@X"'),
    MSG % ("toolResult", '"isError":true,"content":[{"type":"text","text":"fine @N"}]'),
    MSG % ("assistant", '"content":"@X"'),
    MSG % ("assistant", '"content":[{"arguments":{"content":"@X","file_path":"/a/w@N.txt"},"id":"c@N","name":"Write","type":"toolCall"}]'),
    MSG % ("other", '"content":"@X"'),
    MSG % ("assistant", '"content":[{"arguments":{"pattern":"@X"},"id":"c@N","name":"grep","type":"toolCall"}]'),
]


def _case(kinds: list[str]) -> str:
    return f"((conv_id * conv_id * 3 + turn * turn * 7 + conv_id * turn * 11 + turn * 3) % {len(kinds)})"


def _parts(template: str) -> list[tuple[bool, str]]:
    """(whether it is a mark, text) in order."""
    return [(k % 2 == 1, x) for k, x in enumerate(MARK.split(template)) if x]


def _filled(template: str) -> Column:
    return F.concat(*[F.col(f"_{x}") if mark else F.lit(x) for mark, x in _parts(template)], F.lit(""))


def told(template: str) -> str:
    """The template as a SQL expression over u, p, t, n, x and y."""
    return " || ".join([x.lower() if mark else "'" + x.replace("'", "''") + "'" for mark, x in _parts(template)] or ["''"])


def _cases(of: dict[int, str] | list[str], other: str = "NULL", by: str = "c") -> str:
    items = of.items() if isinstance(of, dict) else enumerate(of)
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN {v}" for k, v in items) + f" ELSE {other} END"


def lines(spark: SparkSession, d: str, kinds: list[str]) -> DataFrame:
    """session_id, path, line_no, byte_offset, byte_length, line of the whole table, as a reader gives them."""
    from pyspark.sql import Window as W

    text = F.regexp_replace("text", r'[\x00-\x09\x0B-\x1F"\\]', " ")
    rows = table(spark, d, "conversations").withColumns({
        "_U": F.expr("concat('u', conv_id, '-', turn)"), "_P": F.expr("concat('u', conv_id, '-', turn - 1)"), "_N": F.expr("cast(conv_id * 100 + turn AS string)"),
        "_T": F.expr("date_format(timestamp_seconds(1704067200 + conv_id * 86400 + turn * 120 + CASE WHEN turn >= 4 THEN 3600 ELSE 0 END), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"),
        "_Y": text, "_X": F.replace(text, F.lit("\n"), F.lit("\\n")), "_c": F.expr(_case(kinds)),
    })
    line = F.when(F.lit(False), F.lit(""))
    for k, template in enumerate(kinds):
        line = line.when(F.col("_c") == k, _filled(template))
    rows = rows.select(F.col("conv_id").cast("string").alias("session_id"), F.expr("concat('/t/', conv_id, '.jsonl')").alias("path"), F.col("turn").cast("bigint").alias("line_no"), line.alias("line"))
    rows = rows.withColumn("byte_length", (F.octet_length("line") + 1).cast("bigint"))
    before = W.partitionBy("session_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("byte_offset", F.coalesce(F.sum("byte_length").over(before), F.lit(0)))


def lines_sql(kinds: list[str]) -> str:
    """CTEs: s, a row per line with its marks and the case of the line before (pc); l, with line and offsets."""
    return rf"""s0 AS (SELECT conv_id, turn, {_case(kinds)} AS c, 'u' || conv_id || '-' || turn AS u, 'u' || conv_id || '-' || (turn - 1) AS p, (conv_id * 100 + turn)::VARCHAR AS n,
  1704067200 + conv_id * 86400 + turn * 120 + CASE WHEN turn >= 4 THEN 3600 ELSE 0 END AS sec, regexp_replace(text, '[\x00-\x09\x0B-\x1F"\\]', ' ', 'g') AS y FROM conversations),
s1 AS (SELECT *, strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS t, replace(y, chr(10), '\n') AS x FROM s0),
s AS (SELECT a.*, b.c AS pc, b.n AS pn, b.y AS py FROM s1 a LEFT JOIN s0 b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1),
l AS (SELECT *, {_cases([told(x) for x in kinds])} AS line FROM s),
o AS (SELECT l.*, strlen(line) + 1 AS byte_length, (sum(strlen(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - strlen(line) - 1)::BIGINT AS byte_offset FROM l)"""


def cut_sql(e: str, n: int) -> str:
    return f"CASE WHEN strlen({e}) <= {n} THEN {e} ELSE left({e}, list_max(list_filter(range(0, {n + 1}), lambda k: strlen(left({e}, k)) <= {n}))) || '...' END"


def preview_sql(e: str) -> str:
    """White space as one space, then cut; e is a column."""
    return cut_sql(e, 200)


PLAIN_SQL = r"trim(regexp_replace(array_to_string(list_transform(string_split(replace({e}, chr(27), ''), chr(10)), lambda q: regexp_replace(q, '^\s*\d+→', '')), ' '), '\s+', ' ', 'g'))"
CODE_SQL = "regexp_matches({e}, '```|`[^`]+`|function |class |const |let |var |import |export ')"
ERROR_SQL = "regexp_matches({e}, '(?i)error|exception|failed|cannot|undefined|null is not')"
TRIM_SQL = r"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def _call(inside: str, name: str) -> str:
    return '{"id":"c@N","input":{%s},"name":"%s","type":"tool_use"}' % (inside, name)


NL = "chr(10)"
SPACED = f"{NL} || {NL}"
USES_A = range(12, 21)
BACKS_A = range(5, 10)
SAID_A = {
    0: "y", 1: f"y || {NL} || 'tail ' || n", 2: "y", 3: "y", 4: TRIM_SQL.format(e="y"), 5: "y", 6: f"y || {NL} || 'error ' || n", 7: told('{"n":@N}'), 8: "y", 9: "'failed ' || n",
    10: f"'Thinking...' || {SPACED} || 'think ' || n || {SPACED} || y", 11: "y", 12: told(" " + _call('"command":"run @N @X"', "Bash")), 13: told(" " + _call('"other":1', "Bash")),
    14: told(" " + _call('"content":"@X","file_path":"/a/b/file@N.txt"', "Write")), 15: "y || " + told(" " + _call('"file_path":"/a/f@N.py"', "Edit")), 16: told(" " + _call('"file_path":"/a/b/r@N.md"', "Read")),
    17: told(" " + _call('"pattern":"@X"', "Grep")), 18: told(" " + _call('"pattern":"**/*@N.ts"', "Glob")), 19: told(" " + _call('"description":"@X"', "Task")), 20: told(" " + _call('"url":"u@N"', "WebFetch")),
    21: "y", 22: told(LINES_A[22]), 23: "'file history snapshot'",
}
NAMES_A = {12: "'Bash'", 13: "'Bash'", 14: "'Write'", 15: "'Edit'", 16: "'Read'", 17: "'Grep'", 18: "'Glob'", 19: "'Task'", 20: "'WebFetch'"}


def _summaries_a(n: str, y: str, done: bool) -> dict[int, str]:
    return {
        12: cut_sql(f"('run ' || {n} || ' ' || {y})", 50), 13: "'Bash command'",
        14: f"'File created successfully at: file' || {n} || '.txt'" if done else f"'Writing to file' || {n} || '.txt...'",
        15: f"'Successfully edited f' || {n} || '.py'" if done else f"'Editing f' || {n} || '.py...'",
        16: f"'Read r' || {n} || '.md'", 17: f"'Search: ' || ({cut_sql(y, 30)})", 18: f"'Files: **/*' || {n} || '.ts'", 19: cut_sql(y, 50), 20: "'Used WebFetch'",
    }


def _in(cases) -> str:
    return f"c IN ({', '.join(map(str, cases))})"


MESSAGES_A_SQL = "WITH " + lines_sql(LINES_A) + f""",
a0 AS (SELECT *, {_cases(SAID_A)} AS sc, coalesce(pc IN ({', '.join(map(str, USES_A))}), false) AS linked, {_cases(_summaries_a('n', 'y', False))} AS doing,
  {_cases(_summaries_a('pn', 'py', True), by='pc')} AS did, {_cases(NAMES_A, by='pc')} AS pname FROM o WHERE c < 24),
a1 AS (SELECT *, {PLAIN_SQL.format(e='sc')} AS pl, {PLAIN_SQL.format(e='y')} AS py_, CASE WHEN {_in(BACKS_A)} THEN CASE WHEN linked THEN pname ELSE {_cases({7: "'Bash'", 8: "'Read'", 9: "'Write'"})} END
  ELSE {_cases(NAMES_A)} END AS tool, CASE WHEN {_in(BACKS_A)} THEN CASE WHEN linked THEN did ELSE {_cases({7: "'Bash command'", 8: "'Reading file'", 9: "'Writing file'"}, "'Used Tool'")} END
  WHEN {_in(USES_A)} THEN doing END AS tool_summary FROM a0),
a AS (SELECT conv_id::VARCHAR AS session_id, turn::BIGINT AS sequence_num, CASE WHEN c <= 2 OR {_in(BACKS_A)} THEN 'user' WHEN c BETWEEN 10 AND 20 THEN 'assistant' ELSE 'system' END AS role,
  CASE WHEN {_in(BACKS_A)} THEN 'tool_result' WHEN {_in(USES_A)} THEN 'tool_use' END AS event_type,
  CASE WHEN c = 23 THEN 'File history snapshot' WHEN c = 12 THEN '$ run ' || n || ' ' || y WHEN c = 14 THEN 'Write file' || n || '.txt: ' || replace(left(y, 150), chr(10), ' ') || '...'
    WHEN c = 16 THEN 'Read /a/b/r' || n || '.md' WHEN c = 15 AND y <> '' THEN {cut_sql('py_', 200)} WHEN {_in(USES_A)} THEN tool_summary ELSE {cut_sql('pl', 200)} END AS content_preview,
  sc AS search_content, (c <= 2 OR {_in(BACKS_A)} OR c IN (10, 11)) AND {CODE_SQL.format(e='sc')} AS has_code, {_in(BACKS_A)} AND {ERROR_SQL.format(e='sc')} AS has_error,
  c = 23 OR ({_in(BACKS_A)} AND linked AND pname IN ('Write', 'Edit', 'NotebookEdit')) AS has_file_changes,
  CASE c WHEN 3 THEN 'skill-prompt' WHEN 4 THEN 'task-notification' WHEN 23 THEN 'file-history-snapshot' ELSE tool END AS tool_name,
  CASE WHEN {_in(BACKS_A)} THEN 'result' WHEN {_in(USES_A)} THEN 'use' END AS tool_type, tool_summary,
  CASE WHEN c = 10 OR {_in(USES_A)} THEN n::BIGINT END AS input_tokens, CASE WHEN c = 10 THEN 2 WHEN {_in(USES_A)} THEN 7 END::BIGINT AS output_tokens, NULL::BIGINT AS cache_read_tokens,
  CASE WHEN c = 10 THEN 4 END::BIGINT AS cache_creation_tokens, CASE WHEN c = 10 OR {_in(USES_A)} THEN 'm' || n END AS model, CASE WHEN c IN (2, 23) THEN '' ELSE t END AS timestamp,
  CASE WHEN c NOT IN (2, 23) THEN sec * 1000000 END::BIGINT AS ts_us, byte_offset, byte_length::BIGINT AS byte_length FROM a1)"""

USES_B = (8, 9, 10, 15, 17)
BACKS_B = (11, 12, 13)
BLOCK_B = {
    8: '{"arguments":{"file_path":"/a/r@N.md"},"id":"c@N","name":"read","type":"toolCall"}', 9: '{"id":"c@N","input":{"command":"run @N @X"},"name":"Bash","type":"tool_use"}',
    10: '{"arguments":{"z":1},"id":"c@N","type":"toolCall"}', 15: '{"arguments":{"content":"@X","file_path":"/a/w@N.txt"},"id":"c@N","name":"Write","type":"toolCall"}',
    17: '{"arguments":{"pattern":"@X"},"id":"c@N","name":"grep","type":"toolCall"}',
}
TOLD_B = {
    7: f"CASE WHEN y <> '' THEN 'Thinking: ' || ({cut_sql('y', 200)}) || {SPACED} ELSE '' END || 'said ' || n", 9: TRIM_SQL.format(e="y"), 14: "y",
}
SAID_B = {
    0: told("Session started: @U (cwd: /w/@N)"), 4: "y", 5: f"y || {SPACED} || 'Thinking...' || {SPACED} || 'why ' || n", 6: told('{"a":@N}'), 7: "told", 11: "y", 12: "y", 13: "'fine ' || n", 14: "told",
    **{k: f"told || ' ' || {told(v)}" for k, v in BLOCK_B.items()},
}
NAMES_B = {8: "'read'", 9: "'Bash'", 15: "'Write'", 17: "'grep'"}


def _summaries_b(n: str, y: str) -> dict[int, str]:
    return {8: f"'Read r' || {n} || '.md'", 9: cut_sql(f"('run ' || {n} || ' ' || {y})", 50), 10: "'Used tool'", 15: f"'Write w' || {n} || '.txt'", 17: f"'Search: ' || ({cut_sql(y, 30)})"}


MESSAGES_B_SQL = "WITH " + lines_sql(LINES_B) + f""",
b0 AS (SELECT *, {_cases(TOLD_B, "''")} AS told FROM o WHERE c NOT IN (1, 2, 3, 16)),
b1 AS (SELECT *, {_cases(SAID_B)} AS sc, CASE WHEN c = 11 THEN 'write' WHEN {_in(BACKS_B)} THEN coalesce({_cases(NAMES_B, by='pc')}, 'tool') WHEN {_in(USES_B)} THEN coalesce({_cases(NAMES_B)}, 'tool') END AS tool,
  CASE WHEN c = 11 THEN {_cases({8: "'Write r' || pn || '.md'", 15: "'Write w' || pn || '.txt'"}, "'Writing file'", by='pc')} WHEN {_in(BACKS_B)} THEN {_cases(_summaries_b('pn', 'py'), "'Used tool'", by='pc')}
  WHEN {_in(USES_B)} THEN {_cases(_summaries_b('n', 'y'))} END AS tool_summary FROM b0),
b2 AS (SELECT *, {PLAIN_SQL.format(e='sc')} AS pl, {PLAIN_SQL.format(e='told')} AS pt FROM b1),
b AS (SELECT conv_id::VARCHAR AS session_id, turn::BIGINT AS sequence_num, CASE WHEN c = 0 THEN 'system' WHEN c IN (4, 5, 6) OR {_in(BACKS_B)} THEN 'user' ELSE 'assistant' END AS role,
  CASE WHEN {_in(BACKS_B)} THEN 'tool_result' WHEN {_in(USES_B)} THEN 'tool_use' END AS event_type,
  CASE WHEN {_in(USES_B)} AND told = '' THEN tool_summary WHEN {_in(USES_B)} THEN {cut_sql('pt', 200)} ELSE {cut_sql('pl', 200)} END AS content_preview, sc AS search_content,
  (c IN (4, 5, 6, 7, 14) OR {_in(BACKS_B)}) AND {CODE_SQL.format(e='sc')} AS has_code, {_in(BACKS_B)} AND ({ERROR_SQL.format(e='sc')} OR c = 13) AS has_error,
  {_in(BACKS_B)} AND tool IN ('Write', 'write') AS has_file_changes, tool AS tool_name, CASE WHEN {_in(BACKS_B)} THEN 'result' WHEN {_in(USES_B)} THEN 'use' END AS tool_type, tool_summary,
  CASE WHEN c IN (7, 8) THEN n::BIGINT END AS input_tokens, CASE c WHEN 7 THEN 2 WHEN 8 THEN 5 END::BIGINT AS output_tokens, CASE WHEN c = 8 THEN 6 END::BIGINT AS cache_read_tokens,
  CASE WHEN c = 7 THEN 4 END::BIGINT AS cache_creation_tokens, CASE WHEN c = 7 THEN 'm' || n END AS model, t AS timestamp, sec::BIGINT * 1000000 AS ts_us, byte_offset, byte_length::BIGINT AS byte_length FROM b2)"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query("transcript_a_messages", MESSAGES_A_SQL + " SELECT * FROM a")
def transcript_a_messages(spark: SparkSession, d: str) -> DataFrame:
    """Format A: every kind of event, blocks, tool calls and the results that answer them, lines to drop and lines that are no JSON."""
    return _shown(messages.format_a(lines(spark, d, LINES_A)))


@query("transcript_b_messages", MESSAGES_B_SQL + " SELECT * FROM b")
def transcript_b_messages(spark: SparkSession, d: str) -> DataFrame:
    """Format B, likewise."""
    return _shown(messages.format_b(lines(spark, d, LINES_B)))


@query("transcript_batches", MESSAGES_A_SQL + " SELECT * FROM a")
def transcript_batches(spark: SparkSession, d: str) -> DataFrame:
    """Format A in two batches; results of the second answer calls of the first."""
    every, fmt = lines(spark, d, LINES_A), messages.of_tool("claude-code")
    early, late = every.where("line_no < 3"), every.where("line_no >= 3")
    return _shown(fmt.parse(early, None).unionByName(fmt.parse(late, fmt.calls(early))))


@query("transcript_errors", f"""
SELECT 'a' AS format, conv_id::VARCHAR AS session_id, turn::BIGINT AS line_no, 'Failed to parse line ' || turn AS error FROM conversations WHERE {_case(LINES_A)} = 25
UNION ALL SELECT 'b', conv_id::VARCHAR, turn, 'Failed to parse line ' || turn FROM conversations WHERE {_case(LINES_B)} = 3""")
def transcript_errors(spark: SparkSession, d: str) -> DataFrame:
    both = [messages.errors(lines(spark, d, kinds)).withColumn("format", F.lit(f)) for f, kinds in (("a", LINES_A), ("b", LINES_B))]
    return both[0].unionByName(both[1]).select("format", "session_id", "line_no", "error")


EVENT = '{"uuid":"@U","parentUuid":"@P","timestamp":"@T","type":"%s","message":{"content":%s%s}%s}'
NORMAL = {
    0: r'{"type":"system","timestamp":"@T","content":"{\"cwd\":\"/w/@N\",\"id\":\"@U\",\"timestamp\":\"@T\",\"type\":\"session\"}"}',
    4: EVENT % ("user", '"[Mon 2024-01-01 10:00 UTC] @X"', "", ""), 5: EVENT % ("user", '[{"type":"text","text":"@X"},{"type":"thinking","thinking":"why @N"}]', "", ""), 6: EVENT % ("user", '{"a":@N}', "", ""),
    7: EVENT % ("assistant", '[{"type":"thinking","thinking":"@X"},{"type":"text","text":"  said @N "},{"type":"text","text":" "}]', ',"model":"m@N","usage":{"input_tokens":@N,"output_tokens":2,"cache_read_input_tokens":null,"cache_creation_input_tokens":4}', ""),
    8: EVENT % ("assistant", '[{"type":"tool_use","name":"read","input":{"file_path":"/a/r@N.md"},"id":"c@N"}]', ',"usage":{}', ""),
    9: EVENT % ("assistant", '[{"text":"@X","type":"text"},{"id":"c@N","input":{"command":"run @N @X"},"name":"Bash","type":"tool_use"}]', "", ""),
    10: EVENT % ("assistant", '[{"type":"tool_use","input":{"z":1},"id":"c@N"}]', "", ""), 11: EVENT % ("user", '[{"type":"tool_result","content":"@X"}]', "", ',"toolUseResult":{"toolName":"write"}'),
    12: EVENT % ("user", '[{"type":"tool_result","tool_use_id":"c@N","content":"@X"}]', "", ""), 13: EVENT % ("user", '[{"type":"tool_result","content":[{"type":"text","text":"fine @N"}]}]', "", ""),
    14: EVENT % ("assistant", '"@X"', "", ""), 15: EVENT % ("assistant", '[{"type":"tool_use","name":"Write","input":{"content":"@X","file_path":"/a/w@N.txt"},"id":"c@N"}]', "", ""),
    17: EVENT % ("assistant", '[{"type":"tool_use","name":"grep","input":{"pattern":"@X"},"id":"c@N"}]', "", ""),
}


@query("transcript_normalised", "WITH " + lines_sql(LINES_B) + f" SELECT conv_id::VARCHAR AS session_id, turn::BIGINT AS line_no, {_cases({k: told(v) for k, v in NORMAL.items()}, 'line')} AS content FROM l")
def transcript_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Raw events of format B in the shape of format A; what is no event of B stays as it is."""
    return lines(spark, d, LINES_B).select("session_id", "line_no", normalize.to_format_a(F.col("line")).alias("content"))


def laid_out(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The lines of format A, and a folder where each session's lie in a file.

    Every tenth is a helper's file, named so or so, and every tenth has another ending: these are no sessions.
    """
    rows, folder = lines(spark, d, LINES_A), shared_folder(spark)
    name = F.expr("concat(CASE conv_id % 10 WHEN 7 THEN 'agent-' WHEN 8 THEN 'x-agent-' ELSE '' END, session_id, CASE conv_id % 10 WHEN 9 THEN '.txt' ELSE '.jsonl' END)")
    src.write_files(rows.withColumn("conv_id", F.col("session_id").cast("bigint")).select(name.alias("name"), "line_no", "line"), folder)
    return rows, folder


READ_SQL = "WITH " + lines_sql(LINES_A) + ", r AS (SELECT conv_id::VARCHAR AS session_id, conv_id, turn, turn::BIGINT AS line_no, byte_offset, byte_length::BIGINT AS byte_length, line, c FROM o WHERE conv_id % 10 < 7)"


@query("source_scan", READ_SQL + " SELECT session_id, line_no, byte_offset, byte_length, line FROM r")
def source_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder as lines with byte offsets; only files that are sessions."""
    _, folder = laid_out(spark, d)
    return src.scan(spark, folder).select("session_id", "line_no", "byte_offset", "byte_length", "line")


@query("source_read_bytes", READ_SQL + " SELECT session_id, line_no - 1 AS line_no, byte_offset, byte_length, line FROM r WHERE conv_id = 0 AND turn >= 2")
def source_read_bytes(spark: SparkSession, d: str) -> DataFrame:
    """One file from its third line on; numbers count from 1."""
    rows, folder = laid_out(spark, d)
    at = rows.where("session_id = '0' AND line_no < 2").agg(F.sum("byte_length")).first()[0]
    path = src.files(spark, folder).where(src.session_id(F.col("path")) == "0").select("path").first()[0]
    return src.read_bytes(spark, path, at).select("session_id", "line_no", "byte_offset", "byte_length", "line")


#: State as an earlier visit left it: of four sessions one is unchanged, one has grown since its second line, one was longer, one is unknown.
STATE_SQL = READ_SQL + """, f AS (SELECT conv_id, session_id, sum(byte_length)::BIGINT AS size, coalesce(sum(byte_length) FILTER (WHERE turn < 2), 0)::BIGINT AS two, least(count(*), 2) AS n FROM r GROUP BY 1, 2),
ch AS (SELECT *, CASE WHEN conv_id % 4 = 0 OR (conv_id % 4 = 1 AND size = two) THEN 'skip' WHEN conv_id % 4 = 1 THEN 'tail' ELSE 'full' END AS action FROM f)"""


def _visited(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    rows, folder = laid_out(spark, d)
    sizes = rows.groupBy("session_id").agg(F.sum("byte_length").alias("size"), F.sum(F.when(F.col("line_no") < 2, F.col("byte_length"))).alias("two"), F.least(F.count("*"), F.lit(2)).alias("n"))
    kind = F.col("session_id").cast("int") % 4
    size = F.when(kind == 0, F.col("size")).when(kind == 1, F.col("two")).otherwise(F.col("size") + 10)
    paths = src.files(spark, folder).select("path", src.session_id(F.col("path")).alias("session_id"))
    state = paths.join(sizes, "session_id").where(kind < 3).select("path", size.alias("file_size"), F.col("n").alias("message_count"), (F.col("n") - 1).alias("max_sequence"), F.col("n").alias("next_line"))
    return folder, src.changes(spark, folder, state)


@query("source_changes", STATE_SQL + " SELECT session_id, size AS new_size, action, CASE WHEN conv_id % 4 < 3 THEN n - 1 ELSE -1 END::BIGINT AS max_sequence FROM ch")
def source_changes(spark: SparkSession, d: str) -> DataFrame:
    """What each file needs, by its size and the stored state."""
    _, changed = _visited(spark, d)
    return changed.select(src.session_id(F.col("path")).alias("session_id"), "new_size", "action", "max_sequence")


@query("source_tail", STATE_SQL + " SELECT r.session_id, line_no, byte_offset, byte_length, line, action FROM r JOIN ch USING (conv_id) WHERE action = 'full' OR (action = 'tail' AND turn >= 2)")
def source_tail(spark: SparkSession, d: str) -> DataFrame:
    """The lines that the changes ask for: from the stored offset on, or all after a file became shorter."""
    folder, changed = _visited(spark, d)
    return src.read_changes(spark, folder, changed).select("session_id", "line_no", "byte_offset", "byte_length", "line", "action")


@query("source_content_at", READ_SQL + r""" SELECT session_id, turn::BIGINT AS sequence_num, CASE WHEN c = 25 THEN '{"raw":"' || replace(line, '"', '\"') || '"}' ELSE line END AS content FROM r""")
def source_content_at(spark: SparkSession, d: str) -> DataFrame:
    """Each line's own bytes in its session's file; an archived copy takes precedence; what is no JSON comes wrapped."""
    rows, folder = laid_out(spark, d)
    paths = src.files(spark, folder).select("path", src.session_id(F.col("path")).alias("id"))
    archived = F.col("id").cast("int") % 3 == 0
    sessions = paths.select("id", F.when(archived, F.lit("/nowhere.jsonl")).otherwise(F.col("path")).alias("file_path"), F.when(archived, F.col("path")).alias("archived_file_path"))
    wanted = rows.select("session_id", F.col("line_no").alias("sequence_num"), "byte_offset", "byte_length")
    return src.content_at(spark, wanted, sessions, [folder])


INGESTED_SQL = MESSAGES_A_SQL + f""", g AS (SELECT *, role <> 'system' AND ts_us IS NOT NULL AS timed FROM a),
h AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY session_id, timed ORDER BY ts_us, sequence_num) AS gap FROM g),
k AS (SELECT session_id, count(*) AS message_count, bool_or(has_code) AS has_code, bool_or(has_error) AS has_errors, max(sequence_num) AS max_sequence,
  CASE WHEN count(*) FILTER (WHERE timed) > 1 THEN coalesce(sum(CASE WHEN timed AND gap <= 1800000000 THEN gap // 1000 END), 0)::BIGINT END AS duration_ms,
  min_by(search_content, sequence_num) FILTER (WHERE role = 'user' AND tool_type IS NULL AND sequence_num < first_batch) AS ti FROM h GROUP BY 1),
z AS (SELECT conv_id, conv_id::VARCHAR AS id, sum(strlen(line) + 1)::BIGINT AS file_size, max(turn) + 1 AS next_line, bool_or(turn < 3)::INT + bool_or(turn >= 3)::INT AS events FROM l GROUP BY 1)
SELECT id, coalesce(message_count, 0)::BIGINT AS message_count, coalesce(has_code, false) AS has_code, coalesce(has_errors, false) AS has_errors, duration_ms, coalesce({cut_sql('ti', 80)}, 'Untitled session') AS title,
  'Claude Code' AS ai_tool, file_size, coalesce(max_sequence, -1)::BIGINT AS max_sequence, next_line::BIGINT AS next_line"""


def _stored_sessions(store: Store) -> DataFrame:
    s = store.read("sessions").select("id", "message_count", "has_code", "has_errors", "duration_ms", "title", "ai_tool", "file_size")
    return s.join(store.read("file_state").select(F.col("session_id").alias("id"), "max_sequence", "next_line"), "id")


@query("ingest_batches", INGESTED_SQL.replace("first_batch", "3") + ", events::BIGINT AS n_events, 1::BIGINT AS n_projects FROM z LEFT JOIN k ON k.session_id = z.id")
def ingest_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two batches into a store, the second twice, as after a failure: sessions, file state, events and projects as if once. A title stays as it was first found."""
    store, every = Store(spark, shared_folder(spark), buckets=4), stored(lines(spark, d, LINES_A).withColumn("restarted", F.lit(False)))
    now = F.expr("TIMESTAMP '2024-04-01 00:00:00'")
    for batch_id, part in ((0, "line_no < 3"), (1, "line_no >= 3"), (1, "line_no >= 3")):
        ingest.apply_lines(store, every.where(part), "claude_code", now, batch_id=str(batch_id))
    events = store.read("service_events").groupBy(F.col("session_id").alias("id")).agg(F.count_if(F.col("event").isin("session:new", "session:changed")).alias("n_events"))
    return _stored_sessions(store).join(events, "id").withColumn("n_projects", F.lit(store.read("projects").count()).cast("bigint"))


@query("ingest_stream", INGESTED_SQL.replace("first_batch", "1000") + " FROM z LEFT JOIN k ON k.session_id = z.id WHERE conv_id % 10 < 7")
def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """The folder followed by the streaming source, into a store. Driver and executors see the folder under one path."""
    _, folder = laid_out(spark, d)
    root = shared_folder(spark)
    store = Store(spark, root, buckets=4)
    ingest.watch(spark, re.sub("^file:/*", "/", folder), store, "claude_code", f"{root}/stream", once=True).awaitTermination()
    return _stored_sessions(store)
