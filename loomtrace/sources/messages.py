"""Lines of either transcript format, flattened into messages.

Everything is an expression over a VARIANT but the parent link, one equi-join on
(session_id, id): a tool's result takes name and input from the call it answers.
``stored`` calls from earlier batches may be joined as well, so a link across
batches holds. A line that is no JSON gives no message but an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons as j
from ..functions import text as t

CALLS = "session_id string, id string, call_name string, call_input string, is_call boolean, line_no bigint"
NOTICE = "task-notification"
CHANGING_A = ("Write", "Edit", "NotebookEdit")
CHANGING_B = (*CHANGING_A, "write", "edit")

OUT = (
    "session_id", "sequence_num", "role", "event_type", "content_preview", "search_content", "has_code", "has_error", "has_file_changes", "tool_name", "tool_type", "tool_summary",
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "model", "timestamp", "ts", "byte_offset", "byte_length",
)


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("v", j.parsed(F.col("line"))).where("v IS NOT NULL")


def errors(lines: DataFrame) -> DataFrame:
    """(session_id, line_no, error) for lines that are no JSON."""
    return lines.where(j.parsed(F.col("line")).isNull()).select("session_id", "line_no", F.concat(F.lit("Failed to parse line "), F.col("line_no").cast("string")).alias("error"))


def calls(lines: DataFrame, key: str, types: tuple[str, ...], inputs: tuple[str, ...]) -> DataFrame:
    """Each identified event's first tool call. Of several events of one id the last counts."""
    v = F.col("v")
    call = j.first_of(j.items(v, "$.message.content"), *types)
    given = F.coalesce(*[j.get(F.col("call"), f"$.{n}") for n in inputs])
    found = _parsed(lines).select("session_id", j.text(v, f"$.{key}").alias("id"), "line_no", call.alias("call")).where("id IS NOT NULL")
    rows = found.select("session_id", "id", "line_no", F.struct(j.text(F.col("call"), "$.name").alias("call_name"), j.dump(given).alias("call_input"), F.col("call").isNotNull().alias("is_call")).alias("c"))
    return rows.groupBy("session_id", "id").agg(F.max_by("c", "line_no").alias("c"), F.max("line_no").alias("line_no")).select("session_id", "id", "c.call_name", "c.call_input", "c.is_call", "line_no")


def _joined(lines: DataFrame, own: DataFrame, stored: DataFrame | None, parent: str) -> DataFrame:
    """Lines that are JSON, with the call that they answer."""
    known = own if stored is None else own.unionByName(stored.join(own, ["session_id", "id"], "left_anti"))
    known = known.select("session_id", F.col("id").alias("parent"), "call_name", "call_input", "is_call")
    return _parsed(lines).withColumn("parent", j.text(F.col("v"), f"$.{parent}")).join(known, ["session_id", "parent"], "left")


def _texts(blocks: Column, glue: str) -> Column:
    """The text of text blocks."""
    mine = F.filter(blocks, lambda b: j.text(b, "$.type") == "text")
    return F.array_join(F.filter(F.transform(mine, lambda b: j.text(b, "$.text")), lambda x: x.isNotNull()), glue)


def _thought(b: Column) -> Column:
    """What a thinking block says; the key ``thinking`` counts, if there, even where it holds no text."""
    return F.when(j.present(b, "$.thinking"), j.text(b, "$.thinking")).otherwise(j.text(b, "$.text"))


def _said(blocks: Column, head: str, most: int | None, trimmed: bool) -> Column:
    """Text and thinking blocks, a blank line between."""
    def one(b: Column) -> Column:
        words = j.text(b, "$.text")
        if trimmed:
            words = F.regexp_replace(words, r"(?U)^\s+|\s+$", "")
            words = F.when(words != "", words)
        thought = _thought(b)
        shown = t.cut_bytes(thought, most) if most else thought
        return F.when(j.text(b, "$.type") == "text", words).when((j.text(b, "$.type") == "thinking") & (thought != ""), F.concat(F.lit(head), shown))

    return F.array_join(F.filter(F.transform(blocks, one), lambda x: x.isNotNull()), "\n\n")


def any_content(content: Column) -> Column:
    """A string as it is; blocks as `_said` joins them; anything else as JSON."""
    blocks = j.items(content)
    return F.when(j.kind(content) == "STRING", j.text(content)).when(blocks.isNotNull(), _said(blocks, "Thinking...\n\n", None, False)).otherwise(j.dump(content))


#: What is told of a call's input.
ARGUMENTS = ("command", "file_path", "pattern", "description", "content")


def _args(given: Column) -> dict[str, Column]:
    """Columns of their own, as what is made of them names each several times."""
    return {f"arg_{n}": j.text(given, f"$.{n}") for n in ARGUMENTS}


#: Tool -> (argument that tells most, bytes it is cut to, text before it, text where it is missing); before other tools' names.
SUMMARIES = {
    "Bash": ("command", 50, "", "Bash command"),
    "Write": ("file_path", None, "Write ", "Writing file"),
    "Edit": ("file_path", None, "Edit ", "Editing file"),
    "Read": ("file_path", None, "Read ", "Reading file"),
    "Grep": ("pattern", 30, "Search: ", "Grep search"),
    "Glob": ("pattern", None, "Files: ", "File glob"),
    "Task": ("description", 50, "", "Task agent"),
}
OTHER_TOOL = "Used "


def summary(tool: Column, tenses: dict[str, tuple[str, str]], done: Column, either_case: bool) -> Column:
    """One line for a tool call, of the columns of `_args`. tenses: tool -> (before the file's name, for a call; the same for a result)."""
    line = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, (argument, most, before, missing) in SUMMARIES.items():
        value = F.col(f"arg_{argument}")
        value = t.basename(value) if argument == "file_path" else t.cut_bytes(value, most) if most else value
        shown = F.concat(F.lit(before), value)
        if name in tenses:
            doing, did = tenses[name]
            shown = F.when(done, F.concat(F.lit(did), value)).otherwise(F.concat(F.lit(doing), value, F.lit("...")))
        line = line.when(tool.isin(name, name.lower()) if either_case else tool == name, F.coalesce(shown, F.lit(missing)))
    return line.otherwise(F.concat(F.lit(OTHER_TOOL), tool))


#: Wording for calls under way and for calls done.
TENSES_A = {"Write": ("Writing to ", "File created successfully at: "), "Edit": ("Editing ", "Successfully edited ")}


def _finish(rows: DataFrame) -> DataFrame:
    """rows with all but the derived columns of a message."""
    none = lambda kind: F.lit(None).cast(kind)
    have = set(rows.columns)
    for name, kind in (("event_type", "string"), ("tool_name", "string"), ("tool_type", "string"), ("tool_summary", "string"), ("input_tokens", "bigint"), ("output_tokens", "bigint"), ("cache_read_tokens", "bigint"), ("cache_creation_tokens", "bigint"), ("model", "string")):
        if name not in have:
            rows = rows.withColumn(name, none(kind))
    return rows.withColumn("sequence_num", F.col("line_no")).withColumn("ts", F.try_to_timestamp("timestamp")).select(*OUT)


def format_a(lines: DataFrame, stored: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """Format A: events of type user, assistant, system and file-history-snapshot."""
    v, content = F.col("v"), j.get(F.col("v"), "$.message.content")
    blocks = F.col("blocks")
    base = _joined(lines, A.calls(lines) if own is None else own, stored, "parentUuid").withColumn("blocks", j.items(content))
    own = F.coalesce(j.text(v, "$.content"), F.lit(""))
    base = (
        base.withColumn("type", j.text(v, "$.type")).where(F.col("type").isin("user", "assistant", "system", "file-history-snapshot"))
        .withColumn("timestamp", F.coalesce(j.text(v, "$.timestamp"), F.lit("")))
        .withColumn("asked", F.when(blocks.isNotNull(), _texts(blocks, "\n")).otherwise(F.coalesce(j.text(content), own)))
        .withColumn("told", F.when(blocks.isNotNull(), _said(blocks, "Thinking...\n\n", None, False)).otherwise(F.coalesce(j.text(content), own)))
        .withColumn("result", j.first_of(blocks, "tool_result")).withColumn("call", j.first_of(blocks, "tool_use"))
    )
    user = F.col("type") == "user"
    case = (
        F.when(user & F.coalesce(j.flag(v, "$.isMeta"), F.lit(False)), "meta")
        .when(user & F.contains("asked", F.lit(f"<{NOTICE}>")), "notice").when(user & F.col("result").isNotNull(), "result").when(user, "ask")
        .when((F.col("type") == "assistant") & F.col("call").isNotNull(), "call").when(F.col("type") == "assistant", "answer")
        .when(F.col("type") == "system", "system").otherwise("snapshot")
    )
    base = base.withColumn("case", case)
    is_ = lambda *names: F.col("case").isin(*names)

    back = j.get(F.col("result"), "$.content")
    listed = j.items(back)
    returned = F.coalesce(F.when(j.kind(back) == "STRING", j.text(back)).when(listed.isNotNull(), _texts(listed, "\n")).otherwise(j.dump(back)), F.lit(""))
    inside = F.regexp_extract("asked", f"(?s)<{NOTICE}>(.*?)</{NOTICE}>", 1)
    closed = F.col("asked").rlike(f"(?s)<{NOTICE}>.*?</{NOTICE}>")
    notice = F.when(closed, F.regexp_replace(inside, r"(?U)^\s+|\s+$", "")).otherwise(F.col("asked"))
    guessed = (
        F.when(j.present(v, "$.toolUseResult.file.filePath"), "Read").when(j.present(v, "$.toolUseResult.exitCode"), "Bash")
        .when(j.present(v, "$.toolUseResult.success") | j.present(v, "$.toolUseResult.error"), "Write")
    )
    tool = F.when(is_("result"), F.coalesce("call_name", guessed)).when(is_("call"), j.text(F.col("call"), "$.name"))
    given = F.when(is_("result"), j.parsed(F.col("call_input"))).when(is_("call"), j.get(F.col("call"), "$.input"))
    base = base.withColumn("tool", tool).withColumn("given", given).withColumns(_args(F.col("given")))
    line = F.when(is_("result", "call"), summary(F.coalesce("tool", F.lit("Tool")), TENSES_A, is_("result"), False))
    content_of = (
        F.when(is_("meta", "ask"), F.col("asked")).when(is_("notice"), notice).when(is_("result"), returned).when(is_("answer"), F.col("told"))
        .when(is_("call"), F.concat(F.col("told"), F.lit(" "), j.dump(F.col("call")))).when(is_("system"), F.coalesce(j.text(v, "$.content"), j.dump(v))).otherwise("file history snapshot")
    )
    # Previews are cut out of a column of its own: the expression would be worked out anew at each place that names it.
    told = F.when(is_("call"), F.when(F.col("told") != "", F.col("told"))).when(~is_("snapshot"), F.col("search_content"))
    base = base.withColumn("search_content", content_of).withColumn("line_of", line).withColumn("plain", t.plain(told))
    name, path = F.coalesce("tool", F.lit("Tool")), F.col("arg_file_path")
    snippet = F.translate(F.left("arg_content", F.lit(150)), "\n", " ")
    shown = (
        F.when(name == "Bash", F.concat(F.lit("$ "), F.col("arg_command")))
        .when(name == "Write", F.coalesce(F.concat(F.lit("Write "), t.basename(path), F.lit(": "), snippet, F.lit("...")), F.concat(F.lit("Write "), t.basename(path))))
        .when(name == "Read", F.concat(F.lit("Read "), path))
    )
    preview = F.when(is_("snapshot"), "File history snapshot").when(is_("call") & (F.col("told") == ""), F.coalesce(shown, F.col("line_of"))).otherwise(t.cut_bytes(F.col("plain"), 200))
    tokens = lambda n: F.when(is_("answer", "call"), j.whole(v, f"$.message.usage.{n}"))
    rows = base.withColumns({
        "role": F.when(is_("result", "ask"), "user").when(is_("call", "answer"), "assistant").otherwise("system"),
        "event_type": F.when(is_("result"), "tool_result").when(is_("call"), "tool_use"),
        "content_preview": preview,
        "has_code": F.when(is_("result", "ask", "answer"), t.has_code(F.col("search_content"))).otherwise(False),
        "has_error": F.when(is_("result"), t.has_error(F.col("search_content"))).otherwise(False),
        "has_file_changes": is_("snapshot") | (is_("result") & F.coalesce(F.col("call_name").isin(*CHANGING_A), F.lit(False))),
        "tool_name": F.when(is_("meta"), "skill-prompt").when(is_("notice"), NOTICE).when(is_("snapshot"), "file-history-snapshot").otherwise(F.col("tool")),
        "tool_type": F.when(is_("result"), "result").when(is_("call"), "use"),
        "tool_summary": F.col("line_of"),
        "input_tokens": tokens("input_tokens"), "output_tokens": tokens("output_tokens"),
        "cache_read_tokens": tokens("cache_read_input_tokens"), "cache_creation_tokens": tokens("cache_creation_input_tokens"),
        "model": F.when(is_("answer", "call"), j.text(v, "$.message.model")),
    })
    return _finish(rows)


def format_b(lines: DataFrame, stored: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """Format B: messages by role, and the start of the session."""
    v, content = F.col("v"), j.get(F.col("v"), "$.message.content")
    types = ("toolCall", "tool_use")
    base = _joined(lines, B.calls(lines) if own is None else own, stored, "parentId").withColumn("blocks", j.items(content))
    role = j.text(v, "$.message.role")
    case = (
        F.when(j.text(v, "$.type") == "session", "session").when(j.text(v, "$.type") != "message", None)
        .when(role == "user", "ask").when(role == "toolResult", "result")
        .when((role == "assistant") & j.first_of(F.col("blocks"), *types).isNotNull(), "call").when(role == "assistant", "answer")
    )
    base = base.withColumn("case", case).where("case IS NOT NULL")
    base = (
        base.withColumn("timestamp", F.coalesce(j.text(v, "$.timestamp"), F.lit("")))
        .withColumn("call", j.first_of(F.col("blocks"), *types))
        .withColumn("told", F.when(F.col("blocks").isNotNull(), _said(F.col("blocks"), "Thinking: ", 200, True)).otherwise(F.coalesce(j.text(content), F.lit(""))))
    )
    is_ = lambda *names: F.col("case").isin(*names)
    tool = F.when(is_("result"), F.coalesce(j.text(v, "$.message.toolName"), F.col("call_name"), F.lit("tool"))).when(is_("call"), F.coalesce(j.text(F.col("call"), "$.name"), F.lit("tool")))
    given = F.when(is_("result"), j.parsed(F.col("call_input"))).when(is_("call"), F.coalesce(j.get(F.col("call"), "$.arguments"), j.get(F.col("call"), "$.input")))
    started = F.concat(F.lit("Session started: "), F.coalesce(j.text(v, "$.id"), F.lit("")), F.lit(" (cwd: "), F.coalesce(j.text(v, "$.cwd"), F.lit("")), F.lit(")"))
    anything = F.coalesce(any_content(content), F.lit(""))
    content_of = (
        F.when(is_("session"), started).when(is_("ask"), t.without_time_prefix(anything)).when(is_("result"), anything)
        .when(is_("call"), F.concat(F.col("told"), F.lit(" "), j.dump(F.col("call")))).otherwise(F.col("told"))
    )
    base = base.withColumn("tool", tool).withColumn("given", given).withColumn("search_content", content_of).withColumns(_args(F.col("given")))
    told = F.when(is_("call"), F.when(F.col("told") != "", F.col("told"))).otherwise(F.col("search_content"))
    base = base.withColumn("line_of", F.when(is_("result", "call"), summary(F.col("tool"), {}, F.lit(False), True))).withColumn("plain", t.plain(told))

    def tokens(new: str, old: str) -> Column:
        here = F.when(j.present(v, f"$.message.usage.{new}"), j.whole(v, f"$.message.usage.{new}")).otherwise(j.whole(v, f"$.message.usage.{old}"))
        return F.when(is_("answer", "call"), here)

    failed = F.coalesce(j.flag(v, "$.message.isError"), F.lit(False))
    rows = base.withColumns({
        "role": F.when(is_("session"), "system").when(is_("ask", "result"), "user").otherwise("assistant"),
        "event_type": F.when(is_("result"), "tool_result").when(is_("call"), "tool_use"),
        "content_preview": F.when(is_("call") & (F.col("told") == ""), F.col("line_of")).otherwise(t.cut_bytes(F.col("plain"), 200)),
        "has_code": F.when(is_("ask", "answer", "result"), t.has_code(F.col("search_content"))).otherwise(False),
        "has_error": F.when(is_("result"), t.has_error(F.col("search_content")) | failed).otherwise(False),
        "has_file_changes": F.when(is_("result"), F.col("tool").isin(*CHANGING_B)).otherwise(False),
        "tool_name": F.col("tool"),
        "tool_type": F.when(is_("result"), "result").when(is_("call"), "use"),
        "tool_summary": F.col("line_of"),
        "input_tokens": tokens("input", "input_tokens"), "output_tokens": tokens("output", "output_tokens"),
        "cache_read_tokens": tokens("cacheRead", "cache_read_input_tokens"), "cache_creation_tokens": tokens("cacheWrite", "cache_creation_input_tokens"),
        "model": F.when(is_("answer", "call"), j.text(v, "$.message.model")),
    })
    return _finish(rows)


@dataclass(frozen=True)
class Format:
    """A transcript format: lines -> messages, and lines -> the calls that later batches may need.

    ``parse(lines, stored, own)``: calls of earlier batches, and, where they are at hand, the lines' own.
    """

    name: str
    parse: Callable[..., DataFrame]
    calls: Callable[[DataFrame], DataFrame]


A = Format("claude_code", format_a, lambda lines: calls(lines, "uuid", ("tool_use",), ("input",)))
B = Format("openclaw", format_b, lambda lines: calls(lines, "id", ("toolCall", "tool_use"), ("arguments", "input")))

#: Tool names as watched folders give them. New formats are added by `register`.
FORMATS: dict[str, Format] = {"claude_code": A, "claude-code": A, "openclaw": B}


def register(fmt: Format, *names: str) -> None:
    for name in names or (fmt.name,):
        FORMATS[name] = fmt


def of_tool(name: str) -> Format | None:
    return FORMATS.get(name)
