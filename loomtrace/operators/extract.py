"""What goes into a language model and what is made of its answers. The model is a callable."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import jsons as j
from ..functions.text import cut_bytes, elide, memory_type, token_estimate

Model = Callable[[str], str]

LEAST_MESSAGES = 25
LEAST_SAMPLED = 30
LEAST_CONFIDENCE = 0.70
MARKERS = ("breakthrough", "ship", "decision", "bug", "stuck")


@dataclass(frozen=True)
class Policy:
    """When work starts by itself: a title once, extraction first at a count and then at every step more."""

    title_at: int = 25
    extract_at: int = 10
    extract_step: int = 50

    def wants_title(self) -> Column:
        done = F.coalesce("title_ai_generated", F.lit(False)) | F.coalesce("title_edited", F.lit(False))
        return (F.col("message_count") >= self.title_at) & ~done

    def wants_extraction(self, last: Column) -> Column:
        n, last = F.col("message_count"), F.coalesce(last, F.lit(0))
        return (n >= self.extract_at) & ((last < self.extract_at) | (n - last >= self.extract_step))


def sample(messages: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """User and assistant messages without tools, none that think aloud. ``raw``: session_id, sequence_num, content."""
    talk = messages.where(F.col("role").isin("user", "assistant") & F.col("tool_type").isNull())
    if raw is None:
        return talk
    blocks = j.items(j.parsed(F.col("content")), "$.message.content")
    thinks = raw.where(F.exists(blocks, lambda b: F.coalesce(j.text(b, "$.type") == "thinking", F.lit(False)))).select("session_id", "sequence_num")
    return talk.where("role = 'user'").unionByName(talk.where("role = 'assistant'").join(thinks, ["session_id", "sequence_num"], "left_anti"))


def compact(sampled: DataFrame, content: str = "search_content") -> DataFrame:
    """A JSON object per message: idx, role, time, content with its middle left out."""
    shown = elide(F.col(content), F.col("role"), F.col("has_error"))
    return sampled.withColumn("compact", F.to_json(F.struct(F.col("sequence_num").alias("idx"), "role", F.col("timestamp").alias("time"), shown.alias("content"))))


def chunks(sampled: DataFrame, budget: int = 70_000, size: str = "byte_length") -> DataFrame:
    """sampled with ``chunk``: filled in order up to the budget of estimated tokens, then a new one begins.

    The sum starts over at each chunk, so it runs within a session, over numbers only.
    """
    own = sampled.select("session_id", "sequence_num", token_estimate(F.col(size)).alias("tokens"))

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sequence_num")
        out, chunk, used = [], 0, 0
        for k, n in enumerate(rows["tokens"]):
            if used + n > budget and k and used:
                chunk, used = chunk + 1, 0
            out.append(chunk)
            used += n
        return rows[["session_id", "sequence_num"]].assign(chunk=out)

    kind = dict(sampled.dtypes)
    placed = own.groupBy("session_id").applyInPandas(cut, f"session_id {kind['session_id']}, sequence_num {kind['sequence_num']}, chunk int")
    return sampled.join(placed, ["session_id", "sequence_num"])


def _joined(rows: DataFrame, line: Column, glue: str) -> DataFrame:
    shown = rows.withColumn("line", line).where("line IS NOT NULL")
    return shown.groupBy("session_id").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence_num", "line"))), lambda x: x["line"]), glue).alias("text"))


def memory_transcript(messages: DataFrame, least: int = LEAST_MESSAGES, most: int = 150_000) -> DataFrame:
    """(session_id, text): number and speaker, preview, tool; cut to ``most`` bytes."""
    who = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant")
    tool = F.when(F.col("tool_name").isNotNull(), F.concat(F.lit("\nTool: "), "tool_name")).otherwise("")
    line = F.concat(F.lit("["), F.col("sequence_num").cast("string"), F.lit("] "), who, F.lit("\n"), F.coalesce("content_preview", F.lit("")), tool)
    return _joined(messages, line, "\n\n").where(F.col("n_lines") >= least).select("session_id", cut_bytes(F.col("text"), most, "").alias("text"))


def skill_transcript(messages: DataFrame, least: int = LEAST_MESSAGES, most: int = 100_000) -> DataFrame:
    """(session_id, text): one line per message, arrows for calls and results, long previews cut."""
    who = F.when(F.col("role") == "user", "U").when(F.col("role") == "assistant", "A")
    head = F.concat(F.lit("["), F.col("sequence_num").cast("string"), F.lit("] "), who)
    text = F.coalesce("content_preview", F.lit(""))
    short = lambda n: F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)
    tool, kind = F.col("tool_name"), F.col("tool_type")
    line = (
        F.when(tool.isNotNull() & (kind == "use"), F.concat(head, F.lit(" → "), tool))
        .when(tool.isNotNull() & (kind == "result"), F.concat(head, F.lit(" ← "), tool, F.lit(" "), short(100)))
        .otherwise(F.concat(head, F.lit(": "), short(200)))
    )
    whole = F.when(F.length("text") > most, F.concat(F.left("text", F.lit(most)), F.lit("...\n[Content truncated]"))).otherwise(F.col("text"))
    return _joined(messages, line, "\n").where(F.col("n_lines") >= least).select("session_id", whole.alias("text"))


def title_input(messages: DataFrame, first: int = 10, each: int = 500, most: int = 4000) -> DataFrame:
    """(session_id, text): the first user messages, cut one by one and together at whole characters."""
    order = W.partitionBy("session_id").orderBy("sequence_num")
    own = messages.where((F.col("role") == "user") & F.col("tool_type").isNull()).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first)
    return _joined(own, cut_bytes(F.col("search_content"), each), "\n\n").select("session_id", cut_bytes(F.col("text"), most, "").alias("text"))


def raw_export(messages: DataFrame) -> DataFrame:
    return _joined(messages, F.concat(F.lit("### "), F.initcap("role"), F.lit("\n"), F.coalesce("search_content", F.lit(""))), "\n\n").select("session_id", "text")


#: What a message's heading begins with, and what marks a cut.
HEADING, CUT_MARK = "\n### ", "\n\n[... content truncated for length ...]"


def cut_at_heading(text: str, most: int = 100_000) -> str:
    """At most ``most`` bytes, ending before the last message heading, or else at a line's end."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    head = raw[:most].decode("utf-8", "ignore")
    ends = [at for at in (head.rfind(HEADING), head.rfind("\n")) if at >= 0]
    return head[: ends[0]] + CUT_MARK if ends else head + "..."


def export_prompts(texts: DataFrame, instruction: str, most: int = 100_000) -> DataFrame:
    """texts (session_id, text) with a prompt for one call each, the text cut to size."""

    @F.pandas_udf("string")
    def cut(t: pd.Series) -> pd.Series:
        return t.map(lambda x: cut_at_heading(x or "", most))

    return texts.withColumn("prompt", F.concat(F.lit(instruction + "\n\nSession content:\n"), cut(F.col("text"))))


def command_model(argv: list[str], seconds: float = 120.0, tries: int = 2, envelope: tuple[str, ...] = ("result", "response", "text")) -> Callable[[], Model]:
    """A model that is another program: it reads the prompt and writes the answer.

    A call that takes longer than ``seconds`` is stopped, and made again at most ``tries`` times in all; so is one that fails.
    An answer in a JSON object under one of the names of ``envelope`` is taken out of it.
    """

    def make() -> Model:
        def model(prompt: str) -> str:
            for left in range(tries - 1, -1, -1):
                try:
                    done = subprocess.run(argv, input=prompt, capture_output=True, text=True, timeout=seconds, check=True)
                    break
                except (subprocess.TimeoutExpired, subprocess.CalledProcessError):
                    if not left:
                        raise
            try:
                outer = json.loads(done.stdout)
            except ValueError:
                return done.stdout
            inner = [outer[n] for n in envelope if isinstance(outer, dict) and isinstance(outer.get(n), str)]
            return inner[0] if inner else done.stdout

        return model

    return make


def ask(prompts: DataFrame, make: Callable[[], Model], key: list[str], permits: int = 3) -> DataFrame:
    """(key..., answer, error) for rows with ``prompt``; at most ``permits`` tasks ask at a time, one model each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            answers, errors = [], []
            for p in part["prompt"]:
                try:
                    answers.append(model(p))
                    errors.append(None)
                except Exception as e:  # a failed call is a row, not a failed job
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield part[key].assign(answer=answers, error=errors)

    kinds = dict(prompts.dtypes)
    return prompts.select(*key, "prompt").repartition(permits).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", answer string, error string")


def find_json(answer: str | None, wrapper: str) -> str | None:
    """The JSON list in an answer: bare, fenced, or in an object under ``wrapper``; else within prose."""
    if answer is None:
        return None
    text = answer
    if "```" in text:
        inside, kept = False, []
        for line in text.splitlines():
            if line.startswith("```"):
                if inside:
                    break
                inside = True
            elif inside:
                kept.append(line)
        text = "\n".join(kept)
    for part in (text, text[text.find("[") : text.rfind("]") + 1], text[text.find("{") : text.rfind("}") + 1]):
        try:
            got = json.loads(part)
        except ValueError:
            continue
        if isinstance(got, dict) and wrapper in got:
            got = got[wrapper]
        if isinstance(got, (list, dict)):
            return json.dumps(got)
    return None


def salvage(answer: Column, wrapper: str) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: find_json(x, wrapper))

    return run(answer)


MEMORY_ANSWER = "array<struct<type:string,title:string,content:string,context:string,tags:array<string>,confidence:double,file_reference:string>>"
SKILL_ANSWER = "array<struct<name:string,description:string,steps:array<string>,confidence:double>>"


def memories_of(answers: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Memories in the answers, of known type and enough confidence (0.7 where none is given)."""
    each = answers.select("session_id", F.explode(F.from_json(salvage(F.col("answer"), "memories"), MEMORY_ANSWER)).alias("m"))
    sure = F.coalesce("m.confidence", F.lit(0.7))
    return each.select("session_id", memory_type(F.col("m.type")).alias("memory_type"), "m.title", "m.content", "m.context", F.coalesce("m.tags", F.array().cast("array<string>")).alias("tags"), sure.alias("confidence"), "m.file_reference").where((F.col("confidence") >= least) & F.col("memory_type").isNotNull() & F.col("title").isNotNull() & F.col("content").isNotNull())


def skills_of(answers: DataFrame) -> DataFrame:
    each = answers.select("session_id", F.explode(F.from_json(salvage(F.col("answer"), "skills"), SKILL_ANSWER)).alias("m"))
    return each.select("session_id", "m.name", "m.description", F.coalesce("m.steps", F.array().cast("array<string>")).alias("steps"), F.coalesce("m.confidence", F.lit(0.7)).alias("confidence")).where("name IS NOT NULL AND description IS NOT NULL")


def marker_moments(found: DataFrame) -> DataFrame:
    """First answers (session_id, answer) -> (session_id, event_index, marker_type), each index once per type."""
    kind = "struct<markers:struct<" + ",".join(f"{m}:array<int>" for m in MARKERS) + ">>"
    got = found.select("session_id", F.from_json(salvage(F.col("answer"), ""), kind).alias("g"))
    # One pass over the answers, whatever the number of types: the model is asked once.
    typed = got.select("session_id", F.explode(F.array(*(F.struct(F.lit(m).alias("marker_type"), F.col(f"g.markers.{m}").alias("at")) for m in MARKERS))).alias("x"))
    return typed.select("session_id", F.explode("x.at").alias("event_index"), F.col("x.marker_type").alias("marker_type")).distinct()


def labelled_markers(moments: DataFrame, labels: DataFrame, now: Column) -> DataFrame:
    """Moments with the second answers' labels (session_id, answer); a moment without one is named by its type."""
    got = labels.select("session_id", F.explode(F.from_json(salvage(F.col("answer"), ""), "struct<labels:array<struct<idx:int,label:string,description:string>>>")["labels"]).alias("x"))
    one = got.groupBy("session_id", F.col("x.idx").alias("event_index")).agg(F.first("x.label").alias("label"), F.first("x.description").alias("description"))
    return moments.join(one, ["session_id", "event_index"], "left").select("session_id", "event_index", "marker_type", F.coalesce("label", F.initcap("marker_type")).alias("label"), "description", now.alias("created_at"))


def merge_chunks(parts: DataFrame, make: Callable[[], Model], instruction: str) -> DataFrame:
    """Partial results (session_id, chunk, answer) joined in order and merged by one more call per session."""
    joined = parts.where("answer IS NOT NULL").groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "answer"))), lambda x: x["answer"]), "\n\n---\n\n").alias("text"))
    return ask(joined.withColumn("prompt", F.concat(F.lit(instruction + "\n\n"), "text")), make, ["session_id"])
