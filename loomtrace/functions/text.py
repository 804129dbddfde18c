"""Text expressions: detection, truncation, previews, titles, paths."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as code and as an error in a message.
CODE = r"```|`[^`]+`|function |class |const |let |var |import |export "
ERROR = r"(?i)error|exception|failed|cannot|undefined|null is not"
#: Names of folders that temporary projects get.
TEMP_FOLDER = r"(?i)^-$|^-(private-var-folders-|var-folders-|tmp-|private-tmp-).*|^-tmp$"
#: Bracketed weekday and time before a message.
TIME_PREFIX = r"^\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) \d{4}-\d{2}-\d{2} \d{2}:\d{2} \w+\] "
#: Tool -> display name.
TOOLS = {"claude_code": "Claude Code", "openclaw": "OpenClaw", "cursor": "Cursor"}
#: Names of memory types, with the older names still accepted.
MEMORY_TYPES = {
    "decision": "decision", "fact": "fact", "preference": "preference", "context": "context", "task": "task",
    "pattern": "fact", "architecture": "fact", "bug": "fact", "spec": "context",
}


def has_code(text: Column) -> Column:
    return F.coalesce(text.rlike(CODE), F.lit(False))


def has_error(text: Column) -> Column:
    return F.coalesce(text.rlike(ERROR), F.lit(False))


def cut_bytes(text: Column, n: int, mark: str = "...") -> Column:
    """Unchanged up to ``n`` bytes; else the longest run of whole characters within ``n`` bytes, and ``mark``."""
    raw = F.encode(text, "UTF-8")
    # A byte 10xxxxxx continues a character; at most three of them follow its first.
    inside = lambda i: F.hex(F.substring(raw, i, 1)).between("80", "BF")
    back = F.lit(0)
    for steps in (3, 2, 1):
        if n + 2 - steps >= 1:
            back = F.when(inside(n + 2 - steps), F.lit(1) + back).otherwise(F.lit(0))
    kept = F.decode(raw.substr(F.lit(1), F.lit(n) - back), "UTF-8")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(kept, F.lit(mark)))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain(text: Column) -> Column:
    """Escape bytes and line-number prefixes dropped, white space collapsed."""
    lines = F.split(F.translate(text, "\x1b", ""), "\n")
    return squeeze(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s*\d+→", "")), " "))


def preview(text: Column, n: int = 200) -> Column:
    """`plain`, cut to ``n`` bytes. `cut_bytes` names its text several times: of many rows make `plain` a column first."""
    return cut_bytes(plain(text), n)


def elide(text: Column, role: Column, error: Column) -> Column:
    """Head and tail of a long message, by role; the threshold is in bytes, the halves in characters."""
    most = F.when(error, 800).when(role == "user", 300).otherwise(400)
    half = F.floor(most / 2).cast("int")
    head, tail = F.left(text, half), F.right(text, half)
    left_out = F.octet_length(text) - F.octet_length(head) - F.octet_length(tail)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(head, F.lit("...["), left_out.cast("string"), F.lit(" chars omitted]..."), tail))


def token_estimate(n_bytes: Column, cap: int = 300) -> Column:
    return F.least(F.floor((n_bytes + 100) / 3), F.lit(cap)).cast("bigint")


def target_markers(n: Column) -> Column:
    return F.least(F.greatest(F.floor(n / 40), F.lit(5)), F.lit(20)).cast("int")


def clean_title(raw: Column, most: int = 60) -> Column:
    """Quotes and leading marks off; a long title is cut at a word boundary."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), r'^"+|"+$', ""), r"^'+|'+$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^#+", ""), r"(?U)^\s+|\s+$", "")
    head = cut_bytes(plain, most - 3, "")
    whole_words = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.octet_length(plain) > most, F.concat(whole_words, F.lit("..."))).otherwise(plain)


def memory_type(name: Column) -> Column:
    """One of five types; older names are mapped, unknown ones null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in MEMORY_TYPES.items() for x in pair]), F.lower(F.trim(name)))


def tool_display(tool: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TOOLS.items() for x in pair]), tool), tool)


def is_temp_folder(folder: Column) -> Column:
    return folder.rlike(TEMP_FOLDER)


def dash_folder(path: Column) -> Column:
    """The folder name under which a project's transcripts lie: its path with dashes for separators."""
    return F.translate(path, "/", "-")


def project_name(folder: Column) -> Column:
    return F.element_at(F.split(folder, "-"), -1)


def project_name_on_disk(folder: str, is_dir: Callable[[str], bool] = os.path.isdir) -> str:
    """What follows the longest path that is there, where dashes may stand for separators; else the last part.

    Asks the disk, so it is for the machine that holds the projects; `project_name` needs none.
    """
    if not folder.startswith("-"):
        return folder
    parts = folder[1:].split("-")
    if is_dir("/" + "/".join(parts)):
        return parts[-1]
    there = (n for n in range(len(parts) - 1, 0, -1) if is_dir("/" + "/".join(parts[:n])))
    rest = next(("-".join(parts[n:]) for n in there if any(parts[n:])), "")
    return rest or parts[-1] or folder


def looks_like_uuid(text: Column) -> Column:
    return (F.length(text) == 36) & (F.substring(text, 9, 1) == "-") & (F.substring(text, 14, 1) == "-")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_time_prefix(text: Column) -> Column:
    return F.regexp_replace(text, TIME_PREFIX, "")


def like_prefix(path: Column, folder: Column) -> Column:
    """``path`` begins with ``folder``, letters of either case alike (ASCII)."""
    return F.lower(path).startswith(F.lower(folder))
