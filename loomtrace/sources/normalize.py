"""Raw events of format B in the shape of format A, for readers that know only that."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Usage keys of format B -> format A.
USAGE = {"input": "input_tokens", "output": "output_tokens", "cacheRead": "cache_read_input_tokens", "cacheWrite": "cache_creation_input_tokens"}
#: Event keys of format B -> format A.
LINKS = {"id": "uuid", "parentId": "parentUuid", "timestamp": "timestamp"}


def _renamed(source: dict, names: dict[str, str]) -> dict:
    return {new: source[old] for old, new in names.items() if old in source}


def _unstamped(text: str) -> str:
    """Without a bracketed time at its start."""
    if not text.startswith("[") or "] " not in text:
        return text
    inside, rest = text[1:].split("] ", 1)
    return rest if "UTC" in inside or ("20" in inside and len(inside.encode()) < 30) else text


def _block(role: str, b):
    if not isinstance(b, dict):
        return b
    if role == "user" and b.get("type") == "text" and isinstance(b.get("text"), str):
        return b | {"text": _unstamped(b["text"])}
    if role == "assistant" and b.get("type") == "toolCall":
        call = {"type": "tool_use"}
        for new, olds in {"name": ("name", "toolName"), "input": ("arguments",), "id": ("id", "toolCallId")}.items():
            call |= next(({new: b[o]} for o in olds if o in b), {})
        return call
    return b


def event_to_a(event):
    if not isinstance(event, dict):
        return event
    if event.get("type") == "session":
        return {"type": "system"} | _renamed(event, {"timestamp": "timestamp"}) | {"content": json.dumps(event, separators=(",", ":"), ensure_ascii=False, sort_keys=True)}
    message = event.get("message")
    if event.get("type") != "message" or not isinstance(message, dict) or message.get("role") not in ("user", "assistant", "toolResult"):
        return event
    role, out = message["role"], _renamed(event, LINKS)
    if role == "toolResult":
        result = {"type": "tool_result"} | _renamed(message, {"toolCallId": "tool_use_id", "content": "content"})
        out |= {"type": "user", "message": {"content": [result]}}
        return out | ({"toolUseResult": {"toolName": message["toolName"]}} if "toolName" in message else {})
    inner = {}
    if "content" in message:
        c = message["content"]
        inner["content"] = [_block(role, b) for b in c] if isinstance(c, list) else c
    if role == "assistant":
        inner |= _renamed(message, {"model": "model"})
        if isinstance(message.get("usage"), dict):
            inner["usage"] = _renamed(message["usage"], USAGE)
    return out | {"type": role, "message": inner}


def to_format_a(raw: Column) -> Column:
    """JSON text in, JSON text out; what is no event of format B stays as it is."""

    @F.pandas_udf("string")
    def run(lines: pd.Series) -> pd.Series:
        def one(line: str | None) -> str | None:
            try:
                event = json.loads(line) if line is not None else None
            except ValueError:
                return line
            got = event_to_a(event)
            return line if got is event else json.dumps(got, separators=(",", ":"), ensure_ascii=False)

        return lines.map(one)

    return run(raw)
