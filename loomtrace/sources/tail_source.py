"""A streaming source for files that grow: rows are complete lines, the offset is the size by file.

Spark's own file stream reads a file once. Here every micro-batch takes, of each
file, the lines that were ended since the last one; a file that has become shorter
is read again from its start, its rows marked ``restarted``. The driver looks at
names and sizes only; bytes are read in the tasks, small files many to a task. A line that is not ended yet waits: the task that sees its end goes back to
where it began. Lines are numbered from the file's start; a worker remembers how
far it had counted a file, one that has not met it before counts from the start.

Driver and executors must see the folder under the same path. For other stores
use ``lines.changes``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .lines import NOT_A_SESSION, cut_lines

CHUNK = 4 << 20
#: New bytes and files after which the next task begins; a file is never shared between tasks.
TASK_BYTES, TASK_FILES = 16 << 20, 256
#: In a worker: (path, how often it became shorter) -> a line's beginning and its number.
_COUNTED: dict[tuple[str, int], tuple[int, int]] = {}

SCHEMA = "session_id string, path string, line_no bigint, byte_offset bigint, byte_length bigint, line string, restarted boolean"


class Piece:
    def __init__(self, path: str, start: int, stop: int, turns: int, restarted: bool):
        self.path, self.start, self.stop, self.turns, self.restarted = path, start, stop, turns, restarted


class Pieces(InputPartition):
    """What one task reads."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


def line_before(f: BinaryIO, start: int, known: tuple[int, int] = (0, 0)) -> tuple[int, int]:
    """Where the line that holds the byte at ``start`` begins, and its number. ``known``: the same of a place before."""
    begin, number = known if known[0] <= start else (0, 0)
    f.seek(begin)
    at = begin
    while at < start and (part := f.read(min(CHUNK, start - at))):
        if ends := part.count(b"\n"):
            begin, number = at + part.rfind(b"\n") + 1, number + ends
        at += len(part)
    return begin, number


class TailReader(DataSourceStreamReader):
    """Offsets: path -> [size, how often it became shorter]."""

    def __init__(self, folder: str):
        self.folder = os.path.expanduser(folder)
        self.last: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def _sizes(self) -> Iterator[tuple[str, int]]:
        folders = [self.folder]
        while folders:
            with os.scandir(folders.pop()) as found:
                for entry in found:
                    if entry.is_dir():
                        folders.append(entry.path)
                    elif entry.name.endswith(".jsonl") and not re.search(NOT_A_SESSION, entry.name):
                        yield entry.path, entry.stat().st_size

    def latestOffset(self) -> dict:
        now = {}
        for path, size in self._sizes():
            was, turns = self.last.get(path, [0, 0])
            now[path] = [size, turns + (size < was)]
        self.last = now
        return {p: json.dumps(v) for p, v in sorted(now.items())}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        out, size = [], 0
        for path, to in end.items():
            stop, turns = json.loads(to)
            was, before = json.loads(start[path]) if path in start else (0, 0)
            begin = 0 if turns != before else was
            if stop > begin:
                if not out or size >= TASK_BYTES or len(out[-1].pieces) >= TASK_FILES:
                    out.append(Pieces([]))
                    size = 0
                out[-1].pieces.append(Piece(path, begin, stop, turns, turns != before))
                size += stop - begin
            self.last.setdefault(path, [stop, turns])
        return out

    def read(self, task: Pieces) -> Iterator[tuple]:
        for piece in task.pieces:
            yield from self._lines(piece)

    def _lines(self, piece: Piece) -> Iterator[tuple]:
        key = (piece.path, piece.turns)
        with open(piece.path, "rb") as f:
            begin, number = line_before(f, piece.start, _COUNTED.get(key, (0, 0)))
            f.seek(begin)
            content = f.read(piece.stop - begin)
        name = os.path.basename(piece.path).removesuffix(".jsonl")
        done = (begin, number)
        for line_no, offset, length, line in cut_lines(content, 0, number):
            yield name, piece.path, line_no, begin + offset, length, line, piece.restarted
            done = (begin + offset + length, line_no + 1)
        _COUNTED[key] = done


class TailSource(DataSource):
    """``spark.readStream.format("jsonl_tail").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])
