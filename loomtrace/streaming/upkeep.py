"""What is watched, and what is done from time to time: by `keep_up`, or by a scheduler outside that calls `run`."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass
from threading import Event, Timer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..api import Engine
from ..sources.messages import of_tool
from . import ingest


@dataclass(frozen=True)
class Watched:
    """A folder and the tool whose transcripts lie in it."""

    path: str
    tool: str
    enabled: bool = True

    @property
    def folder(self) -> str:
        return os.path.expanduser(self.path)


#: Where tools keep their transcripts, unless told otherwise.
DEFAULT_FOLDERS = [Watched("~/.claude/projects", "claude_code")]


def usable(folders: list[Watched]) -> list[Watched]:
    """Those enabled, of a known format."""
    return [w for w in folders if w.enabled and of_tool(w.tool)]


def watch_all(spark: SparkSession, folders: list[Watched], engine: Engine, checkpoints: str, seconds: float = 0.2) -> list[StreamingQuery]:
    """A stream for each folder."""
    return [ingest.watch(spark, w.folder, engine.store, w.tool, f"{checkpoints}/{i}", seconds) for i, w in enumerate(usable(folders))]


#: Job -> hours between runs; job -> seconds that a run may take; seconds between the first runs of two jobs.
EVERY_HOURS = {"ranking": 6, "embedding_refresh": 12, "duplicate_cleanup": 24, "skill_cleanup": 24}
MOST_SECONDS = {"ranking": 60, "duplicate_cleanup": 120, "embedding_refresh": 300, "skill_cleanup": 120}
STAGGER = 10
#: What is told of a job's run.
STARTED, ENDED, FAILED = "scheduler:start", "scheduler:complete", "scheduler:error"


def run(engine: Engine, job: str) -> DataFrame | None:
    """One run of a job over all projects."""
    jobs = {"ranking": engine.rank, "embedding_refresh": engine.embed_missing, "duplicate_cleanup": engine.clean_memories, "skill_cleanup": engine.clean_skills}
    return jobs[job]()


def told(engine: Engine, event: str, payload: dict) -> None:
    """An event for whoever follows the service."""
    row = engine.spark.createDataFrame([(event, json.dumps(payload))], "event string, payload string").withColumn("at", engine.now)
    engine.store.append("service_events", row)


def run_told(engine: Engine, job: str) -> bool:
    """A run with its events; one that takes too long is cancelled, and a failure is told, not raised."""
    began = time.monotonic()
    told(engine, STARTED, {"job": job})
    late = _Deadline(engine.spark, f"upkeep-{job}", MOST_SECONDS[job])
    try:
        with late:
            run(engine, job)
    except Exception as e:
        told(engine, FAILED, {"job": job, "error": "took too long" if late.passed else f"{type(e).__name__}: {e}"[:500]})
        return False
    told(engine, ENDED, {"job": job, "seconds": round(time.monotonic() - began, 3)})
    return True


class _Deadline:
    """Cancels this thread's Spark jobs once the time is up."""

    def __init__(self, spark: SparkSession, group: str, seconds: float):
        self.context, self.group, self.seconds, self.passed = spark.sparkContext, group, seconds, False

    def _up(self) -> None:
        self.passed = True
        self.context.cancelJobGroup(self.group)

    def __enter__(self) -> None:
        self.context.setJobGroup(self.group, self.group, interruptOnCancel=True)
        self.timer = Timer(self.seconds, self._up)
        self.timer.daemon = True
        self.timer.start()

    def __exit__(self, *_) -> None:
        self.timer.cancel()
        self.context.setLocalProperty("spark.jobGroup.id", None)


def due(last: dict[str, float], now: float, began: float = 0.0) -> list[str]:
    """Jobs whose hours have passed since their last run; first runs come one after another."""
    first = {job: began + STAGGER * i for i, job in enumerate(EVERY_HOURS)}
    return [job for job, hours in EVERY_HOURS.items() if now >= (last[job] + hours * 3600 if job in last else first[job])]


def keep_up(engine: Engine, stop: Event, clock: Callable[[], float] = time.time, pause: float = 5.0) -> None:
    """Run what is due until ``stop`` is set."""
    last: dict[str, float] = {}
    began = clock()
    while not stop.is_set():
        for job in due(last, clock(), began):
            run_told(engine, job)
            last[job] = clock()
        stop.wait(pause)
