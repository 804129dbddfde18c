"""Registered queries of the core engine and their SQL twins."""

from . import activity, extraction, knowledge, retrieval, service, transcripts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
