"""Strict JSON access: a value of another kind counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(line: Column) -> Column:
    """VARIANT, null where the line is not JSON."""
    return F.try_parse_json(line)


def get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str = "$") -> Column:
    return F.schema_of_variant(get(v, path))


def text(v: Column, path: str = "$") -> Column:
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def whole(v: Column, path: str = "$") -> Column:
    return F.when(kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def flag(v: Column, path: str = "$") -> Column:
    return F.when(kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def present(v: Column, path: str) -> Column:
    """The key is there, be its value null."""
    return get(v, path).isNotNull()


def items(v: Column, path: str = "$") -> Column:
    """The elements of an array, null if it is none."""
    return F.when(kind(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def dump(v: Column) -> Column:
    return F.to_json(v)


def first_of(blocks: Column, *types: str) -> Column:
    """The first block of one of the types."""
    return F.get(F.filter(blocks, lambda b: text(b, "$.type").isin(*types)), 0)


def string_list(raw: Column) -> Column:
    """A JSON list of strings, empty where it does not parse."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
