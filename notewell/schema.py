"""Schemas, note types and parameter ranges."""

from __future__ import annotations

from pyspark.sql import types as T

# The note types in the order of report sections, and the sections' titles.
TYPES = ["convention", "bug_fix", "reviewer_pattern", "decision", "issue", "general"]
TITLES = {
    "convention": "Conventions",
    "bug_fix": "Bug Fixes",
    "reviewer_pattern": "Reviewer Patterns",
    "decision": "Decisions",
    "issue": "Issues",
    "general": "General",
}

MEMORIES = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("repo", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("updated_at", T.LongType()),
    T.StructField("pinned", T.IntegerType()),
    T.StructField("metadata_json", T.StringType()),
    T.StructField("note_normalized", T.StringType()),
])
PROJECTION = ["row_id", "id", "repo", "type", "note", "tags", "created_at", "updated_at", "pinned"]

ALIASES = T.StructType([
    T.StructField("alias", T.StringType()),
    T.StructField("canonical", T.StringType()),
    T.StructField("created_at", T.LongType()),
])

VECTORS = T.StructType([
    T.StructField("memory_rowid", T.LongType()),
    T.StructField("dim", T.IntegerType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("updated_at", T.LongType()),
])

BUILT_IN_DIM, BUILT_IN_VERSION, EXTERNAL_VERSION = 256, 1, 1000


def in_range(name: str, value, low, high):
    """value, if it lies between low and high."""
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")
    return value


def valid_type(kind: str) -> str:
    if kind not in TYPES:
        raise ValueError(f"{kind!r} is none of {', '.join(TYPES)}")
    return kind
