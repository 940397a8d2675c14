"""Typed readers: nothing is inferred, bad rows fail the read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated rows with a header, quotes doubled, cells over several lines."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("mode", "FAILFAST").schema(schema).json(path)


def strict_json(text: str, known: set[str]) -> dict:
    """A mapping without repeated or unknown keys."""

    def once(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key stands twice")
        return out

    out = json.loads(text, object_pairs_hook=once)
    if not isinstance(out, dict) or set(out) - known:
        raise ValueError(f"unknown keys: {sorted(set(out) - known) if isinstance(out, dict) else 'no mapping'}")
    return out
