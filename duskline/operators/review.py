"""Filters over results and their review: kinds, categories, substrings, states; what is shown to whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.generalize import csv_safe

#: The columns that leave the package: no raw path, no surface.
PUBLIC = ("clean", "is_dir", "depth", "hidden", "size_label", "n_findings", "categories")


def filter_results(rows: DataFrame, kind: str | None = None, categories: list[str] | None = None, query: str | None = None) -> DataFrame:
    """rows (relpath, is_dir, signals array<struct<category, surface>>) of a kind, with any of the categories, whose
    path or a surface holds the query, letter case aside."""
    out = rows
    if kind:
        out = out.filter(F.col("is_dir") == F.lit(kind == "dir"))
    if categories:
        out = out.filter(F.exists("signals", lambda s: s["category"].isin(*categories)))
    if query:
        q = query.lower()
        out = out.filter(F.contains(F.lower("relpath"), F.lit(q)) | F.exists("signals", lambda s: F.contains(F.lower(s["surface"]), F.lit(q))))
    return out


def with_state(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows (row_id) with their state, pending unless decided."""
    return rows.join(decided.select("row_id", F.col("state").alias("_s")), "row_id", "left").withColumn("state", F.coalesce("_s", F.lit("pending"))).drop("_s")


def public(df: DataFrame) -> DataFrame:
    """Only what may be shown: a column that is not on the list cannot slip through."""
    return df.select(*[c for c in PUBLIC if c in df.columns])


def review_export(rows: DataFrame) -> DataFrame:
    """Rows as text cells that no spreadsheet runs, categories in order."""
    cats = F.array_join(F.array_sort(F.array_distinct(F.transform("signals", lambda s: s["category"]))), ";")
    return rows.select(csv_safe(F.col("relpath")).alias("path"), F.when(F.col("is_dir"), "dir").otherwise("file").alias("type"), cats.alias("categories"), F.coalesce("state", F.lit("pending")).alias("state"))


def inspection_report(found: DataFrame) -> DataFrame:
    """Findings by category, a missing category as OTHER."""
    return found.groupBy(F.coalesce("category", F.lit("OTHER")).alias("category")).agg(F.count("*").alias("n")).orderBy("category")
