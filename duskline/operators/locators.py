"""Joins of places in documents: findings to the cells, evidence or aliases that stand at, around or across them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points in a bucket of positions: two spans can only meet in a bucket that both touch.
WIDTH = 512


def at_places(findings: DataFrame, places: DataFrame) -> DataFrame:
    """findings with the columns of places at exactly the same document_id, start and end; without places none stay."""
    return findings.join(places, ["document_id", "start", "end"])


def overlapping(findings: DataFrame, cells: DataFrame, how: str = "overlap", width: int = WIDTH) -> DataFrame:
    """Rows of findings with cell_start, cell_end and the other columns of each cell of the same document that they meet.

    how is overlap, inside (the cell holds the finding whole) or around (the finding holds the cell whole). Spans are
    document_id, start and end in code points, the end exclusive; empty and null spans meet nothing. Each
    span is dealt to the buckets of `width` code points that it touches, and a pair is kept in the later of the
    two first buckets only, so it comes once without a distinct, and neither a document nor a text is
    one key. Repeated rows are rows of their own. Columns of the two sides must differ but for the three.
    """
    clash = set(findings.columns) & set(cells.columns) - {"document_id", "start", "end"}
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    meets = {
        "overlap": (F.col("start") < F.col("cell_end")) & (F.col("cell_start") < F.col("end")),
        "inside": (F.col("cell_start") <= F.col("start")) & (F.col("end") <= F.col("cell_end")),
        "around": (F.col("start") <= F.col("cell_start")) & (F.col("cell_end") <= F.col("end")),
    }[how]

    def dealt(df: DataFrame, start: str, end: str, first: str) -> DataFrame:
        bucket = lambda c: F.floor(c / width)
        rows = df.filter(F.col(start) < F.col(end)).withColumn(first, bucket(F.col(start)))
        return rows.withColumn("_bucket", F.explode(F.sequence(F.col(first), bucket(F.col(end) - 1))))

    left = dealt(findings, "start", "end", "_first")
    right = dealt(cells.withColumnsRenamed({"start": "cell_start", "end": "cell_end"}), "cell_start", "cell_end", "_cell_first")
    met = left.join(right, ["document_id", "_bucket"]).filter((F.col("_bucket") == F.greatest("_first", "_cell_first")) & meets)
    return met.drop("_bucket", "_first", "_cell_first")
