"""Rows saved as framed lines under digests in two levels, and loaded again only if none was changed, lost, moved or added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inventory import number_rows

#: Rows under one digest of the second level.
SLICE = 10_000


def _seal(key: str, *parts: Column) -> Column:
    """A digest of the key and of parts, each behind its length, that only who has the key can make."""
    framed = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    inner = F.sha2(F.concat(F.lit(f"{len(key)}:{key}"), *framed), 256)
    return F.sha2(F.concat(F.lit(f"{len(key)}:{key}"), inner), 256)


def save(rows: DataFrame, order: list[str], key: str, slice_rows: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Frames (place, frame, seal) of rows in an order, and their manifest (slice, n_rows, seal).

    A frame is the row as JSON, nulls kept; its seal covers the place too. A slice's seal covers the seals of its rows in order, its number and
    the number of all rows, so slices of two files cannot be put together. No task holds more than a slice, and the manifest has one row for each. Rows
    equal in the order come in any turn; an empty table gives no frames and an empty manifest. Columns must not be called ordinal.
    """
    if not key:
        raise ValueError("a key is needed")
    body = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"})
    numbered = number_rows(rows, *order, kind="long")
    frames = numbered.select(F.col("ordinal").alias("place"), body.alias("frame"))
    frames = frames.withColumn("seal", _seal(key, F.col("place").cast("string"), F.col("frame")))
    return frames, manifest(frames, key, slice_rows)


def manifest(frames: DataFrame, key: str, slice_rows: int = SLICE) -> DataFrame:
    """Rows (slice, n_rows, seal) over the seals of frames."""
    slice_ = F.expr(f"(place - 1) DIV {slice_rows}L")
    per = frames.groupBy(slice_.alias("slice")).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct("place", "seal"))).alias("_s"))
    total = frames.agg(F.count("*").cast("string").alias("_all"))
    seal = _seal(key, F.col("slice").cast("string"), F.col("_all"), F.array_join(F.transform("_s", lambda s: s["seal"]), ""))
    return per.crossJoin(total).select("slice", "n_rows", seal.alias("seal"))  # total is one row


def faults(frames: DataFrame, saved: DataFrame, key: str, slice_rows: int = SLICE) -> DataFrame:
    """Rows (place, fault) of what is wrong with frames under the manifest saved with them: none if all is as it was.

    changed: a frame that its seal does not fit, at this place; so is a frame that was moved to another's place. repeated: a place that
    several frames claim. lost: a place below the greatest, or up to the manifest's rows, without a frame. slice: the first place of a slice
    whose seal is another, though no row of it is at fault: rows of another file, or a manifest that was changed.
    """
    bad = frames.filter(~F.col("seal").eqNullSafe(_seal(key, F.col("place").cast("string"), F.col("frame")))).select("place", F.lit("changed").alias("fault"))
    again = frames.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1").select("place", F.lit("repeated").alias("fault"))
    # places of each slice as it should be, from the manifest's counts and the greatest place of its frames
    last = frames.groupBy(F.expr(f"(place - 1) DIV {slice_rows}L").alias("slice")).agg(F.max("place").alias("_last"))
    first = F.col("slice") * slice_rows + 1
    due = saved.join(last, "slice", "full_outer").select("slice", F.explode(F.sequence(first, F.greatest(first + F.coalesce("n_rows", F.lit(1)) - 1, F.coalesce("_last", F.lit(0))))).alias("place"))
    lost = due.join(frames.select("place"), "place", "left_anti").select("place", F.lit("lost").alias("fault"))
    named = bad.unionByName(again).unionByName(lost).distinct()
    now = manifest(frames, key, slice_rows).select("slice", F.col("seal").alias("_now"))
    odd = saved.join(now, "slice", "full_outer").filter(~F.col("seal").eqNullSafe(F.col("_now"))).select("slice")
    told = named.select(F.expr(f"(place - 1) DIV {slice_rows}L").alias("slice")).distinct()
    # where rows are at fault anywhere, the number of all rows may be another, and every slice's seal with it
    whole = odd.join(told, "slice", "left_anti").join(named.agg(F.count("*").alias("_n")), F.col("_n") == 0)
    return named.unionByName(whole.select(first.alias("place"), F.lit("slice").alias("fault")))


def load(frames: DataFrame, saved: DataFrame, key: str, schema: str, slice_rows: int = SLICE) -> DataFrame:
    """The rows of frames with their place. Any fault is an error that names the first ten."""
    wrong = faults(frames, saved, key, slice_rows).orderBy("place", "fault").limit(10).collect()
    if wrong:
        raise ValueError("the file is not as it was saved: " + ", ".join(f"{r.fault} {r.place}" for r in wrong))
    return frames.select("place", F.from_json("frame", schema, {"mode": "FAILFAST"}).alias("r")).select("place", "r.*")
