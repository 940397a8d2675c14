"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of the shuffled order in each source, and of virtual time: no task holds a whole source or the whole mix.
ORDER_HEX, TIME_BUCKETS = 3, 2048


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Rows (source, source_size, weight, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes.
    A target stops at `most` times its source's size and the excess goes to the others by weight, until
    none is above: the sources that stop are those with the least size per weight, so one ordered pass
    over the sources finds them. There is one row for each source here, never one for each document.
    """
    # distinct sources only: one row each, after the aggregation
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick.cast("long")).withColumn("_cap", F.col("source_size") * most)
    everything = Window.partitionBy(F.lit(1))
    up = Window.orderBy(F.col("_cap") / F.col("weight"), "_i").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("_all"),
        F.sum("weight").over(everything).alias("_w"),
        F.coalesce(F.sum("_cap").over(up), F.lit(0)).alias("_capped"),
        F.coalesce(F.sum("weight").over(up), F.lit(0)).alias("_gone"),
    ).withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_w") - F.col("_gone")))
    # the first source whose share at its level stays below its cap gives the level of all that follow
    level = level.withColumn("_open", F.col("_level") * F.col("weight") <= F.col("_cap"))
    level = level.withColumn("_at", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), F.col("_i"), F.col("_level").alias("level")))).over(everything))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_at.level") * F.col("weight"), F.col("_cap").cast("double")))
    return level.select("source", "source_size", "weight", target.alias("target"))


def fair_queue(docs: DataFrame, size: Column, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, source), one for each row of docs (doc_id, source), with the
    columns in carry.

    Documents of a source come in the order of a digest of their id. A copy's virtual finish time is the
    source's words up to and with it, over the source's target; epoch e puts e whole sources before. All
    copies of all sources are ordered by that time, and those within the sum of the targets are taken. Rows of equal
    id and size are ordered by carry, so that a digest of their text in it tells them apart.
    Running sums are made in two levels, by digest bucket in a source and by slice of virtual time, so a
    source with a third of all rows is as many tasks as any other.

    Null or empty texts have size 0 and are never taken. Null doc_ids and repeated rows are documents of
    their own. An empty table gives no rows. Other columns of docs are not read.
    """
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    base = docs.select("doc_id", "source", size.alias("size"), digest.alias("_d"), *carry).withColumn("_b", F.substring("_d", 1, ORDER_HEX))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # from here to marks: 16 ** ORDER_HEX rows at most for each source
    buckets = base.groupBy("source", "_b").agg(F.sum("size").alias("size"))
    targets = source_targets(buckets, weights, most).select(
        F.col("source").alias("_ts"), "source_size", "target", F.round(F.sum("target").over(Window.partitionBy(F.lit(1)))).cast("long").alias("_budget"))
    marks = buckets.select(F.col("source").alias("_ms"), F.col("_b").alias("_mb"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_before"))
    marks = marks.join(targets, F.col("_ms").eqNullSafe(F.col("_ts"))).drop("_ts")
    sort = Window.partitionBy("source", "_b").orderBy("_d", "doc_id", "size", *carry)
    inside = base.withColumn("_in", F.sum("size").over(sort.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(sort))
    cum = inside.join(marks, F.col("source").eqNullSafe(F.col("_ms")) & (F.col("_b") == F.col("_mb"))).withColumn("_cum", F.col("_before") + F.col("_in"))
    epochs = F.when((F.col("size") > 0) & (F.col("target") > 0), F.least(F.ceil(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    copies = cum.withColumn("_e", F.explode_outer(F.when(epochs > 0, F.sequence(F.lit(0), (epochs - 1).cast("int")))))
    timed = copies.withColumn("_v", (F.col("_e") * F.col("source_size") + F.col("_cum")) / F.col("target")).withColumn("_slice", F.floor(F.col("_v") * TIME_BUCKETS))
    # most * TIME_BUCKETS rows at most
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = timed.filter("_e is not null").groupBy("_slice").agg(F.sum("size").alias("_n")).select(
        F.col("_slice").alias("_sl"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_past"))
    order = Window.partitionBy("_slice").orderBy("_v", F.col("source").asc_nulls_last(), "_e", "_d", "doc_id", "size", "_k")
    ranked = timed.filter("_e is not null").withColumn("_run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    mixed = ranked.join(slices, F.col("_slice") == F.col("_sl"))
    took = F.when(F.col("_past") + F.col("_run") <= F.col("_budget"), F.col("size")).otherwise(0)
    none = timed.filter("_e is null").withColumn("_took", F.lit(0).cast("long"))
    key, kept = ["source", "_b", "_k", "doc_id", "size"], ["source_size", "target", *carry]
    rows = mixed.select(*key, *kept, took.cast("long").alias("_took")).unionByName(none.select(*key, *kept, "_took"))
    return rows.groupBy(*key, *kept).agg(F.sum("_took").alias("taken")).select("doc_id", "size", "source_size", "target", "taken", "source", *carry)
