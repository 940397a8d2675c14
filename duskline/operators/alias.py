"""Aliases of sensitive surfaces, rewriting by them, and paths that do not collide."""

from __future__ import annotations

import hashlib
import hmac
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import ALIAS_PREFIX
from ..session import materialize


def _prefix(category: Column) -> Column:
    out = F.lit("MASKED")
    for c, p in ALIAS_PREFIX.items():
        out = F.when(category == c, p).otherwise(out)
    return out


def numeral(n: Column) -> Column:
    """A number of at least four digits; lpad alone would cut longer ones."""
    return F.when(n < 10_000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))


def lookup(wanted: DataFrame, mapping: DataFrame) -> DataFrame:
    """wanted (category, surface) with alias: of the same category, else of the other label for a person; null if new."""
    m = mapping.select("category", "surface", "alias")
    other = F.when(F.col("category") == "PERSON", "NAME_LIST").when(F.col("category") == "NAME_LIST", "PERSON")
    second = m.select(F.col("category").alias("_other"), "surface", F.col("alias").alias("_second"))
    return wanted.join(m, ["category", "surface"], "left").withColumn("_other", other).join(second, ["_other", "surface"], "left").select("category", "surface", F.coalesce("alias", "_second").alias("alias"))


def allocate(seen: DataFrame, mapping: DataFrame) -> DataFrame:
    """New mapping rows (category, surface, alias) for seen (category, surface, first_seen) that have none.

    Numbers go on from the largest of each prefix, in the order of first sight, and old aliases never change.
    The order is kept in two levels, by slices of first_seen's rank in a prefix, so no prefix is one task.
    """
    fresh = lookup(seen.select("category", "surface").distinct(), mapping).filter("alias is null").select("category", "surface")
    first = seen.groupBy("category", "surface").agg(F.min("first_seen").alias("first_seen"))
    new = fresh.join(first, ["category", "surface"]).withColumn("prefix", _prefix(F.col("category")))
    # a person found under both labels is one
    same = new.groupBy("prefix", "surface").agg(F.min("first_seen").alias("first_seen"), F.min("category").alias("least"))
    used = mapping.select(F.regexp_extract("alias", r"^(.*)_(\d+)$", 1).alias("prefix"), F.regexp_extract("alias", r"^(.*)_(\d+)$", 2).cast("long").alias("n")).groupBy("prefix").agg(F.max("n").alias("last"))
    numbered = _numbered(same)
    named = numbered.join(used, "prefix", "left").withColumn("n", F.col("r") + F.coalesce("last", F.lit(0)))
    alias = F.concat("prefix", F.lit("_"), numeral(F.col("n")))
    return new.select("category", "surface", "prefix").join(named.select("prefix", "surface", alias.alias("alias")), ["prefix", "surface"]).select("category", "surface", "alias")


def _numbered(rows: DataFrame) -> DataFrame:
    """Row numbers in each prefix by (first_seen, surface), by range slices that are counted first."""
    key = F.struct("first_seen", "surface")
    sliced = rows.repartitionByRange(64, "first_seen", "surface").withColumn("_s", F.spark_partition_id())
    sliced = materialize(sliced, "slices")
    n = sliced.groupBy("prefix", "_s").agg(F.count("*").alias("n"))
    past = n.withColumn("past", F.coalesce(F.sum("n").over(Window.partitionBy("prefix").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("prefix", "_s").orderBy(key))
    return sliced.withColumn("_i", inner).join(past.select("prefix", "_s", "past"), ["prefix", "_s"]).withColumn("r", F.col("_i") + F.col("past"))


@F.pandas_udf(T.StringType())
def rewrite(text: pd.Series, pairs: pd.Series) -> pd.Series:
    """Replaces surfaces by aliases in one pass, the longest first, so that no alias is rewritten again."""

    def one(t, ps):
        if t is None or ps is None or not len(ps):
            return t
        to = {}
        for p in ps:
            to.setdefault(p["surface"], p["alias"])
        alt = "|".join(re.escape(s) for s in sorted(to, key=lambda s: (-len(s), s)))
        return re.sub(alt, lambda m: to[m[0]], t)

    return pd.Series([one(t, p) for t, p in zip(text, pairs, strict=True)])


def keyed_alias(key: bytes, kind: str = "DOC"):
    """A column function of one string: `KIND_` and 24 hex digits of its keyed digest."""

    @F.pandas_udf(T.StringType())
    def alias(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f"{kind}_{hmac.new(key, v.encode('utf-8', 'surrogatepass'), hashlib.sha256).hexdigest()[:24]}")

    return alias


def plan_paths(df: DataFrame, parent: str, leaf: str, is_dir: str = "is_dir", raw: str = "relpath") -> DataFrame:
    """df with planned: the leaf, from the second claim of a name in a directory on with `__2`, `__3` before
    its extension; directories come first, then by raw path. A made name that is taken moves on."""
    def with_number(name: Column, n: Column) -> Column:
        stem, ext = (F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", i) for i in (1, 2))
        suffix = F.concat(F.lit("__"), n.cast("string"))
        return F.when(F.col(is_dir), F.concat(name, suffix)).otherwise(F.concat(stem, suffix, ext))

    first = [F.col(is_dir).desc(), F.col(raw)]
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(parent, F.lower(leaf)).orderBy(*first)))
    out = numbered.withColumn("planned", F.when(F.col("_n") == 1, F.col(leaf)).otherwise(with_number(F.col(leaf), F.col("_n"))))
    while True:  # a name that moves on gets longer, so this ends
        again = F.row_number().over(Window.partitionBy(parent, F.lower("planned")).orderBy("_n", *first))
        out = materialize(out.withColumn("_again", again), "planned")
        if out.filter("_again > 1").isEmpty():
            return out.drop("_n", "_again")
        out = out.withColumn("planned", F.when(F.col("_again") > 1, with_number(F.col("planned"), F.col("_again"))).otherwise(F.col("planned"))).drop("_again")


def mapping_export(mapping: DataFrame) -> DataFrame:
    return mapping.select("category", "surface", "alias").orderBy("alias")
