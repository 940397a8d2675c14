"""Release plans: strategies over declared columns, their loss, verification of outputs, staged publishing."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import risk

#: Fixed weights of what is done to a cell.
WEIGHTS = {"keep": 0, "alias": 1, "generalize": 1, "drop": 2, "suppress": 3}
UNDECLARED = 2
STRATEGIES = ("requested", "essential_only", "suppress_all")


@dataclass(frozen=True)
class Plan:
    """What a task asks of a column: mode keep, alias, generalize or drop."""

    name: str
    role: str
    mode: str | None = None
    required: bool = False
    approved: tuple[str, ...] = ()
    bands: tuple[tuple[str, str], ...] = ()


def mode_of(p: Plan, strategy: str) -> str:
    """A key without a mode gets an alias, other columns go; optional ones go under the second strategy, and all
    but keys are suppressed under the third."""
    asked = p.mode or ("alias" if p.role == "key" else "drop")
    if strategy == "essential_only" and not p.required and asked != "drop" and p.role != "key":
        return "suppress"
    if strategy == "suppress_all" and not p.required and asked != "drop":
        return "suppress"
    return asked


def check_allowed(df: DataFrame, plans: tuple[Plan, ...]) -> None:
    """Raises if a kept value is not approved or a generalised one has no band: the plan is refused whole."""
    for p in plans:
        have = df.filter(F.col(p.name).isNotNull() & (F.col(p.name) != "")).select(F.col(p.name).cast("string").alias("v")).distinct()
        listed = p.approved if p.mode == "keep" and p.approved else tuple(b[0] for b in p.bands) if p.mode == "generalize" else None
        if listed is not None and not have.filter(~F.col("v").isin(*listed)).isEmpty():
            raise ValueError(f"{p.name} has values that the plan does not cover")


def column_for(p: Plan, mode: str, alias) -> Column | None:
    """The output of a column under a mode; None if it goes. Suppressed cells are empty."""
    c = F.col(p.name).cast("string")
    if mode == "drop":
        return None
    if mode == "suppress":
        return F.lit("")
    if mode == "alias":
        return alias(c)
    if mode == "generalize":
        return F.create_map(*[F.lit(x) for b in p.bands for x in b])[c]
    return c


def artifact(df: DataFrame, plans: tuple[Plan, ...], strategy: str, alias) -> DataFrame:
    cols = [(p, column_for(p, mode_of(p, strategy), alias)) for p in plans]
    return df.select(*[c.alias(p.name) for p, c in cols if c is not None])


def losses(df: DataFrame, plans: tuple[Plan, ...]) -> DataFrame:
    """Rows (strategy, loss): the weights of all cells, and of non-empty cells of columns that no plan names."""
    declared = {p.name for p in plans}
    rest = F.lit(0)
    for c in df.columns:
        if c not in declared:
            rest = rest + F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", UNDECLARED).otherwise(0)
    sums = [F.coalesce(F.sum(F.lit(sum(WEIGHTS[mode_of(p, s)] for p in plans)) + rest), F.lit(0)).cast("long").alias(s) for s in STRATEGIES]
    one = df.agg(*sums)
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("loss")) for s in STRATEGIES])).alias("x")).select("x.*")


def action_counts(df: DataFrame, plans: tuple[Plan, ...]) -> DataFrame:
    """Rows (strategy, action, n): cells by what is done to them."""
    n = df.agg(F.count("*").alias("n"))
    per: dict[tuple[str, str], int] = {}
    for s in STRATEGIES:
        for p in plans:
            per[s, mode_of(p, s)] = per.get((s, mode_of(p, s)), 0) + 1
    kinds = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(a).alias("action"), F.lit(c).alias("c")) for (s, a), c in sorted(per.items())])
    return n.select("n", F.explode(kinds).alias("k")).select("k.strategy", "k.action", (F.col("k.c") * F.col("n")).alias("n"))


def best(rows: DataFrame) -> DataFrame:
    """The feasible strategy (strategy, loss, feasible) of least loss, of equal ones the first."""
    rank = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    return rows.filter("feasible").agg(F.min_by("strategy", F.struct("loss", rank)).alias("strategy"), F.min("loss").alias("loss")).filter("strategy is not null")


def residual_pattern(terms: list[str], strict: list[str] = ()) -> str:
    """Protected terms: Latin ones as whole words, others and strict ones anywhere."""
    out = [re.escape(t) for t in strict]
    out += [rf"(?<![A-Za-z0-9_]){re.escape(t)}(?![A-Za-z0-9_])" if t.isascii() else re.escape(t) for t in terms]
    return "(?iu)" + "|".join(sorted(out, key=len, reverse=True)) if out else "(?!)"


def residuals(df: DataFrame, terms: list[str], strict: list[str] = ()) -> DataFrame:
    """Rows (column, n) of output columns in which a protected term is left."""
    p = residual_pattern(terms, list(strict))
    hits = [F.count_if(F.col(c).cast("string").rlike(p)).alias(c) for c in df.columns]
    one = df.agg(*hits)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in df.columns])).alias("x")).select("x.*").filter("n > 0")


def small_groups(df: DataFrame, quasi: tuple[str, ...], k: int) -> DataFrame:
    """Value combinations of any two or more quasi columns that fewer than k rows share; empty cells do not count."""
    blank = df.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in quasi])
    return risk.subset_groups(blank, quasi).filter(F.col("n") < k)


def verify(out: DataFrame, quasi: tuple[str, ...], k: int, terms: list[str]) -> dict[str, bool]:
    """Which checks an output passes: no small group, no protected term, no cell that a spreadsheet would run."""
    from ..functions.generalize import active_value

    live = F.lit(False)
    for c in out.columns:
        live = live | F.coalesce(active_value(F.col(c).cast("string")), F.lit(False))
    kept = tuple(q for q in quasi if q in out.columns)
    return {"groups": len(kept) < 2 or small_groups(out, kept, k).isEmpty(), "terms": residuals(out, terms).isEmpty(), "cells": out.filter(live).isEmpty()}


def plan(df: DataFrame, plans: tuple[Plan, ...], quasi: tuple[str, ...], k: int, terms: list[str], alias) -> tuple[str, DataFrame]:
    """The strategy of least loss whose output passes all checks, and that output; raises if none does."""
    check_allowed(df, plans)
    loss = {r["strategy"]: r["loss"] for r in losses(df, plans).collect()}
    for s in sorted(STRATEGIES, key=lambda s: (loss[s], STRATEGIES.index(s))):
        out = artifact(df, plans, s, alias)
        if all(verify(out, quasi, k, terms).values()):
            return s, out
    raise ValueError("no strategy passes verification")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def record_lines(df: DataFrame, state: str | None = None) -> DataFrame:
    """Rows as `name=value;` lines, the state last; a value that would break the line is an error."""
    names = [c for c in df.columns if c != state] + ([state] if state else [])
    cell = lambda c: F.when(F.col(c).rlike("[;\r\n]"), F.raise_error(F.lit(f"{c} has a separator in it")).cast("string")).otherwise(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit(""))))
    return df.select(F.concat_ws(";", *[cell(c) for c in names]).alias("value"))


def changed_cells(out: DataFrame, source: DataFrame, plans: tuple[Plan, ...], strategy: str, alias, key: str, state: str | None = None) -> DataFrame:
    """Rows (key, column, reason) where a written table is not what the plan makes of its source.

    Rows are matched by key, never by their order: TASK_ROWS_CHANGED for a key that is missing, new or repeated,
    TASK_VALUE_CHANGED for a cell that is not its source's under the plan, ASSERTION_STATE_CHANGED for the state
    column. No rows mean that the output is the plan's.
    """
    cols = {p.name: c for p in plans if (c := column_for(p, mode_of(p, strategy), alias)) is not None}
    names = [*cols, *([state] if state else [])]
    want = source.select(F.col(key).alias("_k"), *[F.coalesce(c, F.lit("")).alias(f"w_{n}") for n, c in cols.items()], *([F.col(state).cast("string").alias(f"w_{state}")] if state else []))
    have = out.select(F.col(key).alias("_k"), *[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(f"h_{n}") for n in names])
    count = lambda df, c: df.groupBy("_k").agg(F.count("*").alias(c), *[F.min(x).alias(x) for x in df.columns if x != "_k"])
    both = count(want, "_w").join(count(have, "_h"), "_k", "full_outer")
    rows = F.when(~F.col("_w").eqNullSafe(F.col("_h")), F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit("TASK_ROWS_CHANGED").alias("reason"))))
    differs = [F.when(~F.col(f"w_{n}").eqNullSafe(F.col(f"h_{n}")), F.struct(F.lit(n).alias("column"), F.lit("ASSERTION_STATE_CHANGED" if n == state else "TASK_VALUE_CHANGED").alias("reason"))) for n in names]
    cells = F.array_compact(F.array(*differs))
    return both.select(F.col("_k").alias(key), F.explode(F.coalesce(rows, cells)).alias("x")).select(key, "x.*")


def compare_manifest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (name, problem) where files (name, length, sha256) are not those expected: missing, unexpected or changed."""
    f, e = (df.select("name", F.struct("length", "sha256").alias(c)) for df, c in ((found, "f"), (expected, "e")))
    problem = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("f") != F.col("e"), "changed")
    return f.join(e, "name", "full_outer").select("name", problem.alias("problem")).filter("problem is not null")


#: From which states a release may go to which: the rest is refused.
MOVES = {
    "approve": (("VALIDATED", "APPROVED", "FAILED", "CANCELLED"), "APPROVED"), "stage": (("APPROVED",), "STAGING"), "publish": (("STAGING", "RECONCILING"), "PUBLISHED"),
    "fail": (("STAGING",), "FAILED"), "cancel": (("STAGING",), "CANCELLED"), "stale": (("VALIDATED", "APPROVED", "FAILED", "CANCELLED"), "NEEDS_REVIEW"),
    "reconcile": (("STAGING", "RECONCILING"), "RECONCILING"), "return": (("RECONCILING",), "APPROVED"),
}


def moved(releases: DataFrame, release_id: str, move: str) -> DataFrame:
    """releases (release_id, state, digest, approval) after a move of one of them. Raises if there is no such release, or
    its state does not allow the move. What is stale loses its approval."""
    allowed, to = MOVES[move]
    now = [r["state"] for r in releases.filter(F.col("release_id") == release_id).select("state").limit(2).collect()]
    if len(now) != 1:
        raise ValueError("unknown release")
    if now[0] not in allowed:
        raise ValueError(f"{now[0]} allows no {move}")
    own = F.col("release_id") == release_id
    out = releases.withColumn("state", F.when(own, to).otherwise(F.col("state")))
    return out.withColumn("approval", F.when(own & F.lit(move == "stale"), None).otherwise(F.col("approval")))


def approve(releases: DataFrame, release_id: str, digest: str) -> DataFrame:
    """releases with one approved: only by the digest of what was looked at."""
    if releases.filter((F.col("release_id") == release_id) & (F.col("digest") == digest)).isEmpty():
        raise ValueError("the digest is not that of the release")
    return moved(releases, release_id, "approve").withColumn("approval", F.when(F.col("release_id") == release_id, digest).otherwise(F.col("approval")))


def resolve(releases: DataFrame, identifier: str) -> DataFrame:
    """The release of a public identifier `RELEASE_` and 24 hex digits of its scope, or of its own id."""
    if identifier.startswith("RELEASE_"):
        suffix = identifier.removeprefix("RELEASE_")
        if not re.fullmatch("[0-9a-f]{24}", suffix):
            raise ValueError("invalid release identifier")
        return releases.filter(F.col("scope_id") == suffix)
    return releases.filter(F.col("release_id") == identifier)


def export(out: DataFrame, releases: DataFrame, release_id: str, target: str, check) -> tuple[DataFrame, str]:
    """Publishes an approved release's table: releases after it, and its state. Without an approval of its own digest
    nothing is written; a failed check leaves no visible files."""
    own = releases.filter(F.col("release_id") == release_id)
    if own.filter("state = 'APPROVED' and approval = digest").isEmpty():
        raise ValueError("explicit approval required")
    staged = moved(releases, release_id, "stage")
    ok = publish(out, target, check) == "PUBLISHED"
    return moved(staged, release_id, "publish" if ok else "fail"), "PUBLISHED" if ok else "FAILED"


def recover(releases: DataFrame, release_id: str, target: str, expected: DataFrame) -> tuple[DataFrame, str]:
    """After a run that ended while it published: the release is PUBLISHED if all expected files are there, APPROVED
    again if the target is not. A target with other files is an error."""
    spark = releases.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    now = moved(releases, release_id, "reconcile")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return moved(now, release_id, "return"), "APPROVED"
    if not compare_manifest(manifest(spark, target), expected).isEmpty():
        raise ValueError("the target holds other files than the release")
    return moved(now, release_id, "publish"), "PUBLISHED"


def manifest(spark, path: str) -> DataFrame:
    """Rows (name, length, sha256) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def publish(out: DataFrame, target: str, check) -> str:
    """Writes to a staging folder beside the target, runs check(reread) and renames only if it holds.

    States are those of a release: STAGING while files are written, NEEDS_REVIEW if the check fails (staging
    is removed), PUBLISHED after the rename. A target that exists is left alone.
    """
    spark = out.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(target).getFileSystem(conf)
    if fs.exists(path(target)):
        raise ValueError("the target exists")
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    out.write.option("header", True).csv(staging)
    back = spark.read.option("header", True).schema(out.schema).csv(staging)
    if not check(back):
        fs.delete(path(staging), True)
        return "NEEDS_REVIEW"
    return "PUBLISHED" if fs.rename(path(staging), path(target)) else "RECONCILING"
