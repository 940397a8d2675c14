"""Policies that rewrite an inventory until no high combination risk is left, or refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import generalize as gz
from ..functions.lexicon import SCHOOL_SUFFIXES, Rules
from ..functions.text import folded
from ..session import materialize
from . import detect, risk
from .subjects import EVENTS

CONTEXT = ("dates", "locations", "context")


class PolicyRejected(RuntimeError):
    """High risks are left and the rules say to fail."""

    def __init__(self, remaining: int, passes: int):
        super().__init__(f"{remaining} high risks are left after {passes} passes")
        self.remaining, self.passes = remaining, passes


def context_signals(entries: DataFrame) -> DataFrame:
    """Dates, places and domain terms of the paths as they are now; ordinary signals are never looked for again."""
    exploded = entries.select("entry_id", F.posexplode("parts").alias("component_index", "part"))
    once = detect.findings(exploded, "part", detect.contextual("part"), short=True).withColumn("normalized", folded("surface"))
    return exploded.join(once, "part").select("entry_id", "component_index", "category", "surface", "normalized", "source")


def suppress(entries: DataFrame, signals: DataFrame, risks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replaces subtrees under medical or legal components of risky entries by one hidden directory each.

    The shortest prefix wins where several hold an entry; the first entry under a placeholder becomes it,
    the others go. Signals of parent components stay with it. Returns entries, signals and actions.
    """
    asked = risks.filter(F.array_contains("actions", "suppress_subtree") & (F.col("severity") == "high"))
    kind = F.when(F.col("risk_type") == "medical_reidentification", "MEDICAL").otherwise("LEGAL")
    targets = asked.select(F.explode("entry_ids").alias("entry_id"), kind.alias("category")).distinct()
    hit = signals.join(targets, ["entry_id", "category"]).join(entries.select("entry_id", "parts"), "entry_id").filter(F.col("component_index") < F.size("parts"))
    prefix = F.slice("parts", 1, F.col("component_index") + 1)
    prefixes = hit.select(F.array_join(prefix, "/").alias("prefix"), F.col("component_index").alias("cutoff"), "category", F.array_join(F.concat(F.slice("parts", 1, F.col("component_index")), F.array(F.concat(F.lit("["), "category", F.lit("_SUBTREE]")))), "/").alias("placeholder")).distinct()
    own = entries.select("entry_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(i.alias("n"), F.array_join(F.slice("parts", 1, i), "/").alias("prefix")))).alias("p")).select("entry_id", "p.*")
    under = own.join(prefixes, "prefix").groupBy("entry_id").agg(F.min(F.struct("n", "category", "placeholder", "cutoff")).alias("m")).select("entry_id", "m.*")
    # an entry under no placeholder is a group of its own: together they would be one task's
    alone = F.when(F.col("placeholder").isNull(), F.col("entry_id"))
    first = F.row_number().over(Window.partitionBy("placeholder", alone).orderBy("relpath"))
    marked = materialize(entries.join(under, "entry_id", "left").withColumn("_r", F.when(F.col("placeholder").isNotNull(), first)), "suppressed")
    moved = F.col("_r") == 1
    keep = marked.filter(F.col("_r").isNull() | moved)
    path = F.when(moved, F.split("placeholder", "/")).otherwise(F.col("parts"))
    out = keep.select(*[path.alias("parts") if c == "parts" else F.when(moved, F.lit(True)).otherwise(F.col(c)).alias(c) if c in ("is_dir", "hidden") else F.array_join(path, "/").alias("relpath") if c == "relpath" else F.size(path).alias("depth") if c == "depth" else F.col(c) for c in entries.columns])
    left = signals.join(keep.select("entry_id", F.when(moved, F.col("cutoff")).alias("_cut")), "entry_id").filter(F.col("_cut").isNull() | (F.col("component_index") < F.col("_cut"))).drop("_cut")
    actions = marked.filter("_r is not null").select(F.when(moved, "redact").otherwise("drop").alias("operator"), "entry_id", "category", F.when(moved, F.concat(F.lit("["), "category", F.lit("_SUBTREE]"))).alias("replacement"))
    return out, left, actions


def replacement(category: Column, surface: Column, asked: Column, strongest: Column) -> Column:
    """What a signal becomes under the actions asked of its risk; null where none applies."""
    school = F.lit(False)
    for s in SCHOOL_SUFFIXES:
        school = school | surface.endswith(s)
    has = lambda a: F.array_contains(asked, a)
    return (
        F.when(has("generalize_date") & category.startswith("DATE_"), F.when(strongest, "[DATE]").otherwise(gz.date(surface)))
        .when(has("generalize_location") & category.startswith("LOCATION_"), F.when(strongest, "[LOCATION]").otherwise(gz.location(surface)))
        .when(has("generalize_role") & (category == "PROFESSION"), gz.role(surface))
        .when(has("generalize_school") & (category == "ORG") & school, gz.school(surface))
        .when(has("redact_event") & category.isin(*EVENTS), F.lit("[EVENT]"))
    )


def generalize(entries: DataFrame, signals: DataFrame, risks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rewrites the surfaces that high risks ask to make coarser, everywhere in their entries' paths.

    Where several risks ask for one signal the strongest rule decides. Longer surfaces go first, so a day is
    rewritten before the year in it. A signal whose surface is rewritten is gone. Returns entries, signals
    and actions.
    """
    high = risks.filter("severity = 'high'").select(F.explode("entry_ids").alias("entry_id"), F.col("actions").alias("asked"), F.col("risk_type").isin("medical_reidentification", "legal_linkage").alias("strongest"), F.col("score"))
    to = high.join(signals, "entry_id").withColumn("to", replacement(F.col("category"), F.col("surface"), F.col("asked"), F.col("strongest"))).filter("to is not null and to != surface")
    one = to.groupBy("entry_id", "category", "surface").agg(F.max_by("to", F.struct("score", "to")).alias("to"))
    edits = one.groupBy("entry_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("surface")).alias("n"), "surface", "to"))).alias("edits"))
    joined = entries.join(edits, "entry_id", "left")
    path = F.aggregate(F.coalesce("edits", F.array().cast("array<struct<n:int,surface:string,to:string>>")), F.col("relpath"), lambda p, e: F.replace(p, e["surface"], e["to"]))
    out = joined.withColumn("relpath", path).drop("edits").withColumn("parts", F.split("relpath", "/")).withColumn("depth", F.size("parts")).select(*entries.columns)
    left = signals.join(one.select("entry_id", "category", "surface"), ["entry_id", "category", "surface"], "left_anti").select(*signals.columns)
    return out, left, one.select(F.lit("generalize").alias("operator"), "entry_id", "category", F.col("to").alias("replacement"))


def enforce(entries: DataFrame, signals: DataFrame, rules: Rules, namespace: str = "analysis") -> dict:
    """Analyses, suppresses, generalises and looks again until no high risk is left, nothing changes, or the
    passes are used up. Returns entries, signals, initial and remaining risks, actions, passes, rejected;
    what is rejected raises if the rules say to fail."""
    ordinary = materialize(signals.filter(~F.col("source").isin(*CONTEXT)), "signals")
    now = materialize(entries, "entries")

    def look(e: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
        every = materialize(s.unionByName(context_signals(e)), "signals")
        return every, materialize(risk.analyze(e, every, rules.k, rules.one_subject, namespace), "risks")

    every, remaining = look(now, ordinary)
    initial, actions, passes = remaining, None, 0
    high = remaining.filter("severity = 'high'").count()
    while high and passes < rules.passes:
        now1, every1, done1 = suppress(now, every, remaining)
        now2, every2, done2 = generalize(now1, every1, remaining)
        done = materialize(done1.unionByName(done2).withColumn("pass", F.lit(passes + 1)), "actions")
        now, ordinary = materialize(now2, "entries"), materialize(every2.filter(~F.col("source").isin(*CONTEXT)), "signals")
        passes += 1
        if done.isEmpty():
            break
        actions = done if actions is None else actions.unionByName(done)
        every, remaining = look(now, ordinary)
        high = remaining.filter("severity = 'high'").count()
    if high and rules.must_settle:
        raise PolicyRejected(high, passes)
    return {"entries": now, "signals": ordinary, "initial": initial, "remaining": remaining, "actions": actions, "passes": passes, "rejected": bool(high)}


def blur_structure(entries: DataFrame, path: str = "relpath") -> DataFrame:
    """Collapses runs of two or more single-child directories under a top-level one to `top/[PATH]`, however long.

    The top-level name and what lies below the run stay; names and number of the directories between go. A top-level
    directory with a run has one child, the first of the run, so the new name is free or the run's own.
    """
    p, depth = F.col(path), F.size(F.split(path, "/"))
    known = entries.withColumn("_parent", F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(""))
    only = known.groupBy("_parent").agg(F.count_distinct(path).alias("n"), F.min(path).alias("child")).filter("n = 1 and _parent != ''").select("_parent", "child")
    dirs = entries.filter(F.col("is_dir") & ~F.coalesce(F.col("hidden") if "hidden" in entries.columns else F.lit(False), F.lit(False)))
    step = materialize(only.join(dirs.select(p.alias("child")), "child", "left_semi").withColumn("parts", F.split("child", "/")), "steps")
    # a directory is on the run if each one above it has one child, a directory
    above = step.select("child", F.size("parts").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("_parent"))
    on = above.join(step.select("_parent"), "_parent").groupBy("child", "n").agg(F.count("*").alias("single")).filter("single = n - 1")
    tops = dirs.filter(depth == 1).select(p.alias("top"))
    ends = on.groupBy(F.split("child", "/")[0].alias("top")).agg(F.max(F.struct("n", "child")).alias("m")).filter("m.n >= 3")
    runs = materialize(ends.select("top", F.col("m.child").alias("end")).join(tops, "top", "left_semi"), "runs")
    named = entries.withColumn("top", F.split(path, "/")[0]).join(runs, "top", "left")
    p, end = F.col(path), F.col("end")
    inside = end.isNotNull() & end.startswith(F.concat(p, F.lit("/"))) & (p != F.col("top"))
    below = (p == end) | p.startswith(F.concat(end, F.lit("/")))
    clean = F.when(end.isNotNull() & below, F.concat(F.col("top"), F.lit("/[PATH]"), F.substr(p, F.length(end) + 1))).otherwise(p)
    return named.filter(~F.coalesce(inside, F.lit(False))).withColumn(path, clean).select(*entries.columns).orderBy(path)


def blur_counts(one: DataFrame) -> DataFrame:
    """Totals as bands."""
    return one.select(*[gz.bucket_count(F.col(c)).alias(c) for c in one.columns])
