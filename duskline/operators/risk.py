"""Combination risk: k-support of quasi-identifier sets and the rules over them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import subjects as sj

IDENTIFYING = ("DATE", "LOCATION", "ORG", "ROLE", "SCHOOL", "MAJOR", "AWARD")
# ---- fixed values: rules (type, quasi-identifiers needed, sensitive categories needed, score, recommended actions) ----
RULES = (
    ("identity_triangulation", ("LOCATION", "ORG", "ROLE"), (), 8.0, ("generalize_location", "generalize_role", "break_linkage")),
    ("education_reidentification", ("SCHOOL", "MAJOR", "DATE"), (), 8.0, ("generalize_school", "generalize_date", "break_linkage")),
    ("precise_event_linkage", ("DATE_DAY", "LOCATION", "EVENT"), (), 9.0, ("generalize_date", "generalize_location", "redact_event")),
    ("legal_linkage", ("LOCATION", "DATE"), ("LEGAL",), 10.0, ("generalize_date", "generalize_location", "suppress_subtree")),
)
MEDICAL = ("medical_reidentification", ("MEDICAL",), 10.0, ("generalize_date", "generalize_location", "suppress_subtree"))
LINKAGE = ("cross_directory_linkage", 6.0, ("break_linkage", "release_scoped_alias"))
HIGH = 8.0
# ---- end of fixed values ---------------------------------------------------------------------------------------------


def support(df: DataFrame, columns: tuple[str, ...], name: str = "support") -> DataFrame:
    """Rows that have every column, each with how many rows agree with it on all of them."""
    full = df
    for c in columns:
        full = full.filter(F.col(c).isNotNull())
    # counts by aggregation and a join rather than a window: a common combination is combined before it moves
    n = full.groupBy(*columns).agg(F.count("*").alias(name))
    return full.join(n, list(columns))


def superset_support(df: DataFrame, columns: tuple[str, ...], least: int = 2, name: str = "support", id_column: str = "subject_id") -> DataFrame:
    """Rows (id, identifying, support): each row's own set of non-null columns, if it has `least` of them, and how
    many rows that have at least these agree on them. A row with more counts for those with fewer."""
    own = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    tagged = df.withColumn("identifying", own).filter(F.size("identifying") >= least)
    key = lambda sets: F.to_json(F.struct(*[F.when(F.array_contains(sets, c), F.col(c)).alias(c) for c in columns]))
    wanted = tagged.select("identifying").distinct()  # at most one row for each subset of the columns
    offered = tagged.select(*columns, F.col("identifying").alias("_has"))
    pairs = offered.join(F.broadcast(wanted), F.size(F.array_except("identifying", "_has")) == 0)
    n = pairs.groupBy("identifying", key(F.col("identifying")).alias("_key")).agg(F.count("*").alias(name))
    return tagged.withColumn("_key", key(F.col("identifying"))).join(n, ["identifying", "_key"]).select(id_column, "identifying", name)


def subset_groups(df: DataFrame, columns: tuple[str, ...], least: int = 2) -> DataFrame:
    """Rows (subset, key, n) for every subset of at least `least` columns and each of its value combinations.

    A row without a value in a subset does not count there; it still does in others. The subsets are
    grouping sets, made in one pass.
    """
    ids = [c for k in range(least, len(columns) + 1) for c in combinations(columns, k)]
    cube = df.cube(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    width = len(columns)
    chosen = F.lit(False)
    names, keys = F.lit(None).cast("string"), F.lit(None).cast("string")
    for sub in ids:
        g = sum(1 << (width - 1 - i) for i, c in enumerate(columns) if c not in sub)
        present = F.col("_g") == g
        for c in sub:
            present = present & F.col(c).isNotNull()
        chosen = chosen | present
        names = F.when(F.col("_g") == g, F.lit("+".join(sub))).otherwise(names)
        keys = F.when(F.col("_g") == g, F.concat_ws("|", *[F.col(c).cast("string") for c in sub])).otherwise(keys)
    return cube.filter(chosen).select(names.alias("subset"), keys.alias("key"), "n")


def _found(df: DataFrame, kind: str, score: float, actions: tuple[str, ...], cats: Column, n: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit("RISK_"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), "subject_id"), 256), 1, 16)).alias("risk_id"), F.lit(kind).alias("risk_type"),
        F.lit("high" if score >= HIGH else "medium").alias("severity"), F.lit(score).alias("score"), "subject_id", cats.alias("categories"), n.cast("long").alias("support"), F.array(*map(F.lit, actions)).alias("actions"))


def assess(owner: DataFrame, quasi: DataFrame, sensitive: DataFrame, k: int = 3) -> DataFrame:
    """Risks (risk_id, risk_type, severity, score, subject_id, categories, support, actions, entry_ids).

    A rule fires for a subject that has all it needs where fewer than k subjects share its values. Values
    are sets: two subjects agree if all their values of a category do. Support is null for the linkage rule.
    """
    if k < 1:
        raise ValueError("k must be positive")
    wanted = tuple(dict.fromkeys([*(c for r in RULES for c in r[1]), *IDENTIFYING]))
    table = sj.wide(quasi, wanted)
    events = sensitive.select("subject_id", "category").distinct()
    out = None
    for kind, cats, needs, score, actions in RULES:
        rows = support(table, cats).filter(F.col("support") < k)
        for c in needs:
            rows = rows.join(events.filter(F.col("category") == c).select("subject_id"), "subject_id", "left_semi")
        found = _found(rows, kind, score, actions, F.array(*map(F.lit, [*cats, *needs])), F.col("support"))
        out = found if out is None else out.unionByName(found)
    kind, needs, score, actions = MEDICAL
    medical = superset_support(table, IDENTIFYING).filter(F.col("support") < k).join(events.filter("category = 'MEDICAL'").select("subject_id"), "subject_id", "left_semi")
    out = out.unionByName(_found(medical, kind, score, actions, F.concat("identifying", F.array(F.lit("MEDICAL"))), F.col("support")))
    kind, score, actions = LINKAGE
    linked = owner.groupBy("subject_id").agg(F.count_distinct("grp").alias("n")).filter("n > 1")
    out = out.unionByName(_found(linked, kind, score, actions, F.array().cast("array<string>"), F.lit(None)))
    out = materialize(out, "risks")
    return out.join(_entries(out, owner, quasi, sensitive), "risk_id", "left")


def _entries(risks: DataFrame, owner: DataFrame, quasi: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Rows (risk_id, entry_ids): entries that show one of a risk's categories, or all of the subject's if it has none."""
    shown = quasi.select("subject_id", "category", "entry_id").unionByName(sensitive.select("subject_id", "category", "entry_id")).distinct()
    by_category = risks.select("risk_id", "subject_id", F.explode("categories").alias("category")).join(shown, ["subject_id", "category"]).select("risk_id", "entry_id")
    every = risks.filter(F.size("categories") == 0).join(owner, "subject_id").select("risk_id", "entry_id")
    return by_category.unionByName(every).distinct().groupBy("risk_id").agg(F.array_sort(F.collect_list("entry_id")).alias("entry_ids"))


def ordered(risks: DataFrame) -> DataFrame:
    return risks.orderBy(F.desc("score"), "risk_type", "subject_id")


def summary(risks: DataFrame) -> DataFrame:
    """One row: how many risks, and how many of them high."""
    return risks.agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "high").alias("high"))


def report_json(risks: DataFrame, entries: DataFrame, owner: DataFrame, k: int) -> DataFrame:
    """The report as JSON lines: a summary first, then each risk in order. A report has no paths, only ids."""
    n = entries.agg(F.count("*").alias("entries")).join(owner.agg(F.count_distinct("subject_id").alias("subjects"))).join(summary(risks))  # three single rows
    head = n.select(F.to_json(F.struct(F.struct("entries", "subjects", F.col("total").alias("risks"), F.col("high").alias("high_risks"), F.lit(k).alias("k_anonymity")).alias("summary"))).alias("value"), F.lit(float("inf")).alias("_s"), F.lit("").alias("_t"), F.lit("").alias("_u"))
    body = risks.select(F.to_json(F.struct(*risks.columns)).alias("value"), F.col("score").cast("double").alias("_s"), F.col("risk_type").alias("_t"), F.col("subject_id").alias("_u"))
    return head.unionByName(body).orderBy(F.desc("_s"), "_t", "_u").select("value")


def analyze(entries: DataFrame, signals: DataFrame, k: int = 3, whole_release: bool = False, namespace: str = "analysis") -> DataFrame:
    """From entries and their signals to risks."""
    owner = materialize(sj.subject_of(entries, signals, whole_release, namespace), "owner")
    quasi = materialize(sj.quasi_identifiers(owner, signals, entries), "quasi")
    return assess(owner, quasi, materialize(sj.sensitive_events(owner, signals), "events"), k)


def rank_within(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
