"""Subjects of a release: groups of entries that explicit entities link, and their quasi-identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import SCHOOL_SUFFIXES
from .graph import connected_components

WHOLE = "__WHOLE_RELEASE__"
#: Categories that are events of a life, and all that are sensitive by themselves.
EVENTS = ("MEDICAL", "LEGAL", "FINANCIAL", "POLITICAL", "FAMILY")
SENSITIVE = (*EVENTS, "IDENTITY", "KEYWORD", "PATTERN")


def entry_groups(entries: DataFrame, whole_release: bool = False) -> DataFrame:
    """Rows (entry_id, grp): the top-level directory; a file at the root is a group of its own."""
    root_file = (F.size("parts") == 1) & ~F.col("is_dir")
    group = F.when(root_file, F.concat(F.lit("__ROOT_FILE__:"), F.col("entry_id"))).otherwise(F.element_at("parts", 1))
    return entries.select("entry_id", (F.lit(WHOLE) if whole_release else group).alias("grp"))


def link_groups(groups: DataFrame, signals: DataFrame) -> DataFrame:
    """Rows (grp, root): groups that share a person are one; root is the least group.

    A person and a listed name of equal value are the same; a listed name that is an organisation in the
    same entry links nothing, and organisations alone never link.
    """
    orgs = signals.filter("category = 'ORG'").select("entry_id", "normalized").distinct()
    people = signals.filter("category = 'PERSON'").select("entry_id", "normalized")
    listed = signals.filter("category = 'NAME_LIST'").select("entry_id", "normalized").join(orgs, ["entry_id", "normalized"], "left_anti")
    owners = people.unionByName(listed).join(groups, "entry_id").select("normalized", "grp").distinct()
    least = owners.groupBy("normalized").agg(F.min("grp").alias("least"))
    edges = owners.join(least, "normalized").filter("grp != least").select(F.col("grp").alias("src"), F.col("least").alias("dst"))
    found = connected_components(edges).withColumnRenamed("node", "grp")
    return groups.select("grp").distinct().join(found, "grp", "left").select("grp", F.coalesce("component", "grp").alias("root"))


def subject_of(entries: DataFrame, signals: DataFrame, whole_release: bool = False, namespace: str = "analysis") -> DataFrame:
    """Rows (entry_id, grp, subject_id): subjects are named by a digest of their sorted groups."""
    groups = entry_groups(entries, whole_release)
    roots = link_groups(groups, signals) if not whole_release else groups.select("grp", F.col("grp").alias("root")).distinct()
    members = roots.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("grp")), "\x1f").alias("members"))
    ids = members.select("root", F.concat(F.lit("SUBJ_"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(namespace), "members"), 256), 1, 16)).alias("subject_id"))
    return groups.join(roots, "grp").join(ids, "root").select("entry_id", "grp", "subject_id")


def categories(category: Column, surface: Column) -> Column:
    """The quasi-identifiers that a signal counts for; dates and places count twice, once with their precision."""
    school = F.lit(False)
    for s in SCHOOL_SUFFIXES:
        school = school | surface.endswith(s)
    return (
        F.when(category.startswith("DATE_"), F.array(F.lit("DATE"), category))
        .when(category.startswith("LOCATION_"), F.array(F.lit("LOCATION"), category))
        .when((category == "ORG") & school, F.array(F.lit("ORG"), F.lit("SCHOOL")))
        .when(category == "ORG", F.array(F.lit("ORG")))
        .when(category == "PROFESSION", F.array(F.lit("ROLE")))
        .when(category.isin("EDUCATION", "MAJOR", "AWARD"), F.array(category))
        .when(category.isin(*EVENTS), F.array(F.lit("EVENT")))
    )


def quasi_identifiers(owner: DataFrame, signals: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (subject_id, category, value, entry_id), distinct. Depth counts as a weak one of its own."""
    from_signals = signals.join(owner, "entry_id").select("subject_id", F.explode(categories(F.col("category"), F.col("surface"))).alias("category"), F.col("normalized").alias("value"), "entry_id")
    depth = entries.join(owner, "entry_id").select("subject_id", F.lit("STRUCTURE_DEPTH").alias("category"), F.col("depth").cast("string").alias("value"), "entry_id")
    return from_signals.unionByName(depth).distinct()


def sensitive_events(owner: DataFrame, signals: DataFrame) -> DataFrame:
    """Rows (subject_id, category, entry_id) of sensitive categories, distinct."""
    return signals.filter(F.col("category").isin(*SENSITIVE)).join(owner, "entry_id").select("subject_id", "category", "entry_id").distinct()


def co_occurrence(quasi: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Rows (subject_id, categories): all that a subject shows, in order."""
    both = quasi.select("subject_id", "category").unionByName(sensitive.select("subject_id", "category"))
    return both.groupBy("subject_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def wide(quasi: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """One row for each subject with a sorted array of all its values for each wanted category; null if it has none."""
    values = quasi.filter(F.col("category").isin(*wanted)).select("subject_id", "category", "value").distinct()
    table = values.groupBy("subject_id").pivot("category", list(wanted)).agg(F.array_sort(F.collect_list("value")))
    return table.select("subject_id", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in wanted])
