"""Incremental work: differences between versions, caches by digest, change logs, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded
from .evidence import digest
from .graph import connected_components


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows (key, change): added, removed, changed or same."""
    o, n = old.select(key, F.col(digest).alias("_o")), new.select(key, F.col(digest).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed").otherwise("same")
    return o.join(n, key, "full_outer").select(key, change.alias("change"), "_o", "_n")


def renames(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows (removed, added): content that left one key and came under another, once on either side."""
    d = diff(old, new, key, digest)
    gone = d.filter("change = 'removed'").groupBy(F.col("_o").alias("digest")).agg(F.count("*").alias("a"), F.min(key).alias("removed")).filter("a = 1")
    come = d.filter("change = 'added'").groupBy(F.col("_n").alias("digest")).agg(F.count("*").alias("b"), F.min(key).alias("added")).filter("b = 1")
    return gone.join(come, "digest").select("removed", "added")


def stale(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Corrections (correction_id, document_id, revision, template) whose document changed or is gone."""
    f = files.select("document_id", F.col("revision").alias("_r"), F.col("template").alias("_t"))
    j = anchors.join(f, "document_id", "left")
    return j.filter(~F.col("_r").eqNullSafe(F.col("revision")) | ~F.col("_t").eqNullSafe(F.col("template"))).select("correction_id").distinct()


def work_left(items: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Items whose digest no cache row has."""
    return items.join(cache.select(key).distinct(), key, "left_anti")


def refresh_cache(items: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """Cache rows for all items: those at hand, and those that `compute` makes of the rest."""
    wanted = items.select(key).distinct()
    return cache.join(wanted, key, "left_semi").unionByName(compute(work_left(items.dropDuplicates([key]), cache, key)))


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key; of equal order, the greatest row."""
    rest = [c for c in changes.columns if c not in (key, order)]
    last = changes.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r"))
    return last.select(key, "r.*").select(*changes.columns)


def merge_changes(base: DataFrame, changes: DataFrame, key: str = "id", order: str = "usn", deleted: str = "deleted") -> DataFrame:
    """A snapshot brought up to date: the last change of each key replaces or deletes its row."""
    last = latest(changes, key, order)
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter(~F.col(deleted)).select(*base.columns))


def change_range(changes: DataFrame, start: int, end: int, oldest: int, journal: str, expected: str) -> DataFrame:
    """Changes with start <= usn < end. Another journal, or a start that is no longer kept, is an error: rows may
    be missing then."""
    if journal != expected or start < oldest:
        raise ValueError("journal gap")
    return changes.filter((F.col("usn") >= start) & (F.col("usn") < end))


def late_changes(changes: DataFrame, after: int, allowed: DataFrame) -> DataFrame:
    """Changes after a checkpoint under directories that the snapshot covers."""
    return changes.filter(F.col("usn") >= after).join(allowed.select(F.col("id").alias("parent")), "parent", "left_semi")


def prune(cache: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    return cache.join(referenced.select(key).distinct(), key, "left_semi")


def invalidate(plans: DataFrame, revisions: DataFrame) -> DataFrame:
    """Plans (workspace, revision, state), with NEEDS_REVIEW where the workspace has moved on."""
    r = revisions.select("workspace", F.col("revision").alias("_r"))
    moved = F.col("_r").isNotNull() & (F.col("_r") != F.col("revision")) & F.col("state").isin("VALIDATED", "APPROVED")
    return plans.join(r, "workspace", "left").withColumn("state", F.when(moved, "NEEDS_REVIEW").otherwise(F.col("state"))).drop("_r")


def decisions(log: DataFrame) -> DataFrame:
    """The state of each row after a log (seq, row_id, state, undo): an undo takes back the row's last decision
    that still stands, so a state is that of the last decision with no undo left against it."""
    w = Window.partitionBy("row_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    # read backwards: a decision stands if fewer undos than decisions were met from the end to here
    step = F.when(F.col("undo"), -1).otherwise(1)
    open_ = log.withColumn("_open", F.sum(step).over(w))
    first = Window.partitionBy("row_id").orderBy(F.desc("seq"))
    best = F.max(F.when(F.col("_open") >= 1, F.struct("seq", "state"))).over(Window.partitionBy("row_id"))
    return open_.withColumn("_best", best).withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("row_id", F.coalesce("_best.state", F.lit("pending")).alias("state"))


def review_counts(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows (state, n): all rows are pending until decided."""
    state = F.coalesce("state", F.lit("pending")).alias("state")
    return rows.select("row_id").join(decided, "row_id", "left").groupBy(state).agg(F.count("*").alias("n"))


def replay(occurrences: DataFrame, events: list[dict], most: int = 1000, most_targets: int = 100_000) -> DataFrame:
    """occurrences (occurrence_id, entity_id) after ordered corrections: confirm joins a group's entities under the
    least, split gives an occurrence an entity of its own, reject leaves an entity out until a later confirm takes it up;
    reject_assertion changes no entity (see reject_assertions).

    The log is control data of a bounded size: it is read once, on the driver, into what became of each occurrence and each entity that
    it names, and two small tables are joined to the occurrences, however many corrections there are. An event with a
    version must have its place in the log, counted from 0. An entity that was joined to another is none any more: naming it is
    an error, as are an unknown kind, an empty event, and a log beyond the limits.
    """
    if len(events) > most or sum(len(v) for e in events for v in e.values() if isinstance(v, (list, tuple, set))) > most_targets:
        raise ValueError(f"more than {most} corrections or {most_targets} targets")
    joined: dict[str, str] = {}  # an entity, and the one it was joined to
    split: dict[str, str] = {}  # an occurrence, and the entity that its last split gave it
    gone: set[str] = set()
    used: set[str] = set()  # names that splits gave
    for number, e in enumerate(events):
        if e.get("version", number) != number:
            raise ValueError(f"correction {number} has another version")
        targets = list(dict.fromkeys(e.get({"split": "occurrences", "reject_assertion": "assertions"}.get(e["kind"], "entities"), ())))
        if e["kind"] not in ("confirm", "split", "reject", "reject_assertion") or not targets:
            raise ValueError(f"unknown or empty correction {e['kind']!r}")
        if e["kind"] in ("confirm", "reject") and any(x in joined for x in targets):
            raise ValueError(f"correction {number} names an entity that is none any more")
        if e["kind"] == "confirm":
            joined |= {x: min(targets) for x in targets if x != min(targets)}
            gone -= set(targets)
        elif e["kind"] == "reject":
            gone |= set(targets)
        elif e["kind"] == "split":
            for x in targets:
                own = f"SPLIT_{x}"
                split[x] = own if own not in used else f"{own}_{number}"
                used.add(split[x])

    def now(entity: str) -> str:
        while entity in joined:
            entity = joined[entity]
        return entity

    spark = occurrences.sparkSession
    own = spark.createDataFrame([(o, now(e)) for o, e in split.items()], "occurrence_id string, _own string")
    other = spark.createDataFrame([(e, now(e)) for e in joined], "entity_id string, _joined string")
    out = spark.createDataFrame([(e,) for e in sorted(gone)], "entity_id string")
    kept = [c for c in occurrences.columns if c != "entity_id"]
    moved = occurrences.join(F.broadcast(own), "occurrence_id", "left").join(F.broadcast(other), "entity_id", "left")
    entity = F.coalesce("_own", "_joined", "entity_id")
    return moved.select(*kept, entity.alias("entity_id")).join(F.broadcast(out), "entity_id", "left_anti").select(occurrences.columns)


def reject_assertions(facts: DataFrame, events: list[dict], key: str = "evidence_id") -> DataFrame:
    """facts without those that a reject_assertion of the log names."""
    ids = sorted({x for e in events if e["kind"] == "reject_assertion" for x in e["assertions"]})
    return facts.join(F.broadcast(facts.sparkSession.createDataFrame([(x,) for x in ids], f"{key} string")), key, "left_anti")


def dependency_edges(cells: DataFrame, primary: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Rows (src, dst): documents that must be worked out together, each with the least one of the same dependency.

    cells (document_id, role, entity_type, namespace, value) and primary (document_id, entity_type, namespace), the
    key of each document's template: documents depend on each other that share a key's value, an identity or label
    of the same primary key (compared folded, empty ones do not count), or quasi-identifiers of one primary key.
    anchors (correction_id, document_id) join the documents of a standing correction.
    """
    own = primary.select("document_id", F.col("entity_type").alias("_t"), F.col("namespace").alias("_s"))
    compared = F.col("role").isin("identity", "label")
    c = cells.filter(compared | F.col("role").isin("key", "quasi")).join(own, "document_id")
    # keys are compared as they are, and only the others pass through Python; all move as a short digest
    c = c.filter(compared).withColumn("_v", folded("value")).unionByName(c.filter(~compared).withColumn("_v", F.lit("")))
    part = lambda kind, *cols: digest(F.lit(kind), *[F.coalesce(x, F.lit("")) for x in cols])
    empty = F.lit("")
    key = (
        F.when(F.col("role") == "key", part("key", F.col("entity_type"), F.col("namespace"), F.col("value")))
        .when(F.col("role").isin("identity", "label") & (F.col("value") != ""), part("label", F.col("_t"), F.col("_s"), F.col("_v")))
        .when(F.col("role") == "quasi", part("cohort", F.col("_t"), F.col("_s"), empty))
    )
    rows = c.select("document_id", key.alias("key"))
    if anchors is not None:
        rows = rows.unionByName(anchors.select("document_id", part("correction", F.col("correction_id").cast("string"), empty, empty).alias("key")))
    rows = rows.filter("key is not null").distinct()
    # a window rather than a join with the least ones, so that the keys are made once
    return rows.select(F.min("document_id").over(Window.partitionBy("key")).alias("src"), F.col("document_id").alias("dst")).distinct()


def dependency_components(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (document_id, component): the least document that dependencies lead to; a document without any is its own."""
    found = connected_components(edges).withColumnRenamed("node", "document_id")
    return documents.select("document_id").join(found, "document_id", "left").select("document_id", F.coalesce("component", "document_id").alias("component"))


def component_digests(members: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rows (component, digest) of members (document_id, component) and their revisions (document_id, revision): what a
    component's cached result is kept under, so that it is worked out again only if one of its documents changed."""
    named = members.join(revisions, "document_id", "left").select("component", F.concat_ws(":", F.col("document_id").cast("string"), "revision").alias("m"))
    one = named.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("m"))
    return one.select("component", F.sha2("m", 256).alias("digest"))


def expand_links(changes: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (id, parent, name, ...) for each name of a file: changes (id, n_links, ...) with links (id, parent, name). A file
    whose names are not as many as it says, or repeat, is an error: it changed while it was read."""
    per = links.groupBy("id").agg(F.count("*").alias("_n"), F.count_distinct("parent", "name").alias("_d"))
    wrong = changes.join(per, "id", "left").filter(~((F.coalesce("_n", F.lit(0)) == F.col("n_links")) & (F.coalesce("_d", F.lit(0)) == F.col("n_links"))))
    if not wrong.isEmpty():
        raise ValueError("hardlink count changed")
    return changes.drop("parent", "name").join(links.select("id", "parent", "name"), "id")
