"""One plan from a snapshot of nodes and its change journal to an inventory of paths, with what was left out and what came late."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .inventory import glob_pattern

#: Reasons of a change that touch names, links, boundaries or rights, as one mask.
STRUCTURAL = 0x100 | 0x200 | 0x1000 | 0x2000 | 0x10000 | 0x100000 | 0x800


@dataclass(frozen=True)
class Cursors:
    """Places in a journal: where the snapshot was begun, where it was complete, and where the names of files were read."""

    journal: str
    start: int
    end: int
    final: int


@dataclass(frozen=True)
class Built:
    """entries (id, parent, relpath, is_dir), counts (one row), and the cursors from which the next build goes on."""

    entries: DataFrame
    counts: DataFrame
    cursors: Cursors
    nodes: DataFrame


def _scope(nodes: DataFrame, markers: DataFrame, root, scope: str):
    """The id of the directory that a path names, each component by its exact name, else by its only one but for case."""
    at = root
    for part in filter(None, scope.split("/")):
        here = nodes.filter(F.col("id") == F.lit(at)).select("is_link").first()
        if here is None or here["is_link"] or not markers.filter(F.col("id") == F.lit(at)).isEmpty():
            raise ValueError("protected scope")
        found = nodes.filter((F.col("parent") == F.lit(at)) & F.col("is_dir") & (F.col("id") != F.lit(at)) & (F.lower("name") == part.lower())).select("id", "name").limit(3).collect()
        exact = [r for r in found if r["name"] == part] or found
        if len(exact) != 1:
            raise ValueError("the scope has changed")
        at = exact[0]["id"]
    return at


def build_inventory(nodes: DataFrame, journal: DataFrame, current: DataFrame, links: DataFrame, root, cursors: Cursors, *, known_journal: str, oldest: int = 0, excludes: tuple[str, ...] = (), scope: str = "", marker: str | None = None, most_levels: int = 4096) -> Built:
    """The inventory of root, or of the directory scope below it.

    nodes (id, parent, name, is_dir, is_link) are the snapshot begun at cursors.start; journal (usn, id, parent,
    name, reason) what changed since; current (nodes' columns) the changed nodes as they are now, without those
    that are gone; links (id, parent, name) all names of files. Changes between start and end replace or delete
    their nodes, however often they changed; a change that is not structural does nothing. Directories are admitted
    from the top, level by level: not by an excluded name, a link, or a marker file in them, and nothing is
    admitted below what is not. A file stands under each of its names that lies in an admitted directory. Changes between
    end and final are late where they touch an admitted or an unknown directory, or the marker: the inventory may be wrong then, and says so.

    An error is raised where changes may be missing (another journal, a start that is no longer kept, cursors out of order),
    where the scope is not one directory or protected, and beyond most_levels. A file without a name counts in errors, as late changes do
    once. Null names and parents lie in no directory. The counts are records, journal_updates, directories, link_names, excluded, reparse,
    protected, late_changes, errors.
    """
    if known_journal != cursors.journal or not oldest <= cursors.start <= cursors.end <= cursors.final:
        raise ValueError("journal gap")
    columns = ["id", "parent", "name", "is_dir", "is_link"]
    structural = journal.filter(F.col("reason").bitwiseAND(F.lit(STRUCTURAL)) != 0)
    changed = structural.filter((F.col("usn") >= cursors.start) & (F.col("usn") < cursors.end)).select("id").distinct()
    changed = materialize(changed, "changed")
    now = nodes.select(columns).join(changed, "id", "left_anti").unionByName(current.select(columns).join(changed, "id", "left_semi"))
    now = materialize(now, "nodes")
    marked = F.lower("name") == marker.lower() if marker else F.lit(False)
    markers = links.filter(marked).select(F.col("parent").alias("id")).unionByName(now.filter(marked).select(F.col("parent").alias("id"))).distinct()
    pattern = glob_pattern(list(excludes))
    selected = _scope(now, markers, root, scope)
    directories = now.filter(F.col("is_dir") & (F.col("id") != F.lit(selected)))
    top = now.filter(F.col("id") == F.lit(selected)).select("id", "parent", F.lit("").alias("relpath"), F.lit(False).alias("_excluded"), "is_link")
    # each level once: what its directories are called, and why one is not admitted
    levels, level = [], top
    for _ in range(most_levels):
        seen = level.join(markers.withColumn("_protected", F.lit(True)), "id", "left")
        why = F.when(F.col("_excluded"), "excluded").when(F.col("is_link"), "reparse").when(F.col("_protected"), "protected")
        seen = materialize(seen.select("id", "parent", "relpath", why.alias("why")), "level")
        if seen.isEmpty():
            break
        levels.append(seen)
        open_ = seen.filter("why is null").select(F.col("id").alias("parent"), F.col("relpath").alias("_above"))
        path = F.when(F.col("_above") == "", F.col("name")).otherwise(F.concat_ws("/", "_above", "name"))
        level = directories.join(open_, "parent").select("id", "parent", path.alias("relpath"), F.col("name").rlike(pattern).alias("_excluded"), "is_link")
    else:
        raise ValueError(f"more than {most_levels} levels")
    every = levels[0] if levels else materialize(top.select("id", "parent", "relpath", F.lit(None).cast("string").alias("why")), "level")
    for more in levels[1:]:
        every = every.unionByName(more)
    allowed = every.filter("why is null")
    files = now.filter(~F.col("is_dir"))
    under = allowed.select(F.col("id").alias("parent"), F.col("relpath").alias("_above"))
    path = F.when(F.col("_above") == "", F.col("name")).otherwise(F.concat_ws("/", "_above", "name"))
    named = links.join(files.select("id", "is_link"), "id").join(under, "parent").select("id", "parent", path.alias("relpath"), F.when(F.col("is_link"), "reparse").when(F.col("name").rlike(pattern), "excluded").alias("why"))
    named = materialize(named, "names")
    nameless = files.filter("not is_link").join(links.select("id"), "id", "left_anti").join(under.select("parent"), "parent", "left_semi")
    shown = named.filter("why is null").select("id", "parent", "relpath", F.lit(False).alias("is_dir"))
    entries = allowed.filter(F.col("id") != F.lit(selected)).select("id", "parent", "relpath", F.lit(True).alias("is_dir")).unionByName(shown)
    after = structural.filter((F.col("usn") >= cursors.end) & (F.col("usn") < cursors.final))
    kept = allowed.select(F.col("id").alias("parent"), F.lit(True).alias("_allowed"))
    known = now.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    late = after.join(kept, "parent", "left").join(known, "parent", "left").filter(marked | F.col("_allowed").isNotNull() | F.col("_known").isNull())
    n = lambda df, name: df.agg(F.count("*").alias(name))
    reasons = every.select("why").unionByName(named.select("why")).agg(*[F.count_if(F.col("why") == w).alias(w) for w in ("excluded", "reparse", "protected")])
    counts = n(nodes, "records")
    for one in (n(changed, "journal_updates"), n(allowed.filter(F.col("id") != F.lit(selected)), "directories"), n(shown, "link_names"), reasons, n(late, "late_changes"), n(nameless, "errors")):
        counts = counts.crossJoin(one)  # one row each
    counts = counts.withColumn("errors", F.col("errors") + (F.col("late_changes") > 0).cast("int"))
    return Built(entries, counts, replace(cursors, start=cursors.final, end=cursors.final), now)
