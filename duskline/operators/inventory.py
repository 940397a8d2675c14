"""Path inventories: entries, filters on subtrees, ancestor sizes, parents, pages and listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicon import Rules, expand_terms

_RESERVED = "(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\\..*)?$"


def entries(paths: DataFrame, relpath: str = "relpath", is_dir: str | None = "is_dir", size: str | None = "size") -> DataFrame:
    """Rows (entry_id, relpath, parts, is_dir, depth, size) of a table with a path column.

    Ids are digests of the path: equal within a run, of no use to guess others. Directories have size 0.
    """
    path = F.col(relpath)
    parts = F.split(path, "/")
    directory = F.col(is_dir) if is_dir else F.lit(False)
    bytes_ = F.when(directory, 0).otherwise(F.coalesce(F.col(size), F.lit(0)) if size else 0).cast("long")
    return paths.filter(path.isNotNull()).select(
        F.sha2(F.concat_ws("\x1f", F.lit("entry"), path), 256).alias("entry_id"), path.alias("relpath"), parts.alias("parts"), directory.alias("is_dir"), F.size(parts).alias("depth"), bytes_.alias("size"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder, by Spark's binary source without their content: (relpath, is_dir, size)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").removeprefix("file://")) + "/", "")
    return files.select(relative.alias("relpath"), F.lit(False).alias("is_dir"), F.col("length").alias("size"))


def valid_path(path: Column) -> Column:
    """Relative, no empty, dot or reserved component, no drive, stream, backslash or trailing blank."""
    bad = F.exists(F.split(path, "/"), lambda p: (p == "") | p.isin(".", "..") | p.rlike(_RESERVED) | p.rlike(r"[\\:\x00]|[ .]$"))
    return path.isNotNull() & ~bad


def duplicate_targets(df: DataFrame, path: str) -> DataFrame:
    """Paths that more than one row claims, letter case aside."""
    return df.groupBy(F.lower(path).alias("target")).agg(F.count("*").alias("n")).filter("n > 1")


#: Pieces of a glob: a class that is closed, a star, a mark, any other sign. A bracket that is never closed is itself.
_GLOB = re.compile(r"\[(?P<not>!?)(?P<set>\]?[^\]]*)\]|(?P<many>\*+)|(?P<one>\?)|(?P<sign>.)", re.DOTALL)


def glob_pattern(globs: list[str]) -> str:
    """One case-insensitive pattern for all globs, as names are matched by them."""

    def piece(m: re.Match) -> str:
        if m["set"]:
            low, *rest = re.split(r"(?<=.)-(?=.)", m["set"], flags=re.DOTALL)
            body = re.escape(low) + "".join("-" + re.escape(x) for x in rest)
            return f"[{'^' * bool(m['not'])}{body}]"
        return ".*" if m["many"] else "." if m["one"] else re.escape(m[0])

    return "(?isu)^(?:" + "|".join(_GLOB.sub(piece, g) for g in globs) + r")\z" if globs else "(?!)"


def drop_excluded(df: DataFrame, globs: list[str]) -> DataFrame:
    """Entries of which no component, their own name included, matches a glob: a match prunes its subtree."""
    pattern = glob_pattern(globs)
    return df.filter(~F.exists("parts", lambda p: p.rlike(pattern)))


def hide(df: DataFrame, terms: list[str]) -> DataFrame:
    """With hidden: a directory whose name holds a term stays, hidden, with the bytes below it as its size; what is
    below it goes."""
    pattern = "(?iu)" + "|".join(re.escape(t) for t in expand_terms(terms)) if terms else "(?!)"
    marks = F.transform("parts", lambda p: p.rlike(pattern))
    named = df.withColumn("_first", F.array_position(marks, True))
    inside = (F.col("_first") > 0) & (F.col("_first") < F.col("depth"))
    root = F.array_join(F.slice("parts", 1, F.col("_first").cast("int")), "/")
    below = named.filter(inside & ~F.col("is_dir")).groupBy(root.alias("relpath")).agg(F.sum("size").alias("_below"))
    left = named.filter(~inside).withColumn("hidden", (F.col("_first") == F.col("depth")) & F.col("is_dir")).drop("_first").join(below, "relpath", "left")
    return left.withColumn("size", F.when(F.col("hidden"), F.coalesce("_below", F.lit(0))).otherwise(F.col("size"))).select(*df.columns, "hidden")


def drop_links(df: DataFrame, link: str = "is_link") -> DataFrame:
    """Entries that are no link and lie below none: links are never followed."""
    return _outside(df, df.filter(F.col(link)).select(F.col("relpath").alias("_root")))


def _outside(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries that are neither one of roots (_root) nor below one; the empty root holds all."""
    prefixes = df.select("entry_id", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.array_join(F.slice("parts", 1, i), "/")))).alias("_root"))
    return df.join(prefixes.join(roots.distinct(), "_root").select("entry_id").distinct(), "entry_id", "left_anti")


def drop_protected(df: DataFrame, marker: str) -> DataFrame:
    """Entries outside of every directory that holds the marker file, whatever is in it."""
    return _outside(df, df.filter(F.element_at("parts", -1) == marker).select(F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/").alias("_root")))


def limit_depth(df: DataFrame, most: int) -> DataFrame:
    """Entries of at most so many components. Apply after risk analysis: what is cut would count there."""
    return df.filter(F.col("depth") <= most)


def ancestors(df: DataFrame) -> DataFrame:
    """Rows (entry_id, ancestor, size, ...) for each directory above an entry; a root entry has none."""
    above = F.when(F.col("depth") > 1, F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda i: F.array_join(F.slice("parts", 1, i), "/")))
    return df.withColumn("ancestor", F.explode(above))


def directory_sizes(df: DataFrame) -> DataFrame:
    """Bytes and files below each directory, at any depth: rows (directory, total_size, n_files). A hidden directory
    counts with the bytes below it in those above it, and not as a file."""
    hidden = F.col("hidden") if "hidden" in df.columns else F.lit(False)
    counted = ancestors(df.filter(~F.col("is_dir") | hidden))
    return counted.groupBy(F.col("ancestor").alias("directory")).agg(F.sum("size").alias("total_size"), F.count_if(~F.col("is_dir")).alias("n_files"))


def parent_edges(df: DataFrame) -> DataFrame:
    """Rows (parent_id, entry_id) where an entry's directory is an entry itself."""
    child = df.filter("depth > 1").select("entry_id", F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/").alias("relpath"))
    return child.join(df.select(F.col("entry_id").alias("parent_id"), "relpath"), "relpath").select("parent_id", "entry_id")


def counts(df: DataFrame) -> DataFrame:
    """One row: files, directories and hidden directories."""
    hidden = F.col("hidden") if "hidden" in df.columns else F.lit(False)
    return df.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"), F.count_if(hidden).alias("hidden_dirs"))


def prepare(paths: DataFrame, rules: Rules) -> DataFrame:
    """The usual scan: entries, then excludes, then hidden directories."""
    return hide(drop_excluded(entries(paths), rules.prune), rules.hide)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next rows in key order after a value (None: from the start), of which one more than size tells of a further page."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def keyset_page_before(df: DataFrame, key: str, before, size: int) -> DataFrame:
    """The page that ends before a value, in key order."""
    return df.filter(F.col(key) < F.lit(before)).orderBy(F.col(key).desc()).limit(size).orderBy(key)


def offset_page(df: DataFrame, key: str, offset: int, size: int) -> DataFrame:
    return df.orderBy(key).offset(offset).limit(size)


def resolve_paths(nodes: DataFrame, root, most_levels: int = 4096) -> DataFrame:
    """Rows (id, path) of every node (id, parent, name) below root, level by level from the top.

    Nodes that no chain from the root reaches, those of cycles among them, are an error, as is a chain
    longer than most_levels.
    """
    from ..session import materialize

    level = nodes.filter(F.col("parent").eqNullSafe(F.lit(root)) & ~F.col("id").eqNullSafe(F.lit(root))).select("id", F.col("name").alias("path"))
    done = None
    for _ in range(most_levels):
        level = materialize(level, "level")
        if level.isEmpty():
            break
        done = level if done is None else done.unionByName(level)
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("_above"))
        level = nodes.join(above, "parent").select("id", F.concat_ws("/", "_above", "name").alias("path"))
    else:
        raise ValueError(f"a chain is longer than {most_levels}")
    found = done if done is not None else level
    lost = nodes.filter(~F.col("id").eqNullSafe(F.lit(root))).join(found.select("id"), "id", "left_anti")
    if not lost.isEmpty():
        raise ValueError("nodes that the root does not reach")
    return found


def names_in_allowed(nodes: DataFrame, allowed: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes (id, parent, name) of an allowed parent that have a row in names (id)."""
    return nodes.join(allowed.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi").join(names.select("id").distinct(), "id", "left_semi")


def flatten_tree(df: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """Entries in depth-first order with their row number; with `expanded` (directory), only what open directories show.

    The order is that of path arrays: a directory stands before what is in it, siblings by name.
    """
    shown = df
    if expanded is not None:
        closed = ancestors(df).join(expanded.select(F.col("directory").alias("ancestor")), "ancestor", "left_anti").select("entry_id").distinct()
        shown = df.join(closed, "entry_id", "left_anti")
    return number_rows(shown, "parts")


def number_rows(df: DataFrame, *order: str, kind: str = "int") -> DataFrame:
    """df with ordinal, its row number in an order: range slices, as many as a shuffle has partitions, are counted first, so no
    task holds all rows."""
    from ..session import materialize

    sliced = materialize(df.repartitionByRange(*order).withColumn("_s", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    past = sliced.groupBy("_s").agg(F.count("*").alias("_n")).select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_past"))  # one row for each range
    inner = F.row_number().over(Window.partitionBy("_s").orderBy(*order))
    return sliced.withColumn("_i", inner).join(F.broadcast(past), "_s").withColumn("ordinal", (F.col("_i") + F.col("_past")).cast(kind)).drop("_s", "_i", "_past")


def listing_json(df: DataFrame) -> DataFrame:
    """One JSON line for each entry: hidden only when true, a size label instead of the size where there is one."""
    label = F.col("size_label") if "size_label" in df.columns else F.lit(None).cast("string")
    hidden = F.when(F.col("hidden"), True) if "hidden" in df.columns else F.lit(None).cast("boolean")
    row = F.struct(F.col("relpath").alias("path"), F.when(F.col("is_dir"), "dir").otherwise("file").alias("type"), F.coalesce(label, F.col("size").cast("string")).alias("size"), hidden.alias("hidden"))
    return df.select(F.to_json(row).alias("value"))


def listing(df: DataFrame, root: str) -> DataFrame:
    """The listing as lines that make up one JSON object {root, stats, entries}: rows (ordinal, value) in path order, so
    that it can be written without being held in one place."""
    stats = counts(df).select(F.to_json(F.struct(F.col("files"), F.col("dirs"), F.col("hidden_dirs"))).alias("s"))
    label = F.col("size_label") if "size_label" in df.columns else F.lit(None).cast("string")
    hidden = F.when(F.col("hidden"), True) if "hidden" in df.columns else F.lit(None).cast("boolean")
    row = F.to_json(F.struct(F.col("relpath").alias("path"), F.when(F.col("is_dir"), "dir").otherwise("file").alias("type"), F.coalesce(label, F.col("size").cast("string")).alias("size"), hidden.alias("hidden")))
    body = number_rows(df.select("relpath", row.alias("value")), "relpath").select("ordinal", F.concat(F.when(F.col("ordinal") > 1, ",").otherwise(""), "value").alias("value"))
    head = stats.select(F.lit(0).alias("ordinal"), F.concat(F.lit('{"root":'), F.to_json(F.array(F.lit(root))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(root)))) - 2), F.lit(',"stats":'), "s", F.lit(',"entries":[')).alias("value"))
    tail = df.agg((F.count("*") + 1).cast("int").alias("ordinal")).select("ordinal", F.lit("]}").alias("value"))
    return head.unionByName(body).unionByName(tail).orderBy("ordinal")


def components(df: DataFrame, leaf_only: bool = False) -> DataFrame:
    """Rows (entry_id, component_index, part): all components of each path, or its last one."""
    if leaf_only:
        return df.select("entry_id", (F.col("depth") - 1).alias("component_index"), F.element_at("parts", -1).alias("part"))
    return df.select("entry_id", F.posexplode("parts").alias("component_index", "part"))


def in_scope(nodes: DataFrame, paths: DataFrame, private: str) -> DataFrame:
    """Nodes (id, ..., is_link) with a path from the root (paths: id, path), no link, and none of whose path's components
    is the private directory."""
    inside = F.exists(F.split("path", "/"), lambda p: F.lower(p) == private.lower())
    return nodes.filter(~F.col("is_link")).join(paths, "id").filter(~inside)


def batches(df: DataFrame, most_items: int, most_bytes: int) -> DataFrame:
    """df (relpath) with batch, for a model that takes so many paths and bytes at once: siblings stay together, a
    directory with more than fits is split. batch is (directory, number); a path that is too long by itself has none.

    Slices of a directory are cut by running sums of at most half the bytes, so none depends on the one before it.
    """
    size = F.octet_length("relpath")
    fits = df.withColumn("_p", F.regexp_replace("relpath", "/?[^/]*$", "")).withColumn("_s", F.when(size <= most_bytes, size))
    order = Window.partitionBy("_p").orderBy("relpath").rowsBetween(Window.unboundedPreceding, 0)
    # a slice of at most half the bytes and one path more, which is at most the rest
    half, items = max(1, most_bytes // 2), max(1, most_items // 2)
    running = fits.withColumn("_b", F.sum(F.when(F.col("_s") <= half, F.col("_s"))).over(order)).withColumn("_i", F.count("_s").over(order))
    alone = F.when(F.col("_s") > half, F.col("relpath"))
    number = F.struct(F.col("_p").alias("directory"), F.floor(F.coalesce("_b", F.lit(0)) / half).alias("bytes"), F.floor((F.col("_i") - 1) / items).alias("items"), alone.alias("alone"))
    return running.withColumn("batch", F.when(F.col("_s").isNotNull(), number)).drop("_p", "_s", "_b", "_i")


def tree_lines(df: DataFrame, width: int = 100, most: int = 50_000) -> list[str]:
    """A drawn tree of at most `most` entries; wide characters take two cells, long names end in an ellipsis."""
    import unicodedata

    rows = [tuple(r.parts) for r in df.select("parts").orderBy("parts").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} entries to draw")
    cells = lambda s: sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)
    kids: dict[tuple, list] = {}
    known = sorted({r[:i] for r in rows for i in range(1, len(r) + 1)})
    for p in known:
        kids.setdefault(p[:-1], []).append(p)
    out: list[str] = []

    def draw(p: tuple, lead: str) -> None:
        own = kids.get(p, [])
        for i, k in enumerate(own):
            last = i == len(own) - 1
            line = lead + ("└── " if last else "├── ") + k[-1]
            while cells(line) > width:
                line = line[:-2] + "…"
            out.append(line)
            draw(k, lead + ("    " if last else "│   "))

    draw((), "")
    return out


def ignore_names(flagged: DataFrame, existing: DataFrame) -> DataFrame:
    """Names to add to each directory's ignore list: flagged (parent, name) less existing (parent, name)."""
    new = flagged.groupBy("parent").agg(F.collect_set("name").alias("names"))
    old = existing.groupBy("parent").agg(F.collect_set("name").alias("old"))
    left = new.join(old, "parent", "left")
    add = F.array_sort(F.array_except("names", F.coalesce("old", F.array().cast("array<string>"))))
    return left.select("parent", add.alias("names")).filter(F.size("names") > 0)
