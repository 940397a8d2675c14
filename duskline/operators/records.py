"""Records by template: rows of CSV files and DOCX tables, lines of texts and DOCX paragraphs, as one table of named cells.

A template is bound to documents and says which fields a record has. Its fields become rows of a small table, so that
documents of any number, format and template are read in the same joins: no header is collected, nothing
is inferred. A document that does not fit its template has no cells and one fault that says why and where.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import strict_json
from .evidence import Field, Template, entity_key

#: Fixed values of the configuration's format.
VERSION, MOST_FILES, MOST_FIELDS = "d2-templates-1", 1000, 32
CELLS = ("document_id", "template", "part", "record", "quoted", "name", "value", "block_no", "at", "to", "start", "end", "row", "col")
#: Line ends as a text is cut into lines; only CR and LF are no part of a value.
_LINE = r"[^\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]*(?:\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]|$)"


@dataclass(frozen=True)
class Binding:
    """A file and the template of its records."""

    path: str
    template: Template
    encoding: str | None = None


def load_bindings(text: str) -> list[Binding]:
    """Bindings of a strict JSON configuration: unknown or repeated keys, a path bound twice, and more files or
    fields than the format allows are errors. Pages of PDF files cannot be bound."""
    config = strict_json(text, {"schema_version", "files"})
    if config.get("schema_version") != VERSION or not isinstance(config.get("files"), list) or not 1 <= len(config["files"]) <= MOST_FILES:
        raise ValueError("invalid template configuration")
    out: dict[str, Binding] = {}
    for item in config["files"]:
        if not isinstance(item, dict) or set(item) - {"path", "fields", "primary", "state_field", "default_state", "encoding", "source_view", "table_index", "pages"}:
            raise ValueError("unknown setting of a file")
        path, fields = item.get("path"), item.get("fields")
        if not isinstance(path, str) or path in out:
            raise ValueError("a path is missing or bound twice")
        if item.get("pages"):
            raise ValueError("pages are not supported")
        if not isinstance(fields, list) or not 1 <= len(fields) <= MOST_FIELDS or any(not isinstance(f, dict) or set(f) - {"name", "role", "namespace", "entity_type", "values"} or not f.get("name") for f in fields):
            raise ValueError("unknown setting of a field")
        made = tuple(Field(f["name"], f.get("role", ""), f.get("namespace", ""), f.get("entity_type", "client"), tuple(f.get("values", ()))) for f in fields)
        if any(f.role == "sensitive" and not f.values for f in made):
            raise ValueError("a sensitive field needs its allowed values")
        state = item.get("default_state", "positive")
        if state not in Template.__dataclass_fields__["states"].default or item.get("state_field") in [f.name for f in made]:
            raise ValueError("invalid state")
        t = Template(item.get("primary"), made, item.get("state_field"), state, view=item.get("source_view"), table=item.get("table_index"))
        out[path] = Binding(path, t, item.get("encoding"))
    return list(out.values())


def bound(documents: DataFrame, bindings: list[Binding]) -> tuple[DataFrame, list[Template]]:
    """Rows (document_id, template) of documents (document_id, path) whose path is bound, and the templates by number."""
    templates = list(dict.fromkeys(b.template for b in bindings))
    rows = [(b.path, templates.index(b.template)) for b in bindings]
    named = documents.sparkSession.createDataFrame(rows, "path string, template int")
    return documents.join(F.broadcast(named), "path").select("document_id", "template"), templates


def _fields(spark, templates: list[Template]) -> DataFrame:
    """Rows (template, name, field_no, role, namespace, entity_type, allowed, is_primary, is_state): as many as the configuration has."""
    rows = []
    for t, template in enumerate(templates):
        for i, f in enumerate(template.fields):
            rows.append((t, f.name, i, f.role, f.namespace, f.entity_type, list(f.values), f.name == template.primary, False))
        if template.state_field and template.state_field not in [f.name for f in template.fields]:
            rows.append((t, template.state_field, len(template.fields), "state", "", "", [], False, True))
    return spark.createDataFrame(rows, "template int, name string, field_no int, role string, namespace string, entity_type string, allowed array<string>, is_primary boolean, is_state boolean")


def _grid(picked: DataFrame, bound_: DataFrame, fields: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Cells under the headers of CSV files and DOCX tables, and faults of headers and rows."""
    grid = picked.filter("grid and row is not null")
    head = grid.filter("row = 0").select("document_id", "template", "col", F.col("text").alias("name"))
    shape = head.groupBy("document_id").agg(F.count("*").alias("n"), F.count_distinct("name").alias("d"))
    fault = lambda df, reason, row, detail: df.select("document_id", F.lit(reason).alias("reason"), row.cast("long").alias("row"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    documents = picked.filter("grid").select("document_id", "template").distinct()
    wanted = documents.join(F.broadcast(fields.select("template", "name")), "template")
    lacking = wanted.join(head.select("document_id", "name"), ["document_id", "name"], "left_anti")
    # rows by width and last column: few for each document, whatever its length
    widths = grid.filter("row > 0").groupBy("document_id", "row").agg(F.count("*").alias("n"), (F.max("col") + 1).alias("last"))
    widths = widths.groupBy("document_id", "n", "last").agg(F.min("row").alias("row"))
    odd = widths.join(shape.select("document_id", F.col("n").alias("_n")), "document_id").filter((F.col("n") != F.col("_n")) | (F.col("last") != F.col("n")))
    faults = [fault(shape.filter("n != d"), "HEADER_REPEATS", none, none), fault(lacking, "FIELD_MISSING", none, F.col("name")), fault(odd, "ROW_WIDTH", F.col("row"), none)]
    place = head.join(F.broadcast(fields.select("template", "name")), ["template", "name"]).select("document_id", "col", "name").dropDuplicates(["document_id", "col"])
    body = grid.filter("row > 0").join(place, ["document_id", "col"])
    cells = body.select(
        "document_id", "template", F.coalesce("table_no", F.lit(0)).alias("part"), F.col("row").alias("record"), F.lit(False).alias("quoted"), "name", F.col("text").alias("value"),
        "block_no", F.lit(0).cast("long").alias("at"), F.length("text").cast("long").alias("to"), "start", "end", "row", "col")
    return cells, faults


def _lines(picked: DataFrame, fields: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Cells of name=value;name=value lines, a leading > marking a quoted one, and faults of lines."""
    key = F.when((F.col("role") == "key") & (F.instr("name", "=") == 0), F.concat("name", F.lit("=")))
    names = fields.groupBy("template").agg(F.array_sort(F.collect_list("name")).alias("_names"), F.collect_list(key).alias("_bare"))
    text = picked.filter("not grid and trim(text) != ''").join(F.broadcast(names), "template")
    line = text.select("document_id", "template", "_names", "_bare", "block_no", F.col("start").alias("_start"), F.posexplode(F.regexp_extract_all("text", F.lit(_LINE), F.lit(0))).alias("_i", "_line"))
    # a block is one value, so its lines are one task's in any case
    before = Window.partitionBy("document_id", "block_no").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("_at", F.coalesce(F.sum(F.length("_line")).over(before), F.lit(0)))
    line = line.withColumn("_raw", F.regexp_replace("_line", r"[\r\n]+$", "")).withColumn("quoted", F.startswith("_raw", F.lit(">")))
    line = line.withColumn("_body", F.when(F.col("quoted"), F.substring("_raw", 2, 1 << 30)).otherwise(F.col("_raw"))).filter("trim(_body) != ''")
    # parts, names and fault are one value with each step bound: the filters below are pushed under it, and would repeat what its steps refer to
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    called = lambda ps: F.transform(ps, lambda p: F.when(F.instr(p, "=") > 0, F.substring_index(p, "=", 1)))
    why = lambda n: (
        F.when(F.exists(n, lambda x: x.isNull()) | (F.size(F.array_except(n, "_names")) > 0), "NAME_UNKNOWN").when(F.size(n) != F.size(F.array_distinct(n)), "NAME_TWICE")
        .when(F.size(n) != F.size("_names"), "NAME_MISSING")
    )
    said = once(F.split("_body", ";", -1), lambda ps: once(called(ps), lambda n: F.struct(ps.alias("p"), why(n).alias("why"))))
    parts = line.withColumn("_said", said).select("*", F.col("_said.p").alias("_p"), F.col("_said.why").alias("_why"))
    # an empty key is seen in its line, so that faults need no cells; it stands at its first line in any block
    amiss = parts.withColumn("reason", F.coalesce("_why", F.when(F.arrays_overlap("_p", "_bare"), "EMPTY_KEY"))).filter("reason is not null")
    faults = amiss.groupBy("document_id", "reason").agg(F.min(F.struct("block_no", "_i")).alias("m"), F.min("_i").alias("_least"))
    # lines that fit have as many parts as the template has names
    past = lambda p, i: F.aggregate(F.slice("_p", 1, i), F.lit(0), lambda a, x: a + F.length(x) + 1)
    good = parts.filter("_why is null").select("*", F.explode(F.transform("_p", lambda p, i: F.struct(p.alias("p"), past(p, i).alias("o")))).alias("_c"))
    name = F.substring_index("_c.p", "=", 1)
    value = F.substr(F.col("_c.p"), F.length(name) + 2)
    at = F.col("_at") + F.col("quoted").cast("int") + F.col("_c.o") + F.length(name) + 1
    cells = good.select("document_id", "template", F.col("block_no").alias("part"), F.col("_i").cast("long").alias("record"), "quoted", name.alias("name"), value.alias("value"), "block_no", at.cast("long").alias("at"), (at + F.length(value)).cast("long").alias("to"), "_start")
    placed = cells.select(*CELLS[:10], (F.col("_start") + F.col("at")).alias("start"), (F.col("_start") + F.col("to")).alias("end"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("col"))
    empty = F.col("reason") == "EMPTY_KEY"
    row, detail = F.when(empty, F.col("_least")).otherwise(F.col("m._i")), F.when(~empty, F.col("m.block_no"))
    return placed, [faults.select("document_id", "reason", row.cast("long").alias("row"), detail.cast("string").alias("detail"))]


def extract(blocks: DataFrame, bound_: DataFrame, templates: list[Template]) -> tuple[DataFrame, DataFrame]:
    """Cells (document_id, template, part, record, quoted, name, value, block_no, at, to, start, end, row, col) and faults
    (document_id, reason, row, detail) of blocks as parse makes them, by bound_ (document_id, template).

    One row of cells is one field of one record. part and record name the record: a table's number and row, or a block's
    number and line. at and to are code points in the block, start and end in the document, null for a container;
    a cell of a quoted CSV value spans its quotes. Blank lines and blank CSV records are no records. An empty value is a cell.
    A document has faults where it was not read whole, its view does not fit its format, the table or text asked for is not
    there, a header repeats a name or lacks one, a row has another width or a gap, a line has an unknown, repeated or missing
    name, or a key is empty; then none of its cells are returned. Each reason stands once a document, at its
    first row, FIELD_MISSING once for each name. Columns of blocks beyond these are not read; documents bound to no template are not
    read; a bound document without blocks has the fault NOT_READ.
    """
    spark = blocks.sparkSession
    fields = _fields(spark, templates)
    views = spark.createDataFrame([(i, t.view, t.table) for i, t in enumerate(templates)], "template int, _view string, _table long")
    known = blocks.select("document_id", "block_no", "kind", "text", "start", "end", "row", "col", "table_no", "status", "reason")
    container = F.col("kind").isin("paragraph") | F.col("table_no").isNotNull()
    view = (F.col("_view").isNull() & F.col("kind").isin("cell", "text") & ~container) | ((F.col("_view") == "docx_table") & (F.col("table_no") == F.col("_table"))) | ((F.col("_view") == "docx_paragraphs") & (F.col("kind") == "paragraph"))
    joined = known.join(bound_, "document_id").join(F.broadcast(views), "template")
    joined = joined.select("*", container.alias("_container"), F.coalesce(view, F.lit(False)).alias("_picked"), F.coalesce(F.col("kind") == "cell", F.lit(False)).alias("grid"))
    picked_all = materialize(joined, "blocks")
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    per = picked_all.groupBy("document_id", "_view").agg(
        some(F.col("status").isin("failed", "unsupported") | ((F.col("status") == "partial") & ~F.coalesce("_container", F.lit(False)))).alias("bad"), F.max("reason").alias("why"),
        some("_container").alias("container"), some(F.col("kind").isNotNull()).alias("any"), some(F.col("_picked") & (F.col("grid") | (F.trim("text") != ""))).alias("picked"))
    reason = (
        F.when(F.col("bad"), "PARSING_INCOMPLETE").when(F.col("any") & (F.col("container") != F.col("_view").isNotNull()), "VIEW_DOES_NOT_FIT")
        .when(~F.col("any") & F.col("_view").isNull(), "HEADER_MISSING").when(~F.col("picked") & (F.col("_view") == "docx_table"), "TABLE_MISSING").when(~F.col("picked") & (F.col("_view") == "docx_paragraphs"), "TEXT_MISSING")
    )
    none = F.lit(None)
    whole = per.withColumn("_r", reason).filter("_r is not null").select("document_id", F.col("_r").alias("reason"), none.cast("long").alias("row"), F.when(F.col("bad"), F.col("why")).alias("detail"))
    unread = bound_.select("document_id").distinct().join(picked_all.select("document_id"), "document_id", "left_anti").select("document_id", F.lit("NOT_READ").alias("reason"), none.cast("long").alias("row"), none.cast("string").alias("detail"))
    picked = picked_all.filter("_picked")
    grid, grid_faults = _grid(picked, bound_, fields)
    lines, line_faults = _lines(picked, fields)
    cells = grid.select(*CELLS).unionByName(lines)
    keys = grid.filter("value = ''").join(F.broadcast(fields.filter("role = 'key'").select("template", "name")), ["template", "name"], "left_semi")
    empty = keys.groupBy("document_id").agg(F.min("record").alias("row")).select("document_id", F.lit("EMPTY_KEY").alias("reason"), "row", none.cast("string").alias("detail"))
    faults = whole.unionByName(unread).unionByName(empty)
    for more in [*grid_faults, *line_faults]:
        faults = faults.unionByName(more)
    faults = materialize(faults.groupBy("document_id", "reason", F.when(F.col("reason") == "FIELD_MISSING", F.col("detail")).alias("_d")).agg(F.min("row").alias("row"), F.min("detail").alias("detail")).drop("_d"), "faults")
    return cells.join(faults.select("document_id").distinct(), "document_id", "left_anti"), faults


def assertions(cells: DataFrame, templates: list[Template]) -> DataFrame:
    """Rows (document_id, source, target, kind, field_name, value, state, entity_type, namespace, block_no, at, to, start, end) of cells
    of any number of templates: what each says of the entity of its record's primary key, and where.

    The rules of states are those of evidence.assertions; empty values assert nothing.
    """
    spark = cells.sparkSession
    states = spark.createDataFrame([(i, t.default_state, list(t.states)) for i, t in enumerate(templates)], "template int, _default string, _states array<string>")
    c = cells.join(F.broadcast(_fields(spark, templates)), ["template", "name"]).join(F.broadcast(states), "template")
    record = Window.partitionBy("document_id", "part", "record")
    key = F.struct("value", "entity_type", "namespace")
    c = c.withColumn("_own", F.max(F.when(F.col("is_primary"), key)).over(record)).withColumn("_given", F.lower(F.trim(F.max(F.when(F.col("is_state"), F.col("value"))).over(record))))
    state = F.when(F.coalesce("_given", F.lit("")) == "", F.col("_default")).when(F.array_contains("_states", F.col("_given")), F.col("_given")).otherwise("unknown")
    state = F.when(F.col("quoted"), "quoted").otherwise(state)
    state = F.when((F.size("allowed") > 0) & ~F.array_contains("allowed", F.col("value")), "unknown").otherwise(state)
    is_key = F.col("role") == "key"
    said = c.filter("not is_primary and not is_state and value != ''")
    return said.select(
        "document_id", entity_key(F.col("_own.entity_type"), F.col("_own.namespace"), F.col("_own.value")).alias("source"), F.when(is_key, entity_key(F.col("entity_type"), F.col("namespace"), F.col("value"))).alias("target"),
        F.when(is_key, "relation").otherwise(F.col("role")).alias("kind"), F.col("name").alias("field_name"), F.when(~is_key, F.col("value")).alias("value"), state.alias("state"),
        F.col("_own.entity_type").alias("entity_type"), F.col("_own.namespace").alias("namespace"), "block_no", "at", "to", "start", "end")
