"""Records by template: customers as CSV files, orders as lines, suppliers as DOCX tables, some with faults."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import records as rc
from ..session import materialize, table
from ..sources import documents as dc
from .registry import query

#: Rows of a file; of the files of a table those whose number leaves a rest by FAULTY get the fault of that rest.
ROWS, FAULTY = 100, 9
_PERSON, _NATION, _EVENT = (ev.Field(n, "key", s, t) for n, s, t in (("cust", "customers", "person"), ("nation", "nations", "place"), ("ord", "orders", "event")))
_CSV = ev.Template("cust", (_PERSON, ev.Field("name", "identity"), ev.Field("seg", "quasi")))
_LINES = ev.Template("ord", (_EVENT, _PERSON, ev.Field("flag", "sensitive", values=("O", "F"))))
_TABLE = ev.Template("name", (ev.Field("name", "key", "suppliers", "person"), _NATION), view="docx_table", table=1)


def _file(rows, key, line, name):
    """One file of each ROWS keys: its lines in order of the key. A file has at most ROWS keys, whatever the input."""
    part = F.col(key).cast("long")
    grouped = rows.select(F.expr(f"{key} DIV {ROWS}").alias("b"), F.struct(part.alias("k"), line.alias("l")).alias("x")).groupBy("b").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return grouped.select(F.format_string(name, "b").alias("path"), "b", F.transform("x", lambda x: x["l"]).alias("lines"))


def _docx(frames):
    """DOCX files of rows of two cells, behind a table and a paragraph that nobody asked for."""
    par = lambda x: f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
    tbl = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{par(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    for pdf in frames:
        out = []
        for lines in pdf["lines"]:
            rows = [line.split("\t") for line in lines]
            payload = io.BytesIO()
            with zipfile.ZipFile(payload, "w") as z:
                body = tbl([["cover"]]) + par("names and places") + tbl(rows)
                z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
            out.append(payload.getvalue())
        yield pd.DataFrame({"path": pdf["path"], "content": out})


def _bound(spark, sf_dir):
    """Blocks of all files, what they are bound to, and the templates."""
    c, o, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    rest = F.col("b") % FAULTY
    csv = _file(c, "c_custkey", F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"')), "c_mktsegment"), "customer-%d.csv")
    head = F.when(rest == 1, "cust,name,name").when(rest == 2, "cust,name,part").when(rest == 3, "cust,name,seg,more").otherwise("cust,name,seg")
    csv = csv.select("path", F.encode(F.concat(head, F.lit("\n"), F.array_join("lines", "\n")), "utf-8").alias("content"))
    quoted = F.when(F.col("o_orderkey") % 5 == 0, ">").otherwise("")
    lines = _file(o, "o_orderkey", F.concat(quoted, F.format_string("ord=%d;flag=%s;cust=%d", "o_orderkey", "o_orderstatus", "o_custkey")), "orders-%d.txt")
    lines = lines.select("path", F.encode(F.concat(F.array_join("lines", "\r\n"), F.when(rest == 4, "\r\nord=1;flag=O").when(rest == 5, "\r\nord=1;flag=O;cost=2").otherwise("")), "utf-8").alias("content"))
    tables = _file(s, "s_suppkey", F.concat_ws("\t", "s_name", F.col("s_nationkey").cast("string")), "supplier-%d.docx")
    tables = tables.select("path", F.concat(F.array(F.when(rest == 0, "name\tnation").otherwise("name\tland")), "lines").alias("lines")).mapInPandas(_docx, "path string, content binary")
    files = csv.unionByName(lines).unionByName(tables).select(F.col("path").alias("document_id"), "path", "content")
    files = materialize(files, "files")
    kind = F.substring_index("path", ".", -1)
    bound = files.select("document_id", F.when(kind == "csv", 0).when(kind == "txt", 1).otherwise(2).alias("template"))
    return materialize(dc.parse(files), "parsed"), bound, [_CSV, _LINES, _TABLE]


_CELLS = f"""
SELECT 'customer-' || b || '.csv' AS document_id, 1 + row_number() OVER (PARTITION BY b ORDER BY c_custkey) - 1 AS record, false AS quoted, unnest(['cust', 'name', 'seg']) AS name, unnest([c_custkey::VARCHAR, c_name, c_mktsegment]) AS value
FROM (SELECT *, c_custkey // {ROWS} AS b FROM customer) WHERE b % {FAULTY} NOT IN (1, 2, 3)
UNION ALL
SELECT 'orders-' || b || '.txt', row_number() OVER (PARTITION BY b ORDER BY o_orderkey) - 1, o_orderkey % 5 = 0, unnest(['ord', 'flag', 'cust']), unnest([o_orderkey::VARCHAR, o_orderstatus, o_custkey::VARCHAR])
FROM (SELECT *, o_orderkey // {ROWS} AS b FROM orders) WHERE b % {FAULTY} NOT IN (4, 5)
UNION ALL
SELECT 'supplier-' || b || '.docx', row_number() OVER (PARTITION BY b ORDER BY s_suppkey), false, unnest(['name', 'nation']), unnest([s_name, s_nationkey::VARCHAR])
FROM (SELECT *, s_suppkey // {ROWS} AS b FROM supplier) WHERE b % {FAULTY} = 0"""


@query(_CELLS)
def templated_cells(spark, sf_dir):
    cells, _ = rc.extract(*_bound(spark, sf_dir))
    return cells.select("document_id", "record", "quoted", "name", "value")


@query(f"""
WITH c AS (SELECT c_custkey // {ROWS} AS b FROM customer GROUP BY 1), o AS (SELECT o_orderkey // {ROWS} AS b, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT s_suppkey // {ROWS} AS b FROM supplier GROUP BY 1)
SELECT 'customer-' || b || '.csv' AS document_id, unnest(CASE b % {FAULTY} WHEN 1 THEN ['FIELD_MISSING', 'HEADER_REPEATS'] WHEN 2 THEN ['FIELD_MISSING'] ELSE ['ROW_WIDTH'] END) AS reason,
  unnest(CASE b % {FAULTY} WHEN 1 THEN [NULL, NULL] WHEN 2 THEN [NULL] ELSE [1] END)::BIGINT AS row FROM c WHERE b % {FAULTY} IN (1, 2, 3)
UNION ALL SELECT 'orders-' || b || '.txt', CASE b % {FAULTY} WHEN 4 THEN 'NAME_MISSING' ELSE 'NAME_UNKNOWN' END, n FROM o WHERE b % {FAULTY} IN (4, 5)
UNION ALL SELECT 'supplier-' || b || '.docx', 'FIELD_MISSING', NULL FROM s WHERE b % {FAULTY} <> 0""")
def template_faults(spark, sf_dir):
    _, faults = rc.extract(*_bound(spark, sf_dir))
    return faults.select("document_id", "reason", "row")


@query(f"""
WITH a AS ({_CELLS})
SELECT 'identity' AS kind, 'positive' AS state, count(*) AS n FROM a WHERE name = 'name' AND document_id LIKE 'customer%'
UNION ALL SELECT 'quasi', 'positive', count(*) FROM a WHERE name = 'seg'
UNION ALL SELECT 'relation', CASE WHEN quoted THEN 'quoted' ELSE 'positive' END, count(*) FROM a WHERE name IN ('cust', 'nation') AND document_id NOT LIKE 'customer%' GROUP BY quoted
UNION ALL SELECT 'sensitive', CASE WHEN value NOT IN ('O', 'F') THEN 'unknown' WHEN quoted THEN 'quoted' ELSE 'positive' END AS s, count(*) FROM a WHERE name = 'flag' GROUP BY s""")
def templated_assertions(spark, sf_dir):
    blocks, bound, templates = _bound(spark, sf_dir)
    cells, _ = rc.extract(blocks, bound, templates)
    return rc.assertions(cells, templates).groupBy("kind", "state").agg(F.count("*").alias("n"))
