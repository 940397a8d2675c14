"""Records by template over CSV, DOCX tables, paragraphs and lines: cells with places, faults with reasons."""

import json
import time

import pytest
from pyspark.sql import functions as F

from duskline.operators import evidence as ev
from duskline.operators import records as rc
from duskline.sources import documents as dc
from tests.test_sources import docx

CONFIG = {
    "schema_version": "d2-templates-1",
    "files": [
        {"path": "p.csv", "primary": "id", "state_field": "st", "fields": [{"name": "id", "role": "key", "namespace": "n"}, {"name": "name", "role": "identity"}]},
        {"path": "l.txt", "primary": "id", "fields": [{"name": "id", "role": "key", "namespace": "n"}, {"name": "ev", "role": "key", "namespace": "e", "entity_type": "event"}]},
        {"path": "t.docx", "primary": "ev", "source_view": "docx_table", "table_index": 1, "fields": [{"name": "ev", "role": "key", "namespace": "e", "entity_type": "event"}, {"name": "flag", "role": "sensitive", "values": ["R", "A"]}]},
    ],
}


def para(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def tbl(rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def run(spark, files, bindings):
    rows = [(p, p, bytearray(b)) for p, b in files.items()]
    df = spark.createDataFrame(rows, "document_id string, path string, content binary")
    bound, templates = rc.bound(df.select("document_id", "path"), bindings)
    cells, faults = rc.extract(dc.parse(df).withColumn("extra", F.lit(1)), bound, templates)
    return cells, faults, templates


def test_three_formats_are_one_table(spark):
    csv = 'x,name,id,st\n1,"A, B",007,\n2,,008,negative\n\n3,Cé,009,odd\n'
    text = "id=007;ev=x=1\r\n\r\n>ev=y;id=008\n>  \nid=009;ev= z"
    table = docx(tbl([["no"]]) + para("between") + tbl([["flag", "ev"], ["R", "x=1"], ["Z", "y"]]))
    files = {"p.csv": csv.encode(), "l.txt": text.encode(), "t.docx": table}
    cells, faults, templates = run(spark, files, rc.load_bindings(json.dumps(CONFIG)))
    assert faults.collect() == []
    got = sorted((r.document_id, r.record, r["name"], r.value, r.quoted) for r in cells.collect() if r.document_id != "l.txt")
    assert got == sorted([
        *[("p.csv", i, n, v, False) for i, v3 in ((1, ("A, B", "007", "")), (2, ("", "008", "negative")), (4, ("Cé", "009", "odd"))) for n, v in zip(("name", "id", "st"), v3, strict=True)],
        *[("t.docx", i, n, v, False) for i, v2 in ((1, ("R", "x=1")), (2, ("Z", "y"))) for n, v in zip(("flag", "ev"), v2, strict=True)]])
    lines = [r for r in cells.collect() if r.document_id == "l.txt"]
    assert {(r.record, r["name"], r.value, r.quoted) for r in lines} == {(0, "id", "007", False), (0, "ev", "x=1", False), (2, "ev", "y", True), (2, "id", "008", True), (4, "id", "009", False), (4, "ev", " z", False)}
    for r in lines:
        assert text[r.start : r.end] == r.value and (r.at, r.to) == (r.start, r.end)
    for r in cells.filter("document_id = 'p.csv'").collect():
        assert csv[r.start : r.end].strip('"') == r.value
    said = {(r.document_id, r.kind, r.field_name, r.value, r.state) for r in rc.assertions(cells, templates).collect()}
    assert said == {
        ("p.csv", "identity", "name", "A, B", "positive"), ("p.csv", "identity", "name", "Cé", "unknown"), ("l.txt", "relation", "ev", None, "positive"), ("l.txt", "relation", "ev", None, "quoted"),
        ("t.docx", "sensitive", "flag", "R", "positive"), ("t.docx", "sensitive", "flag", "Z", "unknown")}


def test_assertions_are_those_of_one_table(spark):
    t = ev.Template("id", (ev.Field("id", "key", "n", "client"), ev.Field("to", "key", "m", "event"), ev.Field("q", "quasi", values=("a",))), state_field="st")
    rows = [("1", "x", "a", None), ("2", "y", "b", "Negative "), ("3", "z", "", "strange")]
    table = spark.createDataFrame(rows, "id string, to string, q string, st string")
    csv = "id,to,q,st\n" + "\n".join(",".join(v or "" for v in r) for r in rows)
    cells, faults, templates = run(spark, {"a.csv": csv.encode()}, [rc.Binding("a.csv", t)])
    cols = ["source", "target", "kind", "field_name", "value", "state", "entity_type", "namespace"]
    assert faults.count() == 0
    key = lambda df: sorted(map(str, df.select(cols).collect()))
    assert key(rc.assertions(cells, templates)) == key(ev.assertions(table, t, "a.csv"))


FAULTS = {
    "twice.csv": (b"id,ev,id\n1,2,3\n", {("HEADER_REPEATS", None, None)}),
    "lacks.csv": (b"id,other\n1,2\n", {("FIELD_MISSING", None, "ev")}),
    "nothing.csv": (b"", {("HEADER_MISSING", None, None)}),
    "ragged.csv": (b"id,ev\n1,2\n1\n1,2,3\n", {("ROW_WIDTH", 2, None)}),
    "key.csv": (b"id,ev\n1,2\n,3\n", {("EMPTY_KEY", 2, None)}),
    "open.csv": (b'id,ev\n1,"2\n', {("PARSING_INCOMPLETE", None, "CSV_OPEN_QUOTE")}),
    "unknown.txt": (b"id=1;ev=2\nid=1;x=2", {("NAME_UNKNOWN", 1, "0")}),
    "bare.txt": (b"hello", {("NAME_UNKNOWN", 0, "0")}),
    "twice.txt": (b"id=1;id=2", {("NAME_TWICE", 0, "0")}),
    "short.txt": (b"\n\nid=1", {("NAME_MISSING", 2, "0")}),
    "bytes.txt": (b"\xff\xff", {("PARSING_INCOMPLETE", None, "DECODE_FAILED")}),
    "plain.docx": (docx(para("id=1;ev=2")), {("VIEW_DOES_NOT_FIT", None, None)}),
    "x.bin": (b"a", {("PARSING_INCOMPLETE", None, "FORMAT")}),
    "blank.txt": (b" \n\n", set()),
}


def test_faults_say_why_and_where(spark):
    t = ev.Template("id", (ev.Field("id", "key", "n", "client"), ev.Field("ev", "key", "e", "event")))
    table = ev.Template("id", t.fields, view="docx_table", table=3)
    paras = ev.Template("id", t.fields, view="docx_paragraphs")
    files = {k: v[0] for k, v in FAULTS.items()} | {"good.csv": b"ev,id\n2,1\n", "far.docx": docx(para("x")), "mute.docx": docx(tbl([["a"]])), "good.docx": docx(para("id=1;ev=2") + para(" ") + para(">id=3;ev=4")), "csv.csv": b"id,ev\n1,2"}
    own = {"far.docx": table, "mute.docx": paras, "good.docx": paras, "csv.csv": table}
    cells, faults, _ = run(spark, files, [rc.Binding(p, own.get(p, t)) for p in files] + [rc.Binding("not there.csv", t)])
    got = {}
    for r in faults.collect():
        got.setdefault(r.document_id, set()).add((r.reason, r.row, r.detail))
    want = {k: v[1] for k, v in FAULTS.items() if v[1]} | {"far.docx": {("TABLE_MISSING", None, None)}, "mute.docx": {("TEXT_MISSING", None, None)}, "csv.csv": {("VIEW_DOES_NOT_FIT", None, None)}}
    assert got == want
    assert {(r.document_id, r.part, r["name"], r.value, r.quoted) for r in cells.collect()} == {
        ("good.csv", 0, "ev", "2", False), ("good.csv", 0, "id", "1", False), ("good.docx", 0, "id", "1", False), ("good.docx", 0, "ev", "2", False), ("good.docx", 2, "id", "3", True), ("good.docx", 2, "ev", "4", True)}


@pytest.mark.parametrize("change", [
    {"schema_version": "x"}, {"files": []}, {"more": 1}, {"files": [CONFIG["files"][0]] * 2}, {"files": [{**CONFIG["files"][0], "pages": [1]}]}, {"files": [{**CONFIG["files"][0], "table_index": 0}]},
    {"files": [{**CONFIG["files"][0], "primary": "name"}]}, {"files": [{**CONFIG["files"][0], "state_field": "name"}]}, {"files": [{**CONFIG["files"][0], "default_state": "maybe"}]},
    {"files": [{**CONFIG["files"][0], "fields": [{"name": "id", "role": "key", "namespace": "n"}, {"name": "s", "role": "sensitive"}]}]},
])
def test_configuration_is_strict(change):
    with pytest.raises(ValueError):
        rc.load_bindings(json.dumps(CONFIG | change))


def test_long_csv_without_carriage_returns_is_linear():
    took = []
    for n in (200_000, 800_000):
        text = "a,b\n" * n
        start = time.process_time()
        assert sum(1 for _ in dc.csv_cells(text)) == 2 * n
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0]


def test_blocks_of_several_documents_are_handed_on_together(spark, monkeypatch):
    monkeypatch.setattr(dc, "BATCH_ROWS", 7)
    files = [(f"{i}.csv", f"{i}.csv", bytearray(b'a,b\n%d,"x ""y"""\n' % i)) for i in range(40)] + [("n.txt", "n.txt", None), ("e.csv", "e.csv", bytearray(b"")), ("b.txt", "b.txt", bytearray(b"\xff"))]
    parsed = dc.parse(spark.createDataFrame(files, "document_id string, path string, content binary").coalesce(1))
    assert "MapInArrow" in parsed._jdf.queryExecution().executedPlan().toString()
    rows = parsed.collect()
    assert sorted((r.document_id, r.block_no, r.text, r.row, r.col) for r in rows if r.kind == "cell") == sorted((f"{i}.csv", k, t, k // 2, k % 2) for i in range(40) for k, t in enumerate(("a", "b", str(i), 'x "y"')))
    assert {(r.document_id, r.status, r.reason) for r in rows if r.kind is None} == {("n.txt", "failed", "NOT_CAPTURED"), ("e.csv", "complete", None), ("b.txt", "failed", "DECODE_FAILED")}


def test_empty_keys_of_lines_are_seen_without_cells(spark, monkeypatch):
    seen, write = {}, rc.materialize
    monkeypatch.setattr(rc, "materialize", lambda df, tag: seen.setdefault(tag, df) and write(df, tag))
    t = ev.Template("id", (ev.Field("id", "key", "n", "client"), ev.Field("ev", "key", "e", "event"), ev.Field("q", "quasi")))
    paras = ev.Template("id", t.fields, view="docx_paragraphs")
    files = {
        "late.txt": b"id=1;ev=2;q=\n\n>q=;ev=3;id=\nid=;ev=;q=4", "fine.txt": b"id==;ev=id=;q=", "both.txt": b"id=;ev=1;q=2\nid=1;ev=2",
        "p.docx": docx(para("id=1;ev=2;q=3") + para("id=1;ev=;q=3")), "c.csv": b"id,ev,q\n1,2,\n1,,3\n",
    }
    cells, faults, _ = run(spark, files, [rc.Binding(p, paras if p == "p.docx" else t) for p in files])
    assert {(r.document_id, r.reason, r.row, r.detail) for r in faults.collect()} == {
        ("late.txt", "EMPTY_KEY", 2, None), ("both.txt", "EMPTY_KEY", 0, None), ("both.txt", "NAME_MISSING", 1, "0"), ("p.docx", "EMPTY_KEY", 0, None), ("c.csv", "EMPTY_KEY", 2, None)}
    assert {(r["name"], r.value) for r in cells.collect()} == {("id", "="), ("ev", "id="), ("q", "")}
    # each line is cut once for the faults
    assert seen["faults"]._jdf.queryExecution().optimizedPlan().toString().count("posexplode(") == 1
