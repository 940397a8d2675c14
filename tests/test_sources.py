import io
import zipfile

import pytest

from duskline.sources import documents as dc
from duskline.sources.tables import strict_json


def test_decoding_is_strict():
    assert dc.decode("é".encode("utf-16")) == "é"
    assert dc.decode("é".encode("utf-8-sig")) == "é"
    assert dc.decode("中".encode("gb18030"), "gb18030") == "中"
    for payload, enc in ((b"\xff\xfeA\x00\x00\x00"[:1] + b"\xff", None), (b"a\0b", None), ("é".encode("utf-16"), "utf-8")):
        with pytest.raises(dc.Refused):
            dc.decode(payload, enc)


def test_csv_cells_keep_what_is_there():
    text = 'id,name\n001,"a ""q"", b"\n\n2,\nx'
    assert [(r, c, v) for r, c, v, _, _ in dc.csv_cells(text)] == [(0, 0, "id"), (0, 1, "name"), (1, 0, "001"), (1, 1, 'a "q", b'), (3, 0, "2"), (3, 1, ""), (4, 0, "x")]
    assert all(text[s:e].strip('"').replace('""', '"') == v for _, _, v, s, e in dc.csv_cells(text))
    for bad in ('"open', '"a"b', 'a"b'):
        with pytest.raises(dc.Refused):
            list(dc.csv_cells(bad))


def test_csv_round_trips():
    import csv
    import random

    rng = random.Random(1)
    for _ in range(80):
        rows = [["".join(rng.choice('ab,"\n 0é') for _ in range(rng.randrange(1, 6))) for _ in range(3)] for _ in range(rng.randrange(1, 5))]
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL).writerows(rows)
        got = {}
        for r, c, v, _, _ in dc.csv_cells(out.getvalue()):
            got[r, c] = v
        assert got == {(i, j): v for i, row in enumerate(rows) for j, v in enumerate(row)}


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files_are_parsed_or_say_why(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "b.csv").write_text("id,v\n1,x\n2,y\n")
    (tmp_path / "c.docx").write_bytes(docx("<w:p><w:r><w:t>para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"))
    (tmp_path / "d.docx").write_bytes(docx("<w:ins><w:p/></w:ins>"))
    (tmp_path / "e.bin").write_bytes(b"\0")
    (tmp_path / "f.txt").write_bytes(b"\xff\xff")
    files = dc.read_files(spark, f"file://{tmp_path}").cache()
    blocks = dc.parse(files).cache()
    names = {r.document_id: r.path.rsplit("/", 1)[-1] for r in files.collect()}
    ids = {v: k for k, v in names.items()}
    got = {names[r.document_id]: (r.status, r.reason, r.n_blocks) for r in dc.coverage(blocks).collect()}
    assert got == {
        "a.txt": ("complete", None, 1), "b.csv": ("complete", None, 6), "c.docx": ("partial", "CONTAINER", 2), "d.docx": ("failed", "DOCX_UNSUPPORTED_MARKUP", 0),
        "e.bin": ("unsupported", "FORMAT", 0), "f.txt": ("failed", "DECODE_FAILED", 0),
    }
    assert {r.text for r in blocks.filter(blocks.document_id == ids["c.docx"]).collect()} == {"para", "cell"}
    rows = dc.records(blocks, ids["b.csv"], ("id",))
    assert {(r.id, r.v) for r in rows.collect()} == {("1", "x"), ("2", "y")}
    with pytest.raises(ValueError):
        dc.records(blocks, ids["b.csv"], ("missing",))


def test_json_is_strict():
    assert strict_json('{"a": 1}', {"a"}) == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', '{"b": 1}', "[]"):
        with pytest.raises(ValueError):
            strict_json(bad, {"a"})
