"""Documents from files: strict decoding, blocks of text, CSV cells and DOCX parts, coverage of each parse."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "document_id string, block_no long, kind string, text string, start long, end long, row long, col long, table_no long, status string, reason string"
#: Limits of a parse; what lies beyond makes it partial or failed, never silently shorter.
MAX_BYTES, MAX_ROWS, MAX_COLUMNS, MAX_CELL = 64 << 20, 1_000_000, 10_000, 1 << 20
#: Blocks that are handed on together, and bytes of the documents they are of, from which on they are.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
_BOMS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_CELL_END = re.compile(r"[,\r\n]")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_REFUSED = {"ins", "del", "moveFrom", "moveTo", "fldSimple", "instrText", "gridSpan", "vMerge"}


def read_files(spark: SparkSession, root: str, glob: str = "*", most_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows (document_id, path, content, length, reason): files below a folder; one that is too large keeps its row
    with a reason and without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    large = F.col("length") > most_bytes
    return files.select(F.sha2("path", 256).alias("document_id"), "path", F.when(~large, F.col("content")).alias("content"), "length", F.when(large, "FILE_TOO_LARGE").alias("reason"))


class Refused(ValueError):
    """A document that cannot be read whole; the message is its reason."""


def decode(payload: bytes, encoding: str | None = None) -> str:
    """The text of bytes: by its byte order mark, else as told, else UTF-8; nothing is replaced. A mark that is not
    of the encoding told, malformed bytes and NUL characters are refused."""
    marked = next((e for b, e in _BOMS if payload.startswith(b)), None)
    if marked and encoding and codecs.lookup(encoding).name.removesuffix("-sig").split("-")[:2] != marked.removesuffix("-sig").split("-")[:2]:
        raise Refused("ENCODING_CONFLICT")
    try:
        text = payload.decode(marked or encoding or "utf-8")
    except (UnicodeDecodeError, LookupError) as e:
        raise Refused("DECODE_FAILED") from e
    if "\0" in text:
        raise Refused("BINARY_TEXT")
    return text


def csv_cells(text: str) -> Iterator[tuple[int, int, str, int, int]]:
    """Cells (row, column, value, start, end) of comma-separated text with doubled quotes; places are code points.

    Ragged rows stay ragged, a blank record has no cell, a trailing comma ends with an empty one. A quote
    inside an open cell, or one that is never closed, is refused.
    """
    row = col = i = 0
    n = len(text)
    while i < n:
        if text[i] in "\r\n" and col == 0:
            i += 2 if text[i : i + 2] == "\r\n" else 1
            row += 1
            continue
        start = i
        if text[i : i + 1] == '"':
            value, i = [], i + 1
            while True:
                j = text.find('"', i)
                if j < 0:
                    raise Refused("CSV_OPEN_QUOTE")
                value.append(text[i:j])
                i = j + 1
                if text[i : i + 1] != '"':
                    break
                value.append('"')
                i += 1
            if i < n and text[i] not in ",\r\n":
                raise Refused("CSV_AFTER_QUOTE")
            cell = "".join(value)
        else:
            j = end.start() if (end := _CELL_END.search(text, i)) else n
            cell = text[i:j]
            if '"' in cell:
                raise Refused("CSV_BARE_QUOTE")
            i = j
        yield row, col, cell, start, i
        if i < n and text[i] == ",":
            i, col = i + 1, col + 1
            if i == n or text[i] in "\r\n":
                yield row, col, "", i, i
        if i < n and text[i] in "\r\n":
            i += 2 if text[i : i + 2] == "\r\n" else 1
            row, col = row + 1, 0


def docx_parts(payload: bytes) -> Iterator[tuple[str, str, int | None, int | None, int | None]]:
    """(kind, text, row, column, table) of paragraphs and simple table cells, tables counted from 0. Macros, tracked changes, fields and merged
    cells are refused: what they show depends on who looks."""
    try:
        with zipfile.ZipFile(io.BytesIO(payload)) as z:
            names = z.namelist()
            if any("vbaProject" in x for x in names):
                raise Refused("DOCX_MACRO")
            if sum(i.file_size for i in z.infolist()) > 4 * MAX_BYTES:
                raise Refused("CONTAINER_TOO_LARGE")
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise Refused("DOCX_MALFORMED") from e
    if any(x.tag.removeprefix(_W) in _REFUSED for x in root.iter()):
        raise Refused("DOCX_UNSUPPORTED_MARKUP")
    words = lambda x: "".join(t.text or "" for t in x.iter(f"{_W}t"))
    tables = 0
    for part in root.find(f"{_W}body"):
        if part.tag == f"{_W}p":
            yield "paragraph", words(part), None, None, None
        elif part.tag == f"{_W}tbl":
            for r, line in enumerate(part.findall(f"{_W}tr")):
                for c, cell in enumerate(line.findall(f"{_W}tc")):
                    yield "cell", words(cell), r, c, tables
            tables += 1


def _blocks(doc: str, path: str, payload: bytes, encoding: str | None) -> list[tuple]:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "docx":
        return [(doc, i, k, t, None, None, r, c, n, "partial", "CONTAINER") for i, (k, t, r, c, n) in enumerate(docx_parts(payload))]
    if kind not in ("txt", "md", "markdown", "csv"):
        return [(doc, *[None] * 8, "unsupported", "FORMAT")]
    text = decode(payload, encoding)
    if kind != "csv":
        return [(doc, 0, "text", text, 0, len(text), None, None, None, "complete", None)]
    out = []
    for row, col, cell, start, end in csv_cells(text):
        if row >= MAX_ROWS or col >= MAX_COLUMNS or len(cell) > MAX_CELL:
            return [(*x[:9], "partial", "CSV_LIMIT") for x in out]
        out.append((doc, len(out), "cell", cell, start, end, row, col, None, "complete", None))
    return out or [(doc, *[None] * 8, "complete", None)]


def parse(files: DataFrame, encoding: str | None = None) -> DataFrame:
    """Blocks of files (document_id, path, content): one for a text, one for each cell or paragraph. A document that
    cannot be read whole keeps a row, with its status and reason and without a block."""

    kinds = [pa.string() if c.endswith(" string") else pa.int64() for c in BLOCKS.split(", ")]
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # blocks of several documents are one batch: most documents have few
        rows, size = [], 0
        for b in batches:
            for doc, path, payload in zip(*(b.column(i) for i in range(3)), strict=True):
                doc, path, payload = doc.as_py(), path.as_py(), payload.as_py()
                try:
                    if payload is None:
                        raise Refused("NOT_CAPTURED")
                    made = _blocks(doc, path, payload, encoding)
                except Refused as e:
                    made = [(doc, *[None] * 8, "failed", str(e))]
                size += len(payload or b"")
                rows += made
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    for i in range(0, len(rows), BATCH_ROWS):
                        yield batch(rows[i : i + BATCH_ROWS])
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return files.select("document_id", "path", "content").mapInArrow(run, BLOCKS)


def path_blocks(entries: DataFrame) -> DataFrame:
    """The components of paths as blocks."""
    return entries.select(F.col("entry_id").alias("document_id"), F.posexplode("parts").alias("block_no", "text")).select("document_id", F.col("block_no").cast("long").alias("block_no"), F.lit("path_component").alias("kind"), "text")


def records(blocks: DataFrame, document_id: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows of one document's cells under its header. The header must have every field once; a row of another
    width is an error, undeclared columns stay."""
    cells = blocks.filter((F.col("document_id") == document_id) & (F.col("kind") == "cell"))
    bad = blocks.filter((F.col("document_id") == document_id) & (F.col("status") == "failed"))
    if not bad.isEmpty():
        raise ValueError("the document could not be read whole")
    head = [r.text for r in cells.filter("row = 0").orderBy("col").collect()]
    if len(set(head)) != len(head) or set(fields) - set(head):
        raise ValueError("the header repeats a name, or lacks a field")
    rows = cells.filter("row > 0").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    width = F.when(F.size("m") != len(head), F.raise_error(F.lit("a row has another width")).cast("map<bigint,string>")).otherwise(F.col("m"))
    return rows.select("row", width.alias("m")).select("row", *[F.col("m")[F.lit(i).cast("long")].alias(h) for i, h in enumerate(head)])


def coverage(blocks: DataFrame) -> DataFrame:
    """Rows (document_id, status, reason, n_blocks)."""
    return blocks.groupBy("document_id").agg(F.max("status").alias("status"), F.max("reason").alias("reason"), F.count("block_no").alias("n_blocks"))
