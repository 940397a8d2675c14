"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions only.

A sketch has three rows of cells. A digest goes to one cell of each row; a cell holds how many digests
it got, the xor of them and the xor of their check hashes. Two sketches subtract cell by cell, which
leaves the digests that differ; a cell with one digest left whose check agrees is read off and taken
out of its other cells, until the cells are empty or nothing more can be read. Where that fails, larger
sketches are tried: the digests are dealt to several tables by a part of their hash, those of the second
side with their count negative, so that a table is a difference from the start. What cannot be read off a
table goes to one with more cells; what even that one does not give is compared digest by digest, so the
difference is always whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells in each of three rows: of the fingerprint itself and the first tables, then of what stays in a table that
#: failed. They share no factor, so digests whose cells are the same in one are seldom so in the other.
WIDTH, WIDER = 8, 13
#: Digests that differ for each table on a retry, and rounds of peeling.
LOAD, ROUNDS = 9, 12
#: Paragraphs end at a line feed and at every sentence end, whatever follows it; a longer one is cut from its start on
#: into pieces of so many code points.
STOPS, FULL_STOPS, PIECE = ".!?|…", "。！？", 96
#: Documents in each slice of the id order, and quantiles of the ids between which slices are even in width.
SLICE, QUANTILES = 500, 256


def _let(name: str, value: str, body: str) -> str:
    # a fold over nothing: unlike an element of transform, what its last lambda gives is not copied
    return f"aggregate(CAST(array() AS ARRAY<INT>), {value}, ({name}, none) -> {name}, {name} -> {body})"


def _mask(check: str, width: int) -> str:
    """The digest's cells as bits, one in each row."""
    spots = [f"shiftleft(1L, CAST({t * width} + pmod(shiftrightunsigned({check}, {20 * t}), {width}) AS INT))" for t in range(3)]
    return f"({' | '.join(spots)})"


def _digests(text: str) -> str:
    # line feeds at all sentence ends by plain replacement, so that no pattern is looked for at each place
    for stop in STOPS:
        text = f"replace({text}, '{stop} ', '{stop}\\n')"
    for stop in FULL_STOPS:
        text = f"replace({text}, '{stop}', '{stop}\\n')"
    # hashed where they are cut, so that no text is copied from array to array
    cut = f"transform(regexp_extract_all(x, '(?s).{{1,{PIECE}}}', 0), y -> xxhash64(y))"
    keys = f"array_distinct(flatten(transform(split({text}, '\\n'), x -> IF(length(x) > {PIECE}, {cut}, IF(x = '', CAST(array() AS ARRAY<BIGINT>), array(xxhash64(x)))))))"
    pairs = f"transform({keys}, k -> named_struct('k', k, 'c', xxhash64(k, 7L)))"
    return _masked(pairs, WIDTH)


def _masked(digests: str, width: int) -> str:
    return f"transform({digests}, d -> named_struct('k', d.k, 'c', d.c, 'm', {_mask('d.c', width)}))"


def _cells(digests: str, width: int) -> str:
    put = "(s, p) -> IF(getbit(p.m, i) = 1Y, named_struct('i', s.i, 'n', s.n + 1, 'k', s.k ^ p.k, 'c', s.c ^ p.c), s)"
    # a column's structs are decoded at each look, so they are taken out of it once
    taken = f"transform({digests}, d -> named_struct('k', d.k, 'c', d.c, 'm', d.m))"
    return _let("ds", taken, f"transform(sequence(0, {3 * width - 1}), i -> aggregate(ds, named_struct('i', i, 'n', 0, 'k', 0L, 'c', 0L), {put}))")


def _minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('i', x.i, 'n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def _signed(digests: str, sign: int) -> str:
    return f"transform({digests}, d -> named_struct('n', {sign}, 'k', d.k, 'c', d.c, 'm', d.m))"


def _difference(signed: str, width: int) -> str:
    """The cells of one side less those of the other: digests of the second are put in with their count negative."""
    put = "(s, p) -> IF(getbit(p.m, i) = 1Y, named_struct('i', s.i, 'n', s.n + p.n, 'k', s.k ^ p.k, 'c', s.c ^ p.c), s)"
    return f"transform(sequence(0, {3 * width - 1}), i -> aggregate({signed}, named_struct('i', i, 'n', 0, 'k', 0L, 'c', 0L), {put}))"


def _left(cells: str) -> str:
    """The cells in which something is left: each knows its number, so the others need not be looked at again."""
    return f"filter({cells}, x -> x.n != 0 OR x.k != 0L OR x.c != 0L)"


def _peel(cells: str, width: int) -> str:
    """m, the digests read off a difference, and whether they are whole: no cell remains."""
    # digests are told apart as whole numbers, by their sign: structs would be compared one with another
    side = lambda n: f"transform(array_distinct(transform(filter(found, x -> x.n = {n}), x -> x.k)), k -> named_struct('n', {n}, 'k', k, 'c', xxhash64(k, 7L)))"
    found = _let("found", "filter(s.t, x -> abs(x.n) = 1 AND xxhash64(x.k, 7L) = x.c)", f"concat({side(1)}, {side(-1)})")
    pure = f"transform({found}, d -> named_struct('n', d.n, 'k', d.k, 'c', d.c, 'm', {_mask('d.c', width)}))"
    drop = "(y, p) -> IF(getbit(p.m, y.i) = 1Y, named_struct('i', y.i, 'n', y.n - p.n, 'k', y.k ^ p.k, 'c', y.c ^ p.c), y)"
    hit = "aggregate(pure, 0L, (z, p) -> z | p.m)"
    less = _let("at", hit, _left(f"transform(s.t, x -> IF(getbit(at, x.i) = 1Y, aggregate(pure, x, {drop}), x))"))
    after = f"named_struct('t', {less}, 'm', concat(s.m, transform(pure, p -> p.k)), 'go', true)"
    stop = "named_struct('t', s.t, 'm', s.m, 'go', false)"
    step = f"(s, r) -> IF(s.go, {_let('pure', pure, f'IF(size(pure) = 0, {stop}, {after})')}, s)"
    done = "s -> named_struct('m', s.m, 'whole', size(s.t) = 0)"
    start = f"named_struct('t', {_left(cells)}, 'm', CAST(array() AS ARRAY<BIGINT>), 'go', true)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, {step}, {done})"


def _table(signed: str) -> str:
    """Digests that differ in one table: by the first width; what stays in its cells by the wider, or one by one."""
    plus, minus = (f"transform(filter(w, p -> p.n = {n}), p -> p.k)" for n in (1, -1))
    plain = f"concat(array_except({plus}, {minus}), array_except({minus}, {plus}))"
    wide = f"transform(filter({signed}, p -> NOT array_contains(f.m, p.k)), p -> named_struct('n', p.n, 'k', p.k, 'c', p.c, 'm', {_mask('p.c', WIDER)}))"
    more = _let("w", wide, _let("f2", _peel(_difference("w", WIDER), WIDER), f"IF(f2.whole, f2.m, {plain})"))
    return _let("f", _peel(_difference(signed, WIDTH), WIDTH), f"IF(f.whole, f.m, concat(f.m, {more}))")


def _differing(a: str, b: str, cells_a: str, cells_b: str, load: int) -> str:
    """Digests that differ between a and b: read off the fingerprints, else off larger sketches with so many digests of both in each table."""
    none = "CAST(array() AS ARRAY<BIGINT>)"
    inner = f"aggregate(sequence(0, g2 - 1), n, (n2, y) -> concat(n2, {_let('h', 'filter(gs, p -> pmod(p.k DIV g, g2) = y)', _table('h'))}))"
    outer = _let("gs", "filter(both, p -> pmod(p.k, g) = x)", inner)
    tables = f"aggregate(sequence(0, g - 1), {none}, (n, x) -> {outer})"
    larger = _let("both", f"concat({_signed(a, 1)}, {_signed(b, -1)})", _let("g", f"CAST(ceil(sqrt(size(both) / {load})) AS INT)", _let("g2", f"CAST(ceil(size(both) / ({load} * g)) AS INT)", tables)))
    return _let("f0", _peel(_minus(cells_a, cells_b), WIDTH), f"IF(f0.whole, f0.m, {larger})")


def _likeness(a: str, b: str, differing: str) -> str:
    return f"IF(size({a}) + size({b}) = 0, 1D, 1D - size({differing}) / CAST(size({a}) + size({b}) AS DOUBLE))"


def _shown(digests: str, cells: str) -> str:
    return f"concat(CAST(size({digests}) AS STRING), ':', array_join(transform({cells}, x -> concat(hex(x.n), '.', hex(x.k), '.', hex(x.c))), ','))"


def with_next(docs: DataFrame, made: dict[str, str] | None = None) -> DataFrame:
    """docs (doc_id, text) with next_text: of the next document in descending doc_id, after the last the
    first. made are further columns, each made of text and those before it, worked out once for a row and
    given as next_ columns to the row before. Ids are cut at quantiles and between them into even slices, which are ordered each on its own; only the
    last document of a slice looks its successor up. Equal ids are ordered by text, both descending; null ids come last.
    """
    shares = ", ".join(str((i + 1) / QUANTILES) for i in range(QUANTILES - 1))
    low, high, n, cuts = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.expr(f"approx_percentile(doc_id, array({shares}), 10000)")).first()
    bounds = sorted({x for x in cuts or [] if low < x})  # each starts a quantile
    starts, ends = [low or 0, *bounds], [*bounds, (high or 0) + 1]
    steps = [min(1 << 62, max(1, (e - s) * SLICE * len(starts) // max(1, n))) for s, e in zip(starts, ends, strict=True)]
    whole = lambda xs: "array(" + ", ".join(f"{x}L" for x in xs) + ")"
    q = f"IF(doc_id IS NULL, -1, size(filter({whole(bounds) if bounds else 'CAST(array() AS ARRAY<BIGINT>)'}, x -> x <= doc_id)))"
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_q", F.expr(q))
    cut = cut.withColumn("_s", F.expr(f"IF(_q < 0, 0L, (doc_id - element_at({whole(starts)}, _q + 1)) DIV element_at({whole(steps)}, _q + 1))"))
    order = Window.partitionBy("_q", "_s").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    # made behind the first window, so that they do not move, and led by one more over the same rows
    made = made or {}
    make = lambda df: reduce(lambda df, x: df.selectExpr("*", f"{x[1]} AS {x[0]}"), made.items(), df)
    led = make(cut.withColumn("_next", F.lead("text").over(order)))
    if made:
        led = led.withColumn("_led", F.lead(F.struct(*made)).over(order))
    # one row for each slice: the text of the first document of the slice that follows, or of all
    heads = cut.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("_q", "_s", F.col("text").alias("_text"))
    ids = heads.select("_q", "_s")
    inside = ids.withColumn("_t", F.lead("_s").over(Window.partitionBy("_q").orderBy(F.col("_s").desc())))
    tops = ids.groupBy("_q").agg(F.max("_s").alias("_t2"))  # QUANTILES + 1 rows at most, as the windows over them
    around = tops.withColumn("_p", F.coalesce(F.lead(F.struct("_q", "_t2")).over(Window.orderBy(F.col("_q").desc())), F.max(F.struct("_q", "_t2")).over(Window.partitionBy(F.lit(1))))).select("_q", "_p")
    after = inside.join(F.broadcast(around), "_q").select("_q", "_s", F.when(F.col("_t").isNull(), F.col("_p._q")).otherwise(F.col("_q")).alias("_q2"), F.coalesce("_t", "_p._t2").alias("_s2"))
    bridge = after.join(heads.select(F.col("_q").alias("_q2"), F.col("_s").alias("_s2"), "_text"), ["_q2", "_s2"]).select("_q", "_s", "_text")
    if made:
        bridge = make(bridge.withColumnRenamed("_text", "text")).select("_q", "_s", F.col("text").alias("_text"), F.struct(*made).alias("_first"))
    # the rows of a slice are together already: this join moves no text
    more = [F.coalesce(f"_led.{x}", f"_first.{x}").alias(f"next_{x}") for x in made]
    return led.join(bridge, ["_q", "_s"]).select("doc_id", "text", F.coalesce("_next", "_text").alias("next_text"), *made, *more)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_paragraphs, differing_edited, differing_next: the digests, in order, that
    the edited and the next text do not share with it, as peeling recovers them.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next
    document. Likeness is 1 less the differing digests over the digests of both, so 1 for equal texts and
    0 where no paragraph is shared; two texts without paragraphs are alike. Null texts count as empty;
    repeated rows give rows of their own; an empty table gives none; other columns are not read.
    """
    edited = "concat(left(text, CAST(length(text) - length(text) DIV 2 AS INT)), left(next_text, CAST(length(text) DIV 2 AS INT)))"
    made = {"a": _digests("text"), "a_cells": _cells("a", WIDTH)}
    rows = with_next(docs, made).selectExpr("doc_id", "text", "a", "a_cells", "next_a AS z", "next_a_cells AS z_cells", f"{edited} AS edited")
    rows = rows.selectExpr("doc_id", "CAST(length(text) AS BIGINT) AS n_chars", "sha2(edited, 256) AS edited_sha256", "a", "a_cells", "z", "z_cells", f"{_digests('edited')} AS e")
    rows = rows.selectExpr("*", f"{_cells('e', WIDTH)} AS e_cells")
    loads = {"e": LOAD * 3 // 2, "z": LOAD}  # the edited text keeps about half of the digests, which cancel out
    rows = rows.selectExpr("*", *[f"array_sort({_differing('a', x, 'a_cells', f'{x}_cells', load)}) AS d{x}" for x, load in loads.items()])
    return rows.selectExpr(
        "doc_id", "n_chars", "edited_sha256", f"{_shown('a', 'a_cells')} AS fingerprint", f"{_shown('e', 'e_cells')} AS edited_fingerprint",
        f"{_likeness('a', 'e', 'de')} AS near_edited", f"{_likeness('a', 'z', 'dz')} AS near_next",
        "CAST(size(a) AS BIGINT) AS n_paragraphs", "de AS differing_edited", "dz AS differing_next",
    )
