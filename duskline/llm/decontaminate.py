"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .textkit import MUL, U, Words, map_texts, mix

#: Fewest tokens of a tile and share of a test item's tokens that tiles must cover.
MIN_TILE, COVERAGE = 5, 0.75
#: Bytes of benchmark text up to which its seeds are sent to every task; beyond, seeds are joined. Bits of the table of
#: seeds that keeps other runs of the documents out of that join.
BROADCAST_BYTES, SEED_BITS = 8 << 20, 1 << 26
SCHEMA = "doc_id long, item_id long, n_tiles long, n_covered long, n_tokens long, coverage double"


def _runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of each run of k words in one text, and the run's first word among all words."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(n, U)
    for i in range(k):
        h = h * MUL + words.hash[i : i + n]
    inside = words.doc[:n] == words.doc[k - 1 :]
    at = np.flatnonzero(inside)
    return mix(h[at]), at


def karp_rabin(a: np.ndarray, b: np.ndarray, length: int, free_a: np.ndarray, free_b: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Equal unmarked runs of `length` word hashes in a and b, by rolling hash: starts i in a, ascending, each with the
    ascending starts j of its hash in b, from the first that is equal. Runs of one hash share one array, so a word that
    repeats costs no pairs."""

    def table(x, free):
        n = len(x) - length + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(sums[length : length + n] == sums[:n])
        # hash of each window from prefix sums: item n of either side has the power top - n
        s = np.concatenate([np.zeros(1, U), np.cumsum(x * powers[top - np.arange(len(x))])])
        return (s[at + length] - s[at]) * powers[at], at

    top = max(len(a), len(b))
    powers = np.cumprod(np.concatenate([[U(1)], np.full(top, MUL, U)]))
    ha, ia = table(a, free_a)
    hb, ib = table(b, free_b)
    order = np.argsort(hb, kind="stable")
    hb, ib = hb[order], ib[order]
    lo, hi = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
    out, starts = [], {}
    for i, x, y in zip(ia[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
        if x not in starts:  # once for all runs of this hash: up to the first that is equal
            first = next((n for n in range(x, y) if np.array_equal(a[i : i + length], b[ib[n] : ib[n] + length])), y)
            starts[x] = ib[first:y]
        if len(starts[x]):
            out.append((i, starts[x]))
    return out


def tile(item: np.ndarray, text: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: tiles (start in item, start in text, length), longest first, none overlapping.

    The longest run that is unmarked on both sides is found by bisection of the length with Karp-Rabin
    (a run of a length holds runs of all smaller ones), all of that length are marked from left to right,
    and so on until no run of `least` words is left. least is at most the item's length.
    """
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    least = max(1, min(least, len(item)))
    tiles, high = [], min(len(item), len(text))
    while high >= least:
        lo, hi, best = least, high, []
        while lo <= hi:
            mid = (lo + hi + 1) // 2
            got = karp_rabin(item, text, mid, free_i, free_t)
            if got:
                best, lo = got, mid + 1
                size = mid
            else:
                hi = mid - 1
        if not best:
            break
        passed: dict[int, int] = {}  # of each array of starts, those that marks have reached: they stay marked
        for i, starts in best:
            if not free_i[i : i + size].all():
                continue
            n = passed.get(id(starts), 0)
            while n < len(starts) and not free_t[starts[n] : starts[n] + size].all():
                n += 1
            passed[id(starts)] = n
            if n < len(starts) and np.array_equal(item[i : i + size], text[(j := int(starts[n])) : j + size]):
                free_i[i : i + size] = False
                free_t[j : j + size] = False
                tiles.append((i, j, size))
        high = size
    return tiles


def _near(text: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """The words of a text within reach of seed positions; a zero stands where others are left out."""
    keep = np.zeros(len(text) + 1, np.int64)
    np.add.at(keep, np.maximum(at - reach, 0), 1)
    np.add.at(keep, np.minimum(at + reach, len(text)), -1)
    inside = np.cumsum(keep)[:-1] > 0
    out = np.where(inside, text, U(0))
    drop = ~inside & np.concatenate([[False], ~inside[:-1]])
    return out[~drop]


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, least: int = MIN_TILE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, n_tiles, n_covered, n_tokens, coverage) of documents that hold a benchmark item.

    Words are what lies between ASCII blanks, A-Z lower-cased. Runs of `least` words of an item are its
    seeds; an item of fewer words is one seed. A document that shares a seed with an item is tiled with it,
    and the pair is returned if tiles cover at least `coverage` of the item's words, in whatever order the
    passages stand. Items of equal text are tiled once and all returned.

    Where the benchmark's bytes (null texts 0) are within broadcast_bytes, every task gets it; beyond, seeds of
    items and documents are joined by hash, and only pairs with enough of them bring their texts together. Null
    and empty texts share nothing; repeated rows give repeated results; null ids are kept; empty tables give no
    rows; other columns are not read. A very long text is tiled where seeds stand, in its whole length.
    """
    rows = _within(items, broadcast_bytes)
    if rows is not None:
        return _against(docs, rows, coverage, least)
    named = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")), "documents")
    return _joined(named, items, coverage, least).drop("_row")


def clean(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, least: int = MIN_TILE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that hold no benchmark item, as they are: what `contaminated` finds goes, row by row."""
    rows = _within(items, broadcast_bytes)
    if rows is not None:
        return _without(docs, rows, coverage, least)
    named = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    found = _joined(named, items, coverage, least).select("_row").distinct()
    return named.join(found, "_row", "left_anti").select(*docs.columns)


def _within(items: DataFrame, broadcast_bytes: int):
    """The benchmark as a broadcast, if its texts have no more bytes than that; else None."""
    sized = items.filter(F.octet_length("text") > 0).select("item_id", "text", F.octet_length("text").alias("_n"))
    if sized.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] > broadcast_bytes:
        return None
    return items.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in sized.select("item_id", "text").collect()])


def _seeds(words: Words, least: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, seed) of all texts: hashes of runs of each length, which is part of the hash."""
    docs, hashes = [], []
    for k in lengths:
        h, at = _runs(words, k)
        docs.append(words.doc[at])
        hashes.append(mix(h ^ U(k)))
    return np.concatenate(docs), np.concatenate(hashes)


def _joined(docs: DataFrame, items: DataFrame, coverage: float, least: int) -> DataFrame:
    """SCHEMA with _row for docs (doc_id, text, _row) against a benchmark of any size, by a join of seeds."""
    spark = docs.sparkSession
    bench = materialize(items.filter(F.octet_length("text") > 0).groupBy("text").agg(F.collect_list("item_id").alias("ids")).withColumn("_item", F.monotonically_increasing_id()), "benchmark")

    def of_items(t: pa.Table) -> pa.Table:
        words, keys = Words(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string())), t.column("_item").to_numpy()
        n = words.counts
        doc, h = _seeds(words, least, list(range(1, least + 1)))
        size = np.minimum(n[doc], least)
        # of a shorter item the whole, of others runs of `least` words
        own = np.concatenate([np.full((np.maximum(n - k + 1, 0)).sum(), k) for k in range(1, least + 1)]) == size
        pairs = np.unique(np.stack([doc[own].astype(U), h[own]]), axis=1)
        doc = pairs[0].astype(np.int64)
        return pa.table([pa.array(pairs[1].view(np.int64)), pa.array(keys[doc]), pa.array(np.minimum(n[doc], least)), pa.array(n[doc])], names=["h", "_item", "k", "need"])

    seeds = materialize(map_texts(bench.select("_item", "text"), of_items, "h long, _item long, k long, need long"), "seeds")
    lengths = sorted(r[0] for r in seeds.select("k").distinct().collect())  # `least` rows at most
    bit = F.pmod(F.col("h"), F.lit(SEED_BITS))
    marks = seeds.select((bit + 1).alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("m"))
    bits = np.zeros(SEED_BITS // 8, np.uint8)
    for k, m in marks.collect():  # SEED_BITS bits at most
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(m, np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def of_docs(t: pa.Table) -> pa.Table:
        words, keys = Words(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string())), t.column("_row").to_numpy()
        doc, h = _seeds(words, least, lengths) if lengths else (np.zeros(0, np.int64), np.zeros(0, U))
        at = (h.view(np.int64) % SEED_BITS).astype(np.int64)
        has = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        pairs, times = np.unique(np.stack([doc[has].astype(U), h[has]]), axis=1, return_counts=True)
        return pa.table([pa.array(pairs[1].view(np.int64)), pa.array(keys[pairs[0].astype(np.int64)]), pa.array(times)], names=["h", "_row", "n"])

    hits = map_texts(docs.select("_row", "text"), of_docs, "h long, _row long, n long")
    pairs = hits.join(seeds, "h").groupBy("_row", "_item").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
    # a tile of n words holds n - least + 1 seeds: fewer cannot cover enough
    pairs = materialize(pairs.filter(F.col("n") * least >= F.col("need") * coverage).select("_row", "_item"), "pairs")
    both = pairs.join(bench.select("_item", "ids", F.col("text").alias("item")), "_item").join(docs.select("_row", "doc_id", "text"), "_row")

    def tiled(t: pa.Table) -> pa.Table | None:
        a, b = (Words(t.column(c).combine_chunks()) for c in ("item", "text"))
        out = []
        for x, (need, text) in enumerate(zip(*(np.split(w.hash, np.cumsum(w.counts)[:-1]) for w in (a, b)), strict=True)):
            got = _covered(need, text, coverage, least)
            out += [(t.column("_row")[x].as_py(), t.column("doc_id")[x].as_py(), i, *got) for i in t.column("ids")[x].as_py()] if got else []
        if not out:
            return None
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(c, pa.float64() if n == 6 else pa.int64()) for n, c in enumerate(cols)], names=["_row", "doc_id", "item_id", "n_tiles", "n_covered", "n_tokens", "coverage"])

    return map_texts(both.select("_row", "doc_id", "ids", "item", "text"), tiled, "_row long, " + SCHEMA)


def _covered(need: np.ndarray, text: np.ndarray, coverage: float, least: int, at: np.ndarray | None = None) -> tuple | None:
    """(tiles, covered, words, coverage) of an item against a text near its seeds (at: their places); None if too few."""
    k = min(least, len(need))
    if at is None:
        run = lambda x: sum((x[i : len(x) - k + 1 + i] * powers[i] for i in range(k)), np.zeros(max(0, len(x) - k + 1), U))
        powers = np.cumprod(np.full(k, MUL, U))
        at = np.flatnonzero(np.isin(run(text), run(need)))
    if least * len(at) < coverage * len(need):
        return None  # a tile of n words holds n - least + 1 seeds: these are too few
    tiles = tile(need, _near(text, at, len(need) + least), least)
    covered = sum(x[2] for x in tiles)
    return (len(tiles), covered, len(need), covered / len(need)) if covered >= coverage * len(need) else None


class _Items:
    """The benchmark, ready for look-ups: words of each item, and its seeds by length."""

    def __init__(self, rows: list, least: int):
        ids: dict[str, list] = defaultdict(list)  # items of equal text are one
        for i, text in rows:
            ids[text].append(i)
        words = Words(pa.array(list(ids), pa.string()))
        ends = np.cumsum(words.counts)
        self.ids = list(ids.values())
        self.words = [words.hash[e - c : e] for e, c in zip(ends, words.counts, strict=True)]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        short = sorted({int(c) for c in words.counts if 0 < c < least} | {least})
        for k in short:
            h, at = _runs(words, k)
            item = words.doc[at]
            keep = words.counts[item] >= least if k == least else words.counts[item] == k
            h, item = h[keep], item[keep]
            order = np.argsort(h, kind="stable")
            self.seeds[k] = (h[order], item[order])


_HELD: list = []


def _found(t: pa.Table, rows, coverage: float, least: int) -> list[tuple]:
    """(document's place, item, tiles, covered, words of the item, coverage) of a slice's contaminated documents."""
    if _HELD[:1] != [rows]:
        _HELD[:] = [rows, _Items(rows.value, least)]  # one look-up table for each task
    items = _HELD[1]
    words = Words(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()))
    first = np.cumsum(words.counts) - words.counts
    pairs: dict[tuple[int, int], set] = defaultdict(set)
    for k, (seeds, owner) in items.seeds.items():
        h, at = _runs(words, k)
        lo, hi = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
        for x in np.flatnonzero(lo < hi):
            d = int(words.doc[at[x]])
            for item in owner[lo[x] : hi[x]].tolist():
                pairs[d, item].add(int(at[x] - first[d]))
    out = []
    for (d, item), at in sorted(pairs.items()):
        got = _covered(items.words[item], words.hash[first[d] : first[d] + words.counts[d]], coverage, least, np.array(sorted(at)))
        if got:
            out += [(d, i, *got) for i in items.ids[item]]
    return out


def _against(docs: DataFrame, rows, coverage: float, least: int) -> DataFrame:
    names = ["doc_id", "item_id", "n_tiles", "n_covered", "n_tokens", "coverage"]

    def work(t: pa.Table) -> pa.Table:
        out, ids = _found(t, rows, coverage, least), t.column("doc_id").to_pylist()
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        cols[0] = [ids[d] for d in cols[0]]
        return pa.table([pa.array(c, pa.float64() if n == "coverage" else pa.int64()) for n, c in zip(names, cols, strict=True)], names=names)

    return map_texts(docs.select("doc_id", "text"), work, SCHEMA)


def _without(docs: DataFrame, rows, coverage: float, least: int) -> DataFrame:
    def work(t: pa.Table) -> pa.Table:
        keep = np.ones(t.num_rows, bool)
        keep[[x[0] for x in _found(t, rows, coverage, least)]] = False
        return t.filter(pa.array(keep))

    return map_texts(docs, work, docs.schema)
