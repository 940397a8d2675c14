"""Exact near-duplicate join of documents under the Jaccard metric on word shingles.

Two documents are linked when their shingle sets are at most REACH apart. The join is a recursion of regions
around pivots, each with the window in which a linked document can still lie:

1. The outermost pivots are single shingles, in one order for all documents, frequent ones last. From a set,
   the one-shingle sets that lie in it are the nearest of all, and the first of them in the order are its
   pivots: of a linked pair the smaller set has 1/7 of its shingles at most outside of the other, the larger
   1/4, so the first 1/7 of the smaller (inner window) and the first 1/4 of the larger (outer window), and one
   more, have a shingle in common. A shingle that no set has in its inner window makes no region.
2. Inside a region documents are the pivots, several at once. Each document belongs to its nearest pivot (a
   Voronoi cell). By the triangle inequality a document can be linked with one of another cell only if it is at
   most twice REACH farther from that cell's pivot than from its own, and at most REACH farther than the cell's
   farthest document; such documents near the boundary are replicated to that cell. Cells with what was
   replicated to them are regions again. Pivots were measured against the whole region and leave it. Where the
   pivots do not part a region (its documents are about equally far from all), it stays whole for the next.

A region whose documents are known to hang together needs no more work, so a group of thousands of near
copies costs one round of distances to its pivots, not all pairs. Small regions are solved in one task; in
large ones all regions take a round together, each dealt to as many tasks as its sets need. Documents of equal
sets are one item throughout. Shingles are 64-bit hashes, sets are named by a 64-bit sum of them.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import materialize
from .textkit import MUL2, U, Words, distinct_pairs, map_texts, mix, pack, steps, trim, trimmed, unpack

#: Words in a shingle and least Jaccard similarity, in hundredths.
K, LEAST = 5, 75
REACH = 1 - LEAST / 100
#: A window is longer by this share of a set, so that linked sets share many of its shingles.
SPARE = 16
#: Slots of the table of frequent shingles, its size in every task; shingles in a message and a part.
SLOTS, MESSAGE, PART = 1 << 22, 1_500_000, 1_500_000
#: Documents and shingles in a region, and shingles in regions solved together, up to which one task takes them.
LEAF, WEIGHT, GATHER = 8000, 4_000_000, 600_000
#: Pivots of a region at once in a task, and in a round of large regions; what share of a region's pairs its cells may
#: have left together for it to be parted.
PIVOTS, WIDE, PARTED = 8, 48, 0.5
#: Places at which the rows of one key meet.
SALTS = 8


def shingle_sets(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document and hash of each distinct shingle, both ascending; size and name of each document's set."""
    words = Words(texts)
    h, doc = words.shingles(k)
    doc, h = distinct_pairs(doc, h)
    n = np.bincount(doc, minlength=len(words.counts)) if len(words.counts) else np.zeros(0, np.int64)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ MUL2), dtype=U)])
    ends = np.cumsum(n)
    return doc, h, n, mix(total[ends] - total[ends - n] + n.astype(U) * MUL2)


def _first_of(name: np.ndarray) -> np.ndarray:
    keep = np.zeros(len(name), bool)
    keep[np.unique(name, return_index=True)[1]] = True
    return keep


def _sizes(docs: DataFrame, keep: list[str]) -> DataFrame:
    fields = [f for f in docs.schema.fields if f.name in keep]

    def work(t: pa.Table) -> pa.Table:
        _, _, n, name = shingle_sets(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()))
        return pa.table([*[t.column(f.name) for f in fields], pa.array(n.astype(np.int64)), pa.array(name.view(np.int64))], names=[*[f.name for f in fields], "n_shingles", "set"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_texts(docs.select(*[f.name for f in fields], "text"), work, f"{schema}, n_shingles long, set long")


def _blob(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows, strict=True))
    return pa.table([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=names)


def _frequencies(docs: DataFrame, parts: int, shift: int) -> DataFrame:
    """Messages (part, h, n): the upper bits of shingles, and in how many of a task's documents each is."""
    drop = U(shift)

    def run(batches):
        held, size = [], 0

        def message():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            part = (h % U(parts)).astype(np.int64)
            for p in range(parts):
                at = part == p
                if at.any():
                    yield (p, pack(np.diff(h[at], prepend=U(0))), pack(n[at].astype(np.uint32)))

        for batch in batches:
            for t in steps(batch):
                _, h, _, _ = shingle_sets(t.column("text").combine_chunks())
                held.append(h >> drop)
                size += len(h)
                if size >= MESSAGE:
                    yield from _blob(list(message()), ["part", "h", "n"]).to_batches()
                    held, size = [], 0
                    trim()
        if size:
            yield from _blob(list(message()), ["part", "h", "n"]).to_batches()
        trim()

    return docs.select("text").mapInArrow(run, "part int, h binary, n binary")


def _frequent(t: pa.Table) -> pa.Table:
    """By power of two of their frequency, the shingles of a part that four documents or more share."""
    h = np.concatenate([np.cumsum(unpack(b, U), dtype=U) for b in t.column("h").to_pylist()])
    n = np.concatenate([unpack(b, np.uint32) for b in t.column("n").to_pylist()]).astype(np.int64)
    h, at = np.unique(h, return_inverse=True)
    n = np.bincount(at, n)
    power = np.log2(np.maximum(n, 1)).astype(np.int64)
    found = [(int(p), pack((mix(h[power == p]) % U(SLOTS)).astype(np.uint32)), int((power == p).sum())) for p in np.unique(power) if p >= 2]
    cols = list(zip(*found, strict=True)) if found else [[]] * 3
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], names=["power", "slots", "n"])


def frequency_bits(total: int) -> int:
    """Bits of a shingle by which it is counted: enough that few of `total` shingles fall together."""
    return min(48, max(24, int(total).bit_length() + 8))


def frequency_table(docs: DataFrame, parts: int, bits: int) -> np.ndarray:
    """A table of fixed size: for the slot of a shingle, the power of two of the frequency of the most frequent
    shingle there. Counted over all documents; only the order of shingles hangs on it, never a result. The
    rarest powers are left out until the rest fill an eighth of the slots at most."""
    found = materialize(_frequencies(docs, parts, 64 - bits).groupBy("part").applyInArrow(trimmed(_frequent), "power int, slots binary, n long"), "frequent")
    least, total = 64, 0
    for r in found.groupBy("power").agg(F.sum("n").alias("n")).orderBy(F.desc("power")).collect():  # one row for each power
        if (total := total + r["n"]) > SLOTS // 8:
            break
        least = r["power"]
    out = np.zeros(SLOTS, np.uint8)
    for r in found.filter(F.col("power") >= least).orderBy("power").collect():  # SLOTS // 8 slots at most
        slots = unpack(bytes(r["slots"]), np.uint32)
        out[slots] = np.maximum(out[slots], r["power"])
    return out


def windows(doc: np.ndarray, h: np.ndarray, n: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles are in their document's outer window, and which in its inner one: by frequency, then hash, the
    first n - ceil(3/4 n) + 1 and n - ceil(6/7 n) + 1, and n // SPARE more in both. Of linked documents, the outer
    window of the larger and the inner of the smaller share 1 + n // SPARE of the smaller's shingles or more."""
    rank = table[(mix(h >> U(64 - bits)) % U(SLOTS)).astype(np.int64)]
    order = np.lexsort((h, rank, doc))
    place = np.empty(len(doc), np.int64)
    place[order] = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    outer, inner = (n - -(-share * n // whole) + 1 + n // SPARE for share, whole in ((LEAST, 100), (2 * LEAST, 100 + LEAST)))
    return place < np.repeat(outer, n), place < np.repeat(inner, n)


def _windows(docs: DataFrame, parts: int, table, bits: int) -> DataFrame:
    """Messages (part, h, sets, idx): window shingles, by their upper 40 bits, with the place of their set among sets
    times two, and one more in the inner window."""

    def run(batches):
        held, size, known = [], 0, set()

        def message():
            h, name, inner = (np.concatenate([x[i] for x in held]) for i in range(3))
            part = (mix(h) % U(parts)).astype(np.int64)
            order = np.lexsort((name, h, part))
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                if len(at := order[ends[p] : ends[p + 1]]):
                    sets, idx = np.unique(name[at], return_inverse=True)
                    yield p, pack(np.diff(h[at], prepend=U(0))), pack(sets), pack((2 * idx + inner[at]).astype(np.uint32))

        for batch in batches:
            for t in steps(batch):
                doc, h, n, name = shingle_sets(t.column("text").combine_chunks())
                # equal sets once for each message
                fresh = _first_of(name) & (n > 0) & np.array([x not in known for x in name.tolist()], bool)
                known.update(name[fresh].tolist())
                outer, inner = windows(doc, h, n, table.value, bits)
                keep = outer & fresh[doc]
                held.append((h[keep] >> U(24), name[doc[keep]], inner[keep]))
                size += len(held[-1][0])
                if size >= MESSAGE:
                    yield from _blob(list(message()), ["part", "h", "sets", "idx"]).to_batches()
                    held, size, known = [], 0, set()
                    trim()
        if size:
            yield from _blob(list(message()), ["part", "h", "sets", "idx"]).to_batches()
        trim()

    return docs.select("text").mapInArrow(run, "part int, h binary, sets binary, idx binary")


def _regions(t: pa.Table) -> pa.Table:
    """Rows (region, set, n): shingles that two sets or more have in their windows, one of them in its inner window.
    Regions of the same sets come once, with their number."""
    h = np.concatenate([np.cumsum(unpack(b, U), dtype=U) for b in t.column("h").to_pylist()])
    idx = [unpack(i, np.uint32) for i in t.column("idx").to_pylist()]
    name = np.concatenate([unpack(s, U)[i >> 1] for s, i in zip(t.column("sets").to_pylist(), idx, strict=True)])
    inner = np.concatenate(idx) & 1
    order = np.lexsort((name, h))
    h, name, inner = h[order], name[order], inner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (name[1:] != name[:-1])]) if len(h) else np.zeros(0, bool)
    h, name, inner = h[new], name[new], inner[new]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(h)))
    has = np.maximum.reduceat(inner, first) > 0 if len(first) else np.zeros(0, bool)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(name), dtype=U)])
    ident = mix(sums[first + count] - sums[first] + count.astype(U) * MUL2)
    ident[~has] = 0
    _, once, times = np.unique(ident, return_index=True, return_counts=True)
    ok, n = np.zeros(len(first), bool), np.zeros(len(first), np.int64)
    ok[once], n[once] = True, times
    ok &= (count > 1) & has
    rows = np.repeat(ok, count)
    return pa.table([pa.array(np.repeat(ident[ok], count[ok]).view(np.int64)), pa.array(name[rows].view(np.int64)), pa.array(np.repeat(n[ok], count[ok]))], names=["region", "set", "n"])


class Groups:
    """Union-find over the items of a task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Task:
    """The items of a task: their shingles as numbers, one after another, and which items were pivots already."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.start = np.cumsum(self.size) - self.size
        self.mark, self.done = np.zeros(len(self.flat), bool), np.zeros(len(sets), bool)
        self.groups, self.links = Groups(), []

    def measure(self, pivot: int) -> np.ndarray:
        """Distances from the pivot to all items; what it is linked with joins its group."""
        own = self.flat[self.start[pivot] : self.start[pivot] + self.size[pivot]]
        self.mark[own] = True
        both = np.add.reduceat(self.mark[self.flat].astype(np.int32), self.start)
        self.mark[own] = False
        union = self.size[pivot] + self.size - both
        for x in np.flatnonzero(100 * both >= LEAST * union).tolist():
            if self.groups.join(pivot, x):
                self.links.append((pivot, x))
        self.done[pivot] = True
        return 1 - both / union


def cells(d: np.ndarray) -> np.ndarray:
    """Which items (columns) are in the window of each pivot's Voronoi cell (rows), by their distances."""
    nearest, own = d.min(0), np.argmin(d, 0)
    radius = np.array([d[q, own == q].max(initial=-1) for q in range(len(d))])
    return (d <= np.minimum(nearest[None] + 2 * REACH, radius[:, None] + REACH) + 1e-9) & (radius >= 0)[:, None]


def solve(region: list[int], task: Task) -> None:
    """Joins one region by pivots, cells and windows. A pivot is measured against all items of the task, so it is
    a pivot once, whatever regions it is in. Pivots are taken from the smallest groups that are left, one of each."""
    stack = [np.array(sorted(region))]
    while stack:
        rest = stack.pop()
        rest = rest[~task.done[rest]]
        if len(rest) < 2:
            continue
        group, first, count = np.unique([task.groups.find(i) for i in rest.tolist()], return_index=True, return_counts=True)
        if len(group) == 1:
            continue
        pivots = rest[first[np.argsort(count, kind="stable")[:PIVOTS]]]
        d = np.stack([task.measure(int(p)) for p in pivots])[:, rest]
        # of a pivot's group only what the nearest other item may reach can still matter
        group, keep = np.array([task.groups.find(i) for i in rest.tolist()]), np.ones(len(rest), bool)
        for q, p in enumerate(pivots.tolist()):
            of = group == task.groups.find(p)
            keep &= ~of | (d[q] >= (d[q, ~of].min() if not of.all() else 2.0) - REACH - 1e-9)
        keep &= ~task.done[rest]
        rest, d = rest[keep], d[:, keep]
        if len(rest) > 1:
            inside = cells(d)
            stack += [rest[x] for x in inside if x.sum() > 1] if (inside.sum(1) ** 2).sum() <= PARTED * len(rest) ** 2 else [rest]


def _solved(t: pa.Table) -> pa.Table:
    """Links found in one task's regions: rows (src, dst)."""
    names = t.column("set").to_pylist()
    task = Task([unpack(b, U) for b in t.column("shingles").to_pylist()])
    regions: dict[int, list[int]] = defaultdict(list)
    for i, rs in enumerate(t.column("regions").to_pylist()):
        for r in rs:
            regions[r].append(i)
    for r in sorted(regions, key=lambda r: (-len(regions[r]), r)):
        solve(regions[r], task)
    links = [(names[a], names[b]) for a, b in task.links if names[a] != names[b]]
    return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["src", "dst"])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (set, shingles) of the wanted documents and a few others: a bitmap of fixed size keeps the rest of the
    texts from being hashed again and from moving. Shingles are kept by 48 bits."""
    bit = F.pmod(F.xxhash64("_id"), F.lit(1 << 23))
    marks = wanted.select((bit + 1).alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("m"))
    bits = np.zeros(1 << 20, np.uint8)
    for k, m in marks.collect():  # 256 rows of 4 KB at most
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(m, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def work(t: pa.Table) -> pa.Table | None:
        b = t.column("b").to_numpy()
        t = t.filter(pa.array((shared.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1))
        if not t.num_rows:
            return None
        _, h, n, name = shingle_sets(t.column("text").combine_chunks())
        ends = np.cumsum(n)
        return pa.table([pa.array(name.view(np.int64)), pa.array([pack(h[e - c : e] >> U(16)) for e, c in zip(ends, n, strict=True)], pa.binary())], names=["set", "shingles"])

    return map_texts(docs.select(bit.alias("b"), "text"), work, "set long, shingles binary")


def _voronoi(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Rows (region, set, p, d, own, linked) for each set of rows (region, salt, set, shingles) and each pivot of
    pivots (region, salt, p, sp) in whose cell it is (own), to which it may be replicated, or with which it is linked."""

    def run(items: pa.Table, around: pa.Table) -> pa.Table:
        if not items.num_rows or not around.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_())], names=["region", "set", "p", "d", "own", "linked"])
        around = around.sort_by("p")
        names, ps = items.column("set").to_numpy(), around.column("p").to_numpy()
        task = Task([unpack(b, U) for b in items.column("shingles").to_pylist()] + [unpack(b, U) for b in around.column("sp").to_pylist()])
        d = np.stack([task.measure(len(names) + q)[: len(names)] for q in range(len(ps))])
        nearest = d.min(0)
        q, x = np.nonzero(d <= nearest + 2 * REACH + 1e-9)
        own = np.argmin(d, 0)[x] == q
        both = (1 - d[q, x]) * (task.size[x] + task.size[len(names) + q]) / (2 - d[q, x])  # of d = 1 - both / union
        both = np.rint(both)
        linked = 100 * both >= LEAST * (task.size[x] + task.size[len(names) + q] - both)
        region = np.full(len(x), items.column("region")[0].as_py())
        return pa.table([pa.array(region), pa.array(names[x]), pa.array(ps[q]), pa.array(d[q, x]), pa.array(own), pa.array(linked)], names=["region", "set", "p", "d", "own", "linked"])

    return rows.groupBy("region", "salt").cogroup(pivots.groupBy("region", "salt")).applyInArrow(run, "region long, set long, p long, d double, own boolean, linked boolean")


def _rounds(large: DataFrame, sets: DataFrame, sizes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Works down large regions (region, set) by rounds of WIDE pivots, all regions together. Returns all links, and
    regions small enough for a task. sizes (set, size) are those of all sets."""
    small = None
    large = large.withColumn("g", F.col("set"))  # what a set hangs together with, as far as known
    while not large.isEmpty():
        weight = large.join(sizes, "set").groupBy("region").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("g").alias("g0"), F.max("g").alias("g1"))
        whole = materialize(weight.filter("g0 != g1").select("region", "n", (F.col("w") <= WEIGHT).alias("light"), F.ceil(F.col("w") / GATHER).alias("salts")), "weights")
        leaf = (F.col("n") <= LEAF) & F.col("light")
        few = large.join(whole.filter(leaf), "region").select("region", "set")
        small = few if small is None else small.unionByName(few)
        large = materialize(large.join(whole.filter(~leaf), "region").select("region", "set", "g", "n", "salts"), "large")
        if large.isEmpty():
            break
        # a pivot of each hash bucket, first of those that are not known to hang together with others: names are hashes,
        # so any choice among them is random
        order = F.struct((F.col("g") != F.col("set")).alias("tied"), "set")
        chosen = large.groupBy("region", F.pmod(F.xxhash64("set"), F.lit(WIDE)).alias("b")).agg(F.min(order).alias("s"), F.first("salts").alias("salts"))
        pivots = materialize(chosen.select("region", "salts", F.col("s.set").alias("p")).join(sets.select(F.col("set").alias("p"), F.col("shingles").alias("sp")), "p"), "pivots")
        dealt = pivots.select("region", "p", "sp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        rows = large.select("region", "set", F.pmod(F.xxhash64("set", "region"), F.col("salts")).alias("salt")).join(sets, "set")
        seen = materialize(_voronoi(rows, dealt), "cells")
        links = materialize(links.unionByName(seen.filter("linked and p != set").select(F.col("p").alias("src"), F.col("set").alias("dst")).distinct()).distinct(), "links")
        label = connected_components(links).select(F.col("node").alias("set"), F.col("component").alias("c"))
        rest = large.drop("g").join(label, "set", "left").withColumn("g", F.coalesce("c", "set")).drop("c")
        rest = rest.join(pivots.select("region", F.col("p").alias("set")), ["region", "set"], "left_anti")
        # the windows: what the farthest own set of a cell may reach
        inside = seen.join(rest.select("region", "set", "g", "n"), ["region", "set"])
        radius = inside.filter("own").groupBy("region", "p").agg(F.max("d").alias("radius"))
        inside = inside.join(radius, ["region", "p"]).filter(F.col("d") <= F.col("radius") + REACH + 1e-9)
        sums = inside.groupBy("region", "p").agg(F.count("*").alias("m"), F.first("n").alias("n")).groupBy("region")
        parted = sums.agg((F.sum(F.pow("m", F.lit(2))) <= PARTED * F.pow(F.first("n"), F.lit(2))).alias("parted"))
        inside = inside.join(parted.filter("parted"), "region").select(F.xxhash64("region", "p").alias("region"), "set", "g")
        rest = rest.join(parted.filter("parted"), "region", "left_anti").select("region", "set", "g")
        large = materialize(inside.unionByName(rest), "regions")
    return links, small


def _crowded(regions: DataFrame, firsts: DataFrame) -> DataFrame:
    """regions without sets that share too little of their window with all others together to be linked with any:
    what is linked with a set has three quarters of its size at least, and shares 1 + size // SPARE of that."""
    need = 1 + F.floor(F.ceil(F.col("size") * LEAST / 100) / SPARE)
    shared = regions.groupBy("set").agg(F.sum("n").alias("c"))
    keep = shared.join(firsts.select("set", "size"), "set").filter(F.col("c") >= need).select("set")
    left = regions.join(keep, "set")
    many = left.groupBy("region").agg(F.count("*").alias("_n")).filter("_n > 1").select("region")
    return materialize(left.join(many, "region").select("region", "set", "n"), "crowded")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with n_shingles and component_id, for each row of docs (doc_id, text).

    component_id is the least doc_id that links lead to, the document's own included. A shingle is K words
    of the text, lower-cased A-Z, cut at ASCII blanks; a text of fewer words has its whole sequence as
    one; a null text, or one without words, has none and is linked with nothing. Rows without doc_id are
    kept with a null component_id and linked with nothing. Rows that repeat a doc_id are one document
    whose texts all link; an empty table gives no rows; other columns are not read.
    """
    fields = list(dict.fromkeys(["doc_id", *keep]))
    sized = materialize(_sizes(docs, fields), "sizes")
    total, most = sized.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.max("n_shingles")).first()
    if not most:
        return sized.select(*keep, "n_shingles", F.col("doc_id").alias("component_id"))
    parts = max(12, total // PART)
    known = docs.filter("doc_id is not null")
    bits = frequency_bits(total)
    table = docs.sparkSession.sparkContext.broadcast(frequency_table(known, parts, bits))
    found = _windows(known, max(12, total // 4 // PART), table, bits).groupBy("part").applyInArrow(trimmed(_regions), "region long, set long, n long")
    regions = materialize(found.groupBy("region", "set").agg(F.sum("n").alias("n")), "regions")
    firsts = sized.filter("doc_id is not null and n_shingles > 0").groupBy("set").agg(F.min("doc_id").cast("long").alias("_id"), F.max("n_shingles").alias("size"))
    regions = _crowded(_crowded(regions, firsts), firsts).select("region", "set")
    wanted = firsts.drop("size").join(regions.select("set").distinct(), "set")
    sets = materialize(_sets(known.withColumn("_id", F.col("doc_id").cast("long")), wanted), "sets")
    counts = regions.join(firsts.select("set", "size"), "set").groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    leaf = (F.col("n") <= LEAF) & (F.col("w") <= WEIGHT)
    none = sets.select(F.col("set").alias("src"), F.col("set").alias("dst")).limit(0)
    big = regions.join(counts.filter(~leaf), "region").select("region", "set")
    links, more = _rounds(materialize(big, "large"), sets, firsts.select("set", "size"), none)
    small = regions.join(counts.filter(leaf), "region").select("region", "set")
    if more is not None:
        small = small.unionByName(more)
    links = links.unionByName(_leaves(small, sets))
    # all sets of one doc_id hang together, and a component is named by its least doc_id
    ids = firsts.select("set", F.col("_id").alias("first"))
    own = sized.filter("doc_id is not null and n_shingles > 0").select("doc_id", "set").distinct().join(ids, "set")
    edges = links.join(ids.select(F.col("set").alias("src"), F.col("first").alias("a")), "src").join(ids.select(F.col("set").alias("dst"), F.col("first").alias("b")), "dst")
    edges = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(own.filter("doc_id != first").select(F.col("doc_id").alias("src"), F.col("first").alias("dst")))
    label = connected_components(edges).withColumnRenamed("node", "doc_id")
    done = sized.join(label, "doc_id", "left")
    return done.select(*keep, "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _leaves(small: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of small regions. Regions that share sets are solved by one task where they hold few shingles
    together, so that a set moves about once; else each region is a task's work of its own."""
    small = materialize(small, "leaves")
    by_region = small.groupBy("region").agg(F.min("set").alias("k3"))
    for _ in range(3):  # regions that share sets come to share a key; what they do not share only costs moves
        by_set = small.join(by_region, "region").groupBy("set").agg(F.min("k3").alias("k"))
        by_region = materialize(small.join(by_set, "set").groupBy("region").agg(F.min("k").alias("k3")), "keys")
    # a group of near copies may hold a third of all regions: its rows meet what is said of their key in SALTS places
    salted = small.join(by_region, "region").withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(SALTS)))
    size = sets.select("set", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    crowd = salted.select("k3", "set").distinct().join(size, "set").groupBy("k3").agg((F.sum("n") > GATHER).alias("alone"))
    crowd = crowd.select("k3", "alone", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    tasks = salted.join(crowd, ["k3", "salt"]).select(F.when(F.col("alone"), F.col("region")).otherwise(F.col("k3")).alias("task"), "region", "set")
    rows = tasks.groupBy("task", "set").agg(F.collect_set("region").alias("regions")).join(sets, "set")
    return rows.groupBy("task").applyInArrow(trimmed(_solved), "src long, dst long")
