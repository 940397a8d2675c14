"""Removal of repeated byte strings by a range-partitioned suffix array.

Of each string of LENGTH bytes the suffix at one place in it is looked at: where the hash of the next
GRAM bytes is least among those that lie in the string. Equal strings choose the same place, so two
strings are equal just if their chosen suffixes agree on the bytes to the string's end and the bytes
before them agree back to its start. That leaves one suffix in about 35 bytes. Those whose leading GRAM
bytes stand nowhere else can match nothing and go. The rest are dealt to buckets by their leading bytes
between sampled splitters; a bucket sorts them, and what stands before them, by multikey quicksort and
reads from common prefix lengths which suffixes agree to any depth. Equal leading bytes fall to one side
of a splitter, so no match spans a boundary and neighbours need be compared inside buckets only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import MUL, U, buffers, mix, pack, steps, unpack

LENGTH, GRAM = 100, 32
#: Places in a string at which its suffix may start; bytes kept before and from a suffix.
PLACES = LENGTH - GRAM + 1
LEFT, RIGHT = PLACES - 1, LENGTH
#: Suffixes in a message and in a bucket, about; documents sampled for splitters and suffixes of each.
MESSAGE, BUCKET, SAMPLE, SAMPLE_EACH = 400_000, 100_000, 2000, 20


def chosen(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffix start, hash of its leading bytes, first and last string start that chose it, and text index."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, U), *[np.zeros(0, np.int64)] * 3)
    h = mix(data.astype(U) + U(1))
    size, power = 1, MUL
    while size < GRAM:
        h = h[: len(h) - size] * power + h[size:]
        power, size = U((int(power) * int(power)) & (2**64 - 1)), size * 2
    h = mix(h)
    # least upper half of the hash, of equal ones the last place
    low = U(0xFFFFFFFF)
    v = (h & ~low) | (low - np.arange(len(h), dtype=U))
    size = 1
    while size * 2 <= PLACES:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    v = np.minimum(v[: len(v) - (PLACES - size)], v[PLACES - size :])
    place = (low - (v & low)).astype(np.int64)[:n]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    start = np.flatnonzero(np.arange(n) + LENGTH <= offsets[1:][doc])
    if not len(start):
        return (np.zeros(0, np.int64), np.zeros(0, U), *[np.zeros(0, np.int64)] * 3)
    place, doc = place[start], doc[start]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    return place[new], h[place[new]], start[new], start[last], doc[new]


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, so that words order as the bytes do."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    return padded.view(">u8").astype(U)


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of rows by multikey quicksort: rows are parted by one word, and only rows that tie go on to the next."""
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable") if n else np.zeros(0, np.int64)
    group = np.cumsum(np.concatenate([[True], words[order[1:], 0] != words[order[:-1], 0]])) if n else order
    for d in range(1, words.shape[1]):
        tied = np.flatnonzero(np.concatenate([[False], group[1:] == group[:-1]]) | np.concatenate([group[1:] == group[:-1], [False]])) if n else order
        if not len(tied):
            break
        at, g = order[tied], group[tied]
        key = words[at, d]
        inner = np.lexsort((key, g))
        order[tied] = at[inner]
        key = key[inner]
        # a tie that the word breaks starts a new group
        breaks = np.zeros(n, bool)
        breaks[tied[1:]] = (key[1:] != key[:-1]) & (g[1:] == g[:-1])
        first = np.concatenate([[True], group[1:] != group[:-1]])
        group = np.cumsum(first | breaks)
    return order


def common_prefix(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in the order shares with the one before; the first with none."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    open_ = np.arange(1, len(order))
    for d in range(words.shape[1]):
        x = words[order[open_], d] ^ words[order[open_ - 1], d]
        same = x == 0
        bits = np.zeros(len(x), np.int64)
        y = x.copy()
        for s in (32, 16, 8):
            big = y >= (U(1) << U(s))
            bits += big * s
            y = np.where(big, y >> U(s), y)
        out[open_] += np.where(same, 8, 7 - bits // 8)
        open_ = open_[same]
        if not len(open_):
            break
    return out


def repeated(context: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For suffixes in document order: whether the string that starts o bytes before is not its first, by (row, o).

    context has LEFT bytes before and RIGHT bytes from each suffix; strings start from `first` to `last`
    bytes before it, first being the greater.
    """
    n = len(context)
    out = np.zeros((n, PLACES), bool)
    right, left = words_of(context[:, LEFT:]), words_of(context[:, :LEFT][:, ::-1])
    order_r, order_l = multikey_sort(right), multikey_sort(left)
    lcp_r, lcp_l = common_prefix(right, order_r), common_prefix(left, order_l)
    class_r, class_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(PLACES):
        rows = np.flatnonzero((last <= o) & (o <= first))
        if len(rows) < 2:
            continue
        class_r[order_r] = np.cumsum(lcp_r < LENGTH - o)
        class_l[order_l] = np.cumsum(lcp_l < o)
        key = class_l[rows] * (n + 1) + class_r[rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        out[rows[order[1:][key[1:] == key[:-1]]], o] = True
    return out


def runs(hit: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the bytes that the marked strings of each row cover."""
    flat = np.zeros((hit.shape[0], hit.shape[1] + 2), np.int8)
    flat[:, 1:-1] = hit[:, ::-1]  # by growing start
    step = np.diff(flat, axis=1)
    row, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return row, place[row] - LEFT + a, place[row] - LEFT + b - 1 + LENGTH


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _send(texts: DataFrame, parts: int) -> DataFrame:
    """Messages (task, part, uids, h, idx, pos): hashes and places of chosen suffixes, dealt by hash; the
    uids that idx counts stand in one message of each task."""
    names = ["task", "part", "uids", "h", "idx", "pos"]

    def run(batches):
        base, held, n, flush = TaskContext.get().partitionId() << 24, [], 0, 0

        def message():
            nonlocal held, n, flush
            task, flush = base + flush, flush + 1
            uid = np.concatenate([x[0] for x in held])
            shift = np.cumsum([0] + [len(x[0]) for x in held])
            h, pos = np.concatenate([x[1] for x in held]), np.concatenate([x[3] for x in held])
            idx = np.concatenate([x[2] + s for x, s in zip(held, shift, strict=False)])
            part = (h >> U(40)).astype(np.int64) % parts
            order = np.lexsort((h, part))
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                at = order[ends[p] : ends[p + 1]]
                own = pack(uid) if p == task % parts else b""
                if len(at) or own:
                    hs = h[at]
                    rows.append((task, p, own, pack(np.diff(hs, prepend=U(0))), pack(idx[at].astype(np.uint32)), pack(pos[at].astype(np.uint32))))
            held, n = [], 0
            cols = list(zip(*rows, strict=True))
            yield from pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *map(_binary, cols[2:])], names=names).to_batches()

        for batch in batches:
            for t in steps(batch):
                data, offsets = buffers(t.column("text").combine_chunks())
                at, h, _, _, doc = chosen(data, offsets)
                held.append((t.column("uid").to_numpy().astype(np.int64), h, doc, at - offsets[doc]))
                n += len(at)
                if n >= MESSAGE:
                    yield from message()
        if held:
            yield from message()

    return texts.mapInArrow(run, "task long, part int, uids binary, h binary, idx binary, pos binary")


def _repeating(t: pa.Table) -> pa.Table:
    """Of one part's messages, those places whose leading bytes stand elsewhere too."""
    cols = {c: t.column(c).to_pylist() for c in ("h", "idx", "pos")}
    h = [np.cumsum(unpack(b, U), dtype=U) for b in cols["h"]]
    ends = np.cumsum([0] + [len(x) for x in h])
    every = np.concatenate(h) if h else np.zeros(0, U)
    order = np.argsort(every, kind="stable")
    same = every[order[1:]] == every[order[:-1]]
    hit = np.zeros(len(every), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    idx, pos = [], []
    for i in range(len(h)):
        keep = hit[ends[i] : ends[i + 1]]
        idx.append(pack(unpack(cols["idx"][i], np.uint32)[keep]))
        pos.append(pack(unpack(cols["pos"][i], np.uint32)[keep]))
    return pa.table([t.column("task"), t.column("uids"), _binary(idx), _binary(pos)], names=["task", "uids", "idx", "pos"])


def _by_text(t: pa.Table) -> pa.Table:
    """One task's places, a row for each text that has any."""
    uid = unpack(next((b for b in t.column("uids").to_pylist() if b), b""), np.int64)
    idx = np.concatenate([unpack(b, np.uint32) for b in t.column("idx").to_pylist()]).astype(np.int64)
    pos = np.concatenate([unpack(b, np.uint32) for b in t.column("pos").to_pylist()])
    order = np.lexsort((pos, idx))
    idx, pos = idx[order], pos[order]
    own, first = np.unique(idx, return_index=True)
    ends = np.append(first[1:], len(idx))
    return pa.table([pa.array(uid[own]), _binary([pos[a:b].tobytes() for a, b in zip(first, ends, strict=True)])], names=["uid", "places"])


def _key(context: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(context[:, LEFT : LEFT + GRAM]).view(f"S{GRAM}").reshape(len(context))


def _contexts(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """LEFT bytes before and RIGHT from each place; zeros stand for what lies outside the text."""
    where = at[:, None] + np.arange(-LEFT, RIGHT)
    inside = (where >= offsets[doc][:, None]) & (where < offsets[doc + 1][:, None])
    return np.where(inside, data[np.clip(where, 0, max(len(data) - 1, 0))], 0).astype(np.uint8)


def _splitters(texts: DataFrame, buckets: int, n_docs: int) -> np.ndarray:
    """Leading bytes that cut a bounded sample of the chosen suffixes into even buckets."""
    few = texts.filter(F.pmod(F.xxhash64("uid"), F.lit(max(1, n_docs // SAMPLE))) == 0).select("uid", "text")

    def run(batches):
        for batch in batches:
            for t in steps(batch):
                data, offsets = buffers(t.column("text").combine_chunks())
                at, _, _, _, doc = chosen(data, offsets)
                rank = np.arange(len(at)) - np.searchsorted(doc, doc)
                pick = rank < SAMPLE_EACH
                keys = _key(_contexts(data, offsets, at[pick], doc[pick]))
                yield from pa.table([_binary(keys.tolist())], names=["k"]).to_batches()

    keys = np.sort(np.array([r[0] for r in few.mapInArrow(run, "k binary").collect()], f"S{GRAM}"))
    return np.unique(keys[np.linspace(0, len(keys), buckets + 1)[1:-1].astype(int)]) if len(keys) >= buckets else keys[:0]


_FIELDS = ("doc", "uid", "pos", "first", "last")


def _deal(joined: DataFrame, splitters) -> DataFrame:
    """Messages (bucket, context, doc, uid, pos, first, last, spans). Suffixes with equal context are sent once
    by a task, for the earliest; what the others' strings cover is known then and goes along as spans."""

    def run(batches):
        cuts, held, n = splitters.value, [], 0

        def message():
            nonlocal held, n
            context = np.concatenate([x[0] for x in held])
            cols = {c: np.concatenate([x[1][c] for x in held]) for c in _FIELDS}
            held, n = [], 0
            order = np.lexsort((cols["pos"], cols["uid"], cols["doc"]))
            context, cols = context[order], {c: v[order] for c, v in cols.items()}
            sig = np.concatenate([context, cols["first"].astype(np.uint8)[:, None], cols["last"].astype(np.uint8)[:, None]], axis=1)
            _, keep, same = np.unique(np.ascontiguousarray(sig).view(f"V{sig.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
            # a repeated row is the same place again, no copy
            kept = keep[same]
            other = (cols["doc"] != cols["doc"][kept]) | (cols["uid"] != cols["uid"][kept]) | (cols["pos"] != cols["pos"][kept])
            again = np.flatnonzero(other)
            spans = np.stack([cols["uid"][again], cols["pos"][again] - cols["first"][again], cols["pos"][again] - cols["last"][again] + LENGTH], axis=1)
            keep.sort()
            context, cols = context[keep], {c: v[keep] for c, v in cols.items()}
            bucket = np.searchsorted(cuts, _key(context), side="right") if len(cuts) else np.zeros(len(context), np.int64)
            share = np.array_split(spans, len(np.unique(bucket)))
            rows = []
            for b, s in zip(np.unique(bucket), share, strict=True):
                at = np.flatnonzero(bucket == b)
                rows.append((int(b), context[at].tobytes(), *[pack(cols[c][at].astype(np.int64)) for c in _FIELDS], pack(s.reshape(-1).astype(np.int64))))
            out = list(zip(*rows, strict=True))
            yield from pa.table([pa.array(out[0], pa.int32()), *map(_binary, out[1:])], names=["bucket", "context", *_FIELDS, "spans"]).to_batches()

        for batch in batches:
            for t in steps(batch):
                data, offsets = buffers(t.column("text").combine_chunks())
                at, _, lo, hi, doc = chosen(data, offsets)
                want = [np.frombuffer(b, np.uint32) + o for b, o in zip(t.column("places").to_pylist(), offsets, strict=False)]
                pick = np.isin(at, np.concatenate(want) if want else np.zeros(0), assume_unique=True)
                at, lo, hi, doc = at[pick], lo[pick], hi[pick], doc[pick]
                for i in range(0, len(at), 50_000):
                    a, d = at[i : i + 50_000], doc[i : i + 50_000]
                    ids = {"doc": t.column("_order").to_numpy()[d], "uid": t.column("uid").to_numpy()[d], "pos": a - offsets[d], "first": a - lo[i : i + 50_000], "last": a - hi[i : i + 50_000]}
                    held.append((_contexts(data, offsets, a, d), ids))
                    n += len(a)
                    if n >= BUCKET:
                        yield from message()
        if n:
            yield from message()

    return joined.mapInArrow(run, "bucket int, context binary, doc binary, uid binary, pos binary, first binary, last binary, spans binary")


def _match(t: pa.Table) -> pa.Table:
    """What the repeated strings of one bucket cover: uid, start, end."""
    context = np.frombuffer(b"".join(t.column("context").to_pylist()), np.uint8).reshape(-1, LEFT + RIGHT)
    cols = {c: np.concatenate([unpack(b, np.int64) for b in t.column(c).to_pylist()]) for c in _FIELDS}
    order = np.lexsort((cols["pos"], cols["uid"], cols["doc"]))
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = np.all([cols[c][order[1:]] == cols[c][order[:-1]] for c in ("doc", "uid", "pos")], axis=0)
    order = order[~same]
    context, cols = context[order], {c: v[order] for c, v in cols.items()}
    row, start, end = runs(repeated(context, cols["first"], cols["last"]), cols["pos"])
    known = np.concatenate([unpack(b, np.int64) for b in t.column("spans").to_pylist()]).reshape(-1, 3)
    out = [np.concatenate([x, known[:, i]]) for i, x in enumerate((cols["uid"][row], start, end))]
    return pa.table(out, names=["uid", "start", "end"])


def _finish(rows: DataFrame, kind: str) -> DataFrame:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches):
        for batch in batches:
            for t in steps(batch):
                out = []
                whole = t.column("whole").to_pylist()
                for text, copy, spans in zip(t.column("text").to_pylist(), whole, t.column("spans").to_pylist(), strict=True):
                    b = text.encode()
                    if copy and len(b) >= LENGTH:
                        spans = [{"start": 0, "end": len(b)}]
                    kept, at, gone, n = [], 0, 0, 0
                    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                        if s > at or n == 0:
                            kept.append(b[at:s])
                            n += 1
                            gone += e - s
                            at = e
                        elif e > at:
                            gone += e - at
                            at = e
                    kept.append(b[at:])
                    rest = b"".join(kept)
                    out.append((len(b), gone, n, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                yield from pa.table([t.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names).to_batches()

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for each row of docs (doc_id, text).

    A byte goes if a string of LENGTH bytes covers it that also starts earlier: in a document of smaller
    doc_id, or earlier in the same. kept is what is left, without partial characters. Null texts are
    empty; null doc_ids are the last documents. Documents of equal id are ordered by a digest of their
    text; rows that repeat id and text are one document, and each row gets its result. Texts of fewer
    than LENGTH bytes are kept whole; an empty table gives no rows; other columns are not read.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    # null ids last
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_order")
    n_docs, n_bytes = base.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(16, n_bytes // 35 // BUCKET // 4)
    found = _send(base.select("uid", "text"), parts).groupBy("part").applyInArrow(_repeating, "task long, uids binary, idx binary, pos binary")
    places = found.groupBy("task").applyInArrow(_by_text, "uid long, places binary")
    # of equal texts only the first document goes on: the others are removed whole
    firsts = base.groupBy(F.md5("text").alias("_m")).agg(F.min(F.struct(order, "uid")).alias("_f")).select(F.col("_f.uid").alias("uid"))
    places = places.join(firsts, "uid").groupBy("uid").agg(F.first("places").alias("places"))
    cuts = spark.sparkContext.broadcast(_splitters(base, 2 * parts, n_docs))
    # both joins take the same columns of base, so that its texts are shuffled once
    sent = _deal(base.join(places, "uid").select("uid", order, "text", "places"), cuts)
    spans = sent.groupBy("bucket").applyInArrow(_match, "uid long, start long, end long")
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    done = base.join(spans, "uid", "left").join(firsts.select("uid", F.lit(False).alias("whole")), "uid", "left")
    return _finish(done.select("doc_id", "text", "spans", F.coalesce("whole", F.lit(True)).alias("whole")), kind)
