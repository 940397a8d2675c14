"""Language-model scoring: a gated recurrent network with a class-factored softmax over whole documents.

The network reads one token after another and predicts first the class of the next, then the token in
its class. Frequent words have classes of their own, in which the network chooses. All other words are
put into classes by their spelling, in which a word's share is its count over the whole corpus, plus one;
one more share in each class is for words that were never seen, so the probabilities of a class sum to
one. The frequent words are those of all training texts. The network is trained on all training texts by
backpropagation through windows whose state is carried on: in each round the groups go on from the same
network, each over its own texts, and their networks are averaged. Round, group and order of a text follow from a
digest of its id and itself, so the network does not depend on how the table is split. Scoring carries a
document's state through all of its windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import gru
from .textkit import U, Words, mix, one_thread, pack, steps, unpack

#: Units; classes of frequent words and words in each; spelling classes of all others.
HIDDEN, CLASSES, PER_CLASS, SPELLED = 24, 40, 32, 8
#: Training: streams at least, window, updates at least (a small corpus is read several times), rate.
STREAMS, WINDOW, UPDATES, RATE = 64, 24, 350, 0.02
#: Rounds of training, streams at most that a block is cut into, networks that the driver gets and that a sum joins.
ROUNDS, WIDE, GROUPS, JOINED = 8, 512, 16, 64
#: Buckets of texts in a round at most; a bucket has about as many tokens as a message or more.
WIDEST = 1 << 14
#: Tokens in a message, tokens that the network scores side by side, and tokens in a part of the counts.
MESSAGE, ABREAST, PART = 500_000, 8_000_000, 6_000_000
#: Texts that are scored side by side, and steps between two looks at the softmax.
SIDE, STEPS = 1024, 24
END = U(0xE2D0_0000_0000_0000)  # stands for the end token; its low bits name no spelling class
#: Slots of the table of often seen words that every task holds.
SLOTS = 1 << 18


def _flags() -> np.ndarray:
    """What a byte says of its word: 1 a digit, 2 a letter, and by its script 4, 8 or 16."""
    b = np.arange(256)
    digit, letter = (b >= 48) & (b <= 57), ((b >= 97) & (b <= 122)) | (b >= 0x80)
    return (digit * 1 | letter * 2 | ((b >= 0xC3) & (b <= 0xC9)) * 4 | ((b >= 0xCA) & (b <= 0xDF)) * 8 | (b >= 0xE0) * 16).astype(np.uint8)


def _classes() -> np.ndarray:
    """Spelling class by what a word's bytes say together, 32 where it ends in a letter and 64 where it is long."""
    k = np.arange(128)
    out = np.where(k & 16, 5, np.where(k & 8, 4, np.where(k & 4, 3, k >> 6)))
    out = np.where(k & 32, out, np.where(k & 28, 6, 2))
    return np.where((k & 1 > 0) | (k & 2 == 0), 7, out).astype(np.uint8)


_FLAGS, _CLASSES = _flags(), _classes()


def spelling(words: Words) -> np.ndarray:
    """Class of each word by its spelling: digits or no letter, an end that is no letter, script, length."""
    if not len(words.start):
        return np.zeros(0, np.uint8)
    f = _FLAGS[words.body]
    seen, last = np.bitwise_or.reduceat(f, words.start), f[words.end - 1]  # the blanks between words say nothing
    return _CLASSES[seen | (last & 2) << 4 | (words.end - words.start > 7).astype(np.uint8) << 6]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token with its spelling class in the low four bits, tokens of each text (its end included)."""
    w = Words(texts)
    h = (w.hash & ~U(15)) | spelling(w).astype(U)
    counts = w.counts + 1
    ends = np.cumsum(counts) - 1
    out = np.full(int(counts.sum()), END, U)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = h
    return out, counts, ends


@dataclass
class Model:
    """Frequent words in hash order with their number, and the network's arrays."""

    head: np.ndarray
    number: np.ndarray
    p: dict[str, np.ndarray]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Number of a frequent token; CLASSES * PER_CLASS + class for another."""
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, self.number[at], CLASSES * PER_CLASS + (h & U(7)).astype(np.int64))

    def log10(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each text's classes, and of its frequent tokens in them."""
        start, order = np.cumsum(counts) - counts, np.argsort(-counts, kind="stable")
        out = np.zeros(len(counts))
        for at in range(0, len(order), SIDE):  # texts of like length, as many as keep a step's arrays in cache
            own = order[at : at + SIDE]
            out[own] = self._run(ids, start[own], counts[own]) / np.log(10)
        return out

    def _run(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log-probability of texts, the longest first, with their state carried through all windows."""
        p, out = self.p, np.zeros(len(length))
        h = np.zeros((len(length), HIDDEN), np.float32)
        prev = np.full(len(length), CLASSES * PER_CLASS + SPELLED)
        for t0 in range(0, int(length[0]), STEPS):
            live = int(np.searchsorted(-length, -t0, side="left"))
            h, prev = h[:live], prev[:live]
            t = np.arange(t0, min(t0 + STEPS, int(length[0])))
            valid = t[:, None] < length[:live]
            target = ids[np.where(valid, start[:live] + t[:, None], 0)]
            states = np.empty((len(t), live, HIDDEN), np.float32)
            for i in range(len(t)):
                h = gru.step(p["x"][prev], h, p["h"])
                states[i] = h
                prev = target[i]
            s, y = states[valid], target[valid]
            out += np.bincount(np.nonzero(valid)[1], self._loss(s, y)[0], minlength=len(length))
        return out

    def _loss(self, s: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """Log-probability of tokens y in states s; with grads, also adds the gradients of its negative mean."""
        # one column for each state: sums and maxima then run over whole rows
        p, n = self.p, len(y)
        cls = np.where(y < CLASSES * PER_CLASS, y // PER_CLASS, y - CLASSES * PER_CLASS + CLASSES)
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        s, y, cls = s[order], y[order], cls[order]
        out, d = _chosen(p["c"], p["cb"], s, cls, n, grads is not None)
        ds = None
        if grads is not None:
            grads["c"], grads["cb"], ds = s.T @ d.T, d.sum(1), d.T @ p["c"].T
        ends = np.searchsorted(cls, np.arange(CLASSES + 1))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            at = slice(ends[k], ends[k + 1])
            more, d = _chosen(p["w"][k], p["wb"][k], s[at], y[at] - k * PER_CLASS, n, grads is not None)
            out[at] += more
            if grads is not None:
                grads["w"][k], grads["wb"][k] = s[at].T @ d.T, d.sum(1)
                ds[at] += d.T @ p["w"][k].T
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return out[back], None if ds is None else ds[back]


def _chosen(w: np.ndarray, b: np.ndarray, s: np.ndarray, y: np.ndarray, n: int, gradient: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of choice y in each state, and the gradient of the negative mean over n by all choices."""
    a, at = w.T @ s.T + b[:, None], np.arange(len(y))
    a -= a.max(0)
    e = np.exp(a)
    total = e.sum(0)
    out = a[y, at].astype(float) - np.log(total)
    if not gradient:
        return out, None
    e *= 1 / (total * n)
    e[y, at] -= 1 / n
    return out, e


def untrained(words: np.ndarray, n: np.ndarray, spelled: np.ndarray, seed: int = 11) -> Model:
    """A network at its start. Its frequent words are the most counted of words, n times each; spelled has the
    counts of all tokens by spelling class. Biases start at these counts."""
    rng = np.random.default_rng(seed)
    most = np.lexsort((words, -n))[: CLASSES * PER_CLASS]
    # classes by frequency: each holds neighbours in the order of counts
    head, k = words[most], CLASSES * PER_CLASS
    by_hash = np.argsort(head)
    f32 = lambda *shape, scale=0.1: (rng.standard_normal(shape) * scale).astype(np.float32)
    params = {"x": f32(k + SPELLED + 1, 3 * HIDDEN), "h": f32(HIDDEN, 3 * HIDDEN, scale=0.2), "c": f32(HIDDEN, CLASSES + SPELLED), "cb": np.zeros(CLASSES + SPELLED, np.float32), "w": f32(CLASSES, HIDDEN, PER_CLASS), "wb": np.zeros((CLASSES, PER_CLASS), np.float32)}
    often = np.zeros(k)
    often[: len(most)] = n[most]
    rare = spelled - np.bincount((head & U(7)).astype(np.int64), n[most], minlength=SPELLED)
    params["cb"][:] = np.log((np.concatenate([often.reshape(CLASSES, PER_CLASS).sum(1), rare]) + 1) / spelled.sum())
    params["wb"][:] = np.log(often.reshape(CLASSES, PER_CLASS) + 0.1)
    return Model(head[by_hash], by_hash.astype(np.int64), params)


def windows(ids: np.ndarray, end: int, streams: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Previous tokens and tokens (-1 after the last) of windows over parallel streams: each token is in one window."""
    span = -(-len(ids) // streams)
    y = np.full(span * streams, -1)
    y[: len(ids)] = ids
    prev = np.concatenate([[end], np.where(y < 0, end, y)[:-1]])
    y, prev = y.reshape(streams, span).T, prev.reshape(streams, span).T
    return [(prev[at : at + WINDOW], y[at : at + WINDOW]) for at in range(0, span, WINDOW)]


def train(model: Model, blocks: list[np.ndarray], rate, updates: int | None = None, passes: int = 1) -> int:
    """Trains model on blocks of token numbers by whole passes over all of them, or by a number of updates, and
    says how many tokens it read. rate is of the update and the number of all updates."""
    end, p = int(model.ids(np.array([END]))[0]), model.p
    cut = [(b, int(np.clip(len(b) // (40 * WINDOW), STREAMS, WIDE))) for b in blocks if len(b)]
    n = sum(-(-len(b) // (streams * WINDOW)) for b, streams in cut)
    updates = n * passes if updates is None else updates if n else 0
    adam, u, read = gru.Adam(p, RATE), 0, 0
    while u < updates:
        for block, streams in cut:
            state = np.zeros((streams, HIDDEN), np.float32)
            for prev, y in windows(block, end, streams)[: updates - u]:
                fresh = (prev == end).astype(np.float32)
                prev, valid = np.where(prev == end, CLASSES * PER_CLASS + SPELLED, prev), y.reshape(-1) >= 0
                s, cache = gru.forward(p["x"][prev], p["h"], state, reset=fresh)
                grads = {"w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"])}
                s, y = s.reshape(-1, HIDDEN), y.reshape(-1)
                if valid.all():
                    ds = model._loss(s, y, grads)[1]
                else:
                    ds = np.zeros_like(s)
                    ds[valid] = model._loss(s[valid], y[valid], grads)[1]
                last, s = s[-len(state) :], s.reshape(-1, *state.shape)
                dxp, grads["h"] = gru.backward(ds.reshape(s.shape), cache, p["h"], reset=fresh)
                order = np.argsort(prev.reshape(-1).astype(np.uint16), kind="stable")
                which = prev.reshape(-1)[order]
                first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
                grads["x"] = np.zeros_like(p["x"])
                grads["x"][which[first]] = np.add.reduceat(dxp.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
                adam.update(grads, rate(u, updates))
                state, u, read = last, u + 1, read + int(valid.sum())
    return read


def fit(texts: list[str], seed: int = 11, updates: int = UPDATES) -> Model:
    """Trains on texts that are at hand: streams of whole documents, a reset at each start, windows with carried state."""
    parts = [tokens(pa.array(texts[i : i + 100], pa.string())) for i in range(0, len(texts), 100)] or [tokens(pa.array([""]))]
    h = np.concatenate([x[0] for x in parts])
    model = untrained(*np.unique(h, return_counts=True), np.bincount((h & U(7)).astype(np.int64), minlength=SPELLED), seed)
    train(model, [model.ids(h)], lambda u, n: RATE * min(1.0, (u + 1) / 30) * (1 - 0.9 * u / n), updates)
    return model


class Often:
    """Words by the slots of a table of fixed size, each with its count in training texts; of words that share a slot
    the most counted has it. A word without a slot is a seldom one, whatever its count."""

    def __init__(self, words: np.ndarray, n: np.ndarray, train: np.ndarray, model: Model):
        self.word, self.train = np.zeros(SLOTS, U), np.zeros(SLOTS, np.int64)
        up = np.lexsort((words, n))
        slot = self.slots(words[up])[0]
        self.word[slot], self.train[slot] = words[up], train[up]
        used = self.word != 0
        self.code = np.where(model.ids(self.word) < CLASSES * PER_CLASS, 8, (self.word & U(7)).astype(np.int64))
        self.logs = np.log10(self.train + 1.0)
        self.totals = np.concatenate([np.bincount(self.code[used], self.train[used], minlength=9), np.bincount(self.code[used], self.train[used] > 0, minlength=9)])

    def slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each token, and whether the token has it."""
        at = (mix(h) & U(len(self.word) - 1)).astype(np.int64)
        return at, self.word[at] == h


def _vocabulary(docs: DataFrame, parts: int) -> tuple[Model, Often, int]:
    """The untrained network of all training texts (docs: text, held_out), the often seen words, and how many tokens
    have other words. Tokens are counted in parts of their hashes, each of which sends its most frequent ones to the
    driver: twice the slots at most together."""
    share = -(-2 * SLOTS // parts)

    def count(batches):
        held, size = [], 0

        def message():
            nonlocal held, size
            h, out = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            (a, na), (b, nb) = (np.unique(x, return_counts=True) for x in (h[~out], h[out]))
            words, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            n, train = np.bincount(at, np.concatenate([na, nb]), minlength=len(words)), np.bincount(at[: len(a)], na, minlength=len(words))
            part = (mix(words) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            words, n, train, ends = words[order], n[order], train[order], np.searchsorted(part[order], np.arange(parts + 1))
            held, size, cut = [], 0, [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [pa.array(range(parts), pa.int32()), pa.array([pack(np.diff(words[x], prepend=U(0))) for x in cut], pa.binary()), *[pa.array([pack(v[x].astype(np.uint32)) for x in cut], pa.binary()) for v in (n, train)]]
            yield from pa.table(columns, names=["part", "h", "n", "train"]).to_batches()

        for batch in batches:
            for t in steps(batch):
                h, counts, _ = tokens(t.column("text").combine_chunks())
                held.append((h, np.repeat(t.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), counts)))
                size += len(h)
                if size >= MESSAGE:
                    yield from message()
        if held:
            yield from message()

    def most(t: pa.Table) -> pa.Table:
        words, at = np.unique(np.concatenate([np.cumsum(unpack(b, U), dtype=U) for b in t.column("h").to_pylist()]), return_inverse=True)
        n, train = (np.bincount(at, np.concatenate([unpack(b, np.uint32) for b in t.column(c).to_pylist()]), minlength=len(words)) for c in ("n", "train"))
        spelled = np.bincount((words & U(7)).astype(np.int64), train, minlength=SPELLED)
        best = np.lexsort((words, -n))[:share]
        return pa.table([*[pa.array([x[best].tobytes()], pa.binary()) for x in (words, n, train)], pa.array([spelled.tolist()], pa.list_(pa.float64())), pa.array([n.sum()], pa.float64())], names=["h", "n", "train", "spelled", "total"])

    rows = docs.select("text", "held_out").mapInArrow(count, "part int, h binary, n binary, train binary").groupBy("part").applyInArrow(most, "h binary, n binary, train binary, spelled array<double>, total double").collect()
    h = np.concatenate([np.frombuffer(r.h, U) for r in rows] or [np.array([END])])
    n, train = (np.concatenate([np.frombuffer(r[c], float) for r in rows] or [np.ones(1)]) for c in ("n", "train"))
    model = untrained(h[train > 0], train[train > 0], np.sum([r.spelled for r in rows] or [np.bincount([0], minlength=SPELLED)], axis=0))
    often = Often(h, n, train, model)
    kept = often.slots(h)[1]
    return model, often, int(sum(r.total for r in rows) - n[kept].sum())


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def _shaped(flat: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([x.size for x in p.values()])
    return {k: part.reshape(x.shape).astype(np.float32) for (k, x), part in zip(p.items(), np.split(flat, ends[:-1]), strict=True)}


def _dealt(messages: DataFrame, k: int, width: int) -> DataFrame:
    """Rows (bucket, deal, ids) of the training texts of round k, each bucket in a partition of its own in the order of
    digests. Equal texts of a message that have the same id are sent once."""

    def cut(batches):
        for batch in batches:
            for ids, deals in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                deal, n = np.frombuffer(deals, np.int64).reshape(-1, 2).T.copy()
                mine = deal.view(U) % U(ROUNDS) == k
                deal, ends = deal[mine], np.cumsum(2 * n[mine])
                texts = {(d, ids[a:b]): None for d, a, b in zip(deal.tolist(), (ends - 2 * n[mine]).tolist(), ends.tolist(), strict=True)}
                own = np.array([d for d, _ in texts], np.int64)
                bucket = (own.view(U) // U(ROUNDS) % U(width)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(own), pa.array([x for _, x in texts], pa.binary())], names=["bucket", "deal", "ids"])

    mine = messages.filter(f"turns[{k + 1}] > turns[{k}]").selectExpr(f"substring(ids, CAST(2 * turns[{k}] + 1 AS INT), CAST(2 * (turns[{k + 1}] - turns[{k}]) AS INT))", "deals")
    return mine.mapInArrow(cut, "bucket int, deal long, ids binary").repartitionById(width, F.col("bucket")).sortWithinPartitions("deal", "ids")


def _total(dtype):
    """The sum of networks in the order of their buckets, each by its weight where they are single ones."""

    def total(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        n = t.column("n").to_pylist()
        p = sum((w if dtype is np.float32 else 1.0) * np.frombuffer(b, dtype).astype(float) for w, b in zip(n, t.column("p").to_pylist(), strict=True))
        return pa.table([pa.array([t.column("bucket")[0].as_py() // JOINED], pa.int32()), pa.array([sum(n)], pa.int64()), pa.array([p.tobytes()], pa.binary())], names=["bucket", "n", "p"])

    return total


def learn(messages: DataFrame, model: Model) -> Model:
    """model, trained on the training texts of messages: every text is read in a whole pass, in several where texts
    are few; rows that are equal in id and text are read as one. Texts are dealt to rounds and to buckets in them by
    digest. In a round each bucket trains the same network on its texts; the mean of the networks by tokens read is
    where the next round starts.
    """
    context = messages.sparkSession.sparkContext
    cut = messages.filter("learnt > 0").select("ids", "deals", "turns")
    found = cut.agg(*[F.coalesce(F.sum(F.expr(f"turns[{k + 1}] - turns[{k}]")), F.lit(0)) for k in range(ROUNDS)]).first()
    sizes = {k: n for k, n in enumerate(found) if n}
    passes = max(1, -(-UPDATES * WINDOW * STREAMS // max(1, sum(sizes.values()))))
    for done, (k, size) in enumerate(sizes.items()):
        now, width = context.broadcast(model), min(WIDEST, max(1, size // MESSAGE))

        def rate(u, n, done=done):
            return RATE * min(1.0, (u + 1) / (5 if done else 30)) * (1 - 0.9 * (done + u / n) / len(sizes))

        def work(batches, now=now, rate=rate):
            held, last, bucket = [], None, 0
            for batch in batches:
                for bucket, deal, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if (deal, ids) != last:
                        held.append(ids)
                        last = (deal, ids)
            ids = np.frombuffer(b"".join(held), np.uint16)
            # even blocks: a short one would take as many updates as a long one
            blocks = np.array_split(ids, max(1, len(ids) // MESSAGE)) if held else []
            if blocks:
                one_thread()
                m = Model(now.value.head, now.value.number, {k: x.copy() for k, x in now.value.p.items()})
                n = train(m, blocks, rate, passes=passes)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([n], pa.int64()), pa.array([_flat(m.p).tobytes()], pa.binary())], names=["bucket", "n", "p"])

        kind, sums = np.float32, _dealt(cut, k, width).mapInArrow(work, "bucket int, n long, p binary")
        while width > GROUPS:
            sums = sums.groupBy(F.expr(f"bucket DIV {JOINED}")).applyInArrow(_total(kind), "bucket int, n long, p binary")
            kind, width = float, -(-width // JOINED)
        sums = sorted(sums.collect(), key=lambda r: r.bucket)  # GROUPS rows at most
        p = sum((r.n if kind is np.float32 else 1.0) * np.frombuffer(r.p, kind).astype(float) for r in sums) / sum(r.n for r in sums)
        model = Model(model.head, model.number, _shaped(p, model.p))
        now.unpersist()
    return model


_MESSAGE = "task long, part int, docs binary, ids binary, learnt long, deals binary, turns array<long>, h binary, n binary, train binary, idx binary"


def _ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _table(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def _messages(docs: DataFrame, parts: int, model, often) -> DataFrame:
    """Rows of _MESSAGE, in which all texts are cut into tokens once for what follows.

    One row of each task has its texts (docs), what the table of often seen words says of them, and the numbers of
    their tokens (ids) for the network: first the training texts of each round by digest, whose digests and sizes are
    in deals and whose tokens end at turns, then the texts held out. The others have the distinct seldom tokens of a part by hash (h), how often
    each is there (n) and in training texts (train), and the texts it is in (idx): no group ever holds the places of
    a word that the table has.
    """
    names = ["task", "part", "docs", "ids", "learnt", "deals", "turns", "h", "n", "train", "idx"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.binary()] * 4]

    def run(batches):
        at, flush, held, size = TaskContext.get().partitionId(), 0, [], 0

        def message():
            nonlocal held, size, flush
            task, flush = (at << 24) + flush, flush + 1
            m, table = model.value, often.value
            h, counts = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            held_out = np.concatenate([x[3] for x in held])
            doc_ids = pa.concat_arrays([c for x in held for c in x[2].chunks]).cast(pa.int64())
            deal = np.concatenate([x[4] for x in held])
            turn = np.where(held_out, ROUNDS, (deal.view(U) % U(ROUNDS)).astype(np.int64))
            order, starts = np.lexsort((deal, turn)), np.cumsum(counts) - counts
            turn, deal, held_out, doc_ids, counts, starts = turn[order], deal[order], held_out[order], doc_ids.take(pa.array(order)), counts[order], starts[order]
            h = h[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(h))]
            turns = np.cumsum(np.bincount(turn + 1, counts, minlength=ROUNDS + 2)[: ROUNDS + 1]).astype(np.int64)
            idx, held, size = np.repeat(np.arange(len(counts)), counts), [], 0
            ids = m.ids(h)
            rare = ids - CLASSES * PER_CLASS
            spelled = np.bincount(idx[rare >= 0] * SPELLED + rare[rare >= 0], minlength=len(counts) * SPELLED).reshape(-1, SPELLED)
            slot, has = table.slots(h)
            logs = np.where(has, table.logs[slot], 0.0)
            sums = [np.bincount(idx, x, minlength=len(counts)) for x in (logs, logs * (rare >= 0), has & (table.train[slot] > 0))]
            own = {"doc_id": doc_ids, "held_out": pa.array(held_out), "n_tokens": pa.array(counts), "spelled": pa.array(spelled.tolist(), pa.list_(pa.int64())), "logs": pa.array(sums[0]), "rare": pa.array(sums[1]), "known": pa.array(sums[2])}
            rows = [(task, task % parts, _ipc(pa.table(own)), ids.astype(np.uint16).tobytes(), int(turns[-1]), np.stack([deal, counts], 1)[~held_out].tobytes(), turns.tolist(), b"", b"", b"", b"")]
            # the low bits of a word of the network say so
            h, idx = np.where(rare < 0, (h & ~U(15)) | U(8), h)[~has], idx[~has]
            part = (mix(h) % U(parts)).astype(np.int64)
            order = np.lexsort((idx, h, part))
            h, idx, part = h[order], idx[order], part[order]
            ends = np.searchsorted(part, np.arange(parts + 1))
            trains = ~held_out[idx]
            for p in np.flatnonzero(np.diff(ends)).tolist():
                a, b = ends[p], ends[p + 1]
                first = np.flatnonzero(np.concatenate([[True], h[a + 1 : b] != h[a : b - 1]]))
                n, train = np.diff(np.append(first, b - a)), np.add.reduceat(trains[a:b].astype(np.int64), first)
                rows.append((task, p, None, None, None, None, None, pack(np.diff(h[a:b][first], prepend=U(0))), pack(n.astype(np.uint32)), pack(train.astype(np.uint32)), pack(idx[a:b].astype(np.uint32))))
            yield from pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names).to_batches()

        for batch in batches:
            for t in steps(batch):
                h, counts, _ = tokens(t.column("text").combine_chunks())
                held.append((h, counts, t.column("doc_id"), t.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), t.column("deal").combine_chunks().to_numpy()))
                size += len(h)
                if size >= MESSAGE:
                    yield from message()
        if held:
            yield from message()

    return docs.select("doc_id", "held_out", "text", F.xxhash64("doc_id", "text").alias("deal")).mapInArrow(run, _MESSAGE)


def _scores(messages: DataFrame, model) -> DataFrame:
    """Rows (task, net): what the network says of the texts of each task. The texts of many messages are scored side
    by side, since the network's steps are as many as the longest text has tokens."""

    def run(batches):
        held, size = [], 0

        def scored():
            nonlocal held, size
            one_thread()
            net = model.value.log10(np.concatenate([x[1] for x in held]).astype(np.int64), np.concatenate([x[2] for x in held]))
            cut = np.split(net, np.cumsum([len(x[2]) for x in held])[:-1])
            tasks, held, size = [x[0] for x in held], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary())], names=["task", "net"])

        for batch in batches:
            for task, ids, docs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((task, np.frombuffer(ids, np.uint16), _table(docs).column("n_tokens").to_numpy()))
                size += len(held[-1][1])
                if size >= ABREAST:
                    yield from scored()
        if held:
            yield from scored()

    return messages.filter("ids is not null").select("task", "ids", "docs").mapInArrow(run, "task long, net binary")


def _counted(t: pa.Table) -> pa.Table:
    """Counts of one part's seldom tokens over all training texts, back to the tasks as sums for each of their texts:
    log10(c + 1) of all tokens and of those that are not the network's, and how many are known. One row has totals."""
    hs = [np.cumsum(unpack(b, U), dtype=U) for b in t.column("h").to_pylist()]
    trains = [unpack(b, np.uint32) for b in t.column("train").to_pylist()]
    words, at = np.unique(np.concatenate(hs), return_inverse=True)
    c = np.bincount(at, np.concatenate(trains), minlength=len(words))
    code = (words & U(15)).astype(np.int64)
    totals = np.concatenate([np.bincount(code, c, minlength=16)[:9], np.bincount(code, c > 0, minlength=16)[:9]]).astype(np.int64)
    logs, known, rare = np.log10(c + 1), c > 0, code < 8
    ends, out = np.cumsum([0] + [len(h) for h in hs]), []
    for i, (n, idx) in enumerate(zip(t.column("n").to_pylist(), t.column("idx").to_pylist(), strict=True)):
        which = np.repeat(at[ends[i] : ends[i + 1]], unpack(n, np.uint32).astype(np.int64))
        doc = unpack(idx, np.uint32).astype(np.int64)
        sums = [np.bincount(doc, w[which]) for w in (logs, logs * rare, known)]
        out.append((*[s.astype(np.float64).tobytes() for s in sums[:2]], pack(sums[2].astype(np.uint32))))
    cols = list(zip(*out, strict=True))
    first = [totals.tolist()] + [None] * (t.num_rows - 1)
    return pa.table([t.column("task"), t.column("docs"), *[pa.array(x, pa.binary()) for x in cols], pa.array(first, pa.list_(pa.int64()))], names=["task", "docs", "logs", "rare", "known", "totals"])


def score(docs: DataFrame, held_out: Column, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Counts are of the texts that are not held out. base_score is the add-one unigram log10-likelihood, score
    the network's log10-likelihood, both of the text's words and its end. A null text is empty, its one
    token is the end; null doc_ids are kept; repeated rows count as often as they stand, but train the network once;
    the same rows give the same scores however they are split, in any order; an empty table gives no rows; other columns are not read. doc_id is a whole number.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    start, often, seldom = _vocabulary(rows, int(max(12, n_bytes // 24 // PART)))
    context = docs.sparkSession.sparkContext
    if model is not None:  # its frequent words are others
        used = often.word != 0
        often = Often(often.word[used], often.train[used], often.train[used], model)
    parts = max(12, seldom // PART)
    messages = materialize(_messages(rows, parts, context.broadcast(model or start), context.broadcast(often)), "messages")
    sent = messages.select("task", "part", "docs", "h", "n", "train", "idx").groupBy("part").applyInArrow(_counted, "task long, docs binary, logs binary, rare binary, known binary, totals array<long>")
    sent = materialize(sent, "counts")
    model = model or learn(messages, start)
    nets = _scores(messages, context.broadcast(model))
    totals = often.totals.copy()
    for r in sent.filter("totals is not null").select(F.posexplode("totals").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():  # 18 rows
        totals[r["k"]] += r["n"]
    n, v = totals[:9].sum(), totals[9:].sum()
    floor = np.log10(totals[:8] + totals[9:17] + 1)

    def finish(t: pa.Table) -> pa.Table:
        own, said = (next(b for b in t.column(c).to_pylist() if b is not None) for c in ("docs", "net"))
        own = _table(own)
        size = own.num_rows
        sums = [own.column(c).to_numpy().astype(float) for c in ("logs", "rare", "known")]
        for kind, name in enumerate(("logs", "rare", "known")):
            for b in filter(None, t.column(name).to_pylist()):
                x = unpack(b, np.uint32) if name == "known" else np.frombuffer(b, np.float64)
                sums[kind][: len(x)] += x
        count = own.column("n_tokens").to_numpy()
        spelled = np.array(own.column("spelled").to_pylist(), float).reshape(size, SPELLED)
        net = np.frombuffer(said) + sums[1] - spelled @ floor
        return pa.table([own.column("doc_id"), own.column("held_out"), pa.array(count), pa.array(sums[2].astype(np.int64)), pa.array(np.full(size, int(n))), pa.array(sums[0] - count * np.log10(n + v + 1)), pa.array(net)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return sent.unionByName(nets, allowMissingColumns=True).groupBy("task").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
