"""Toxicity by a bidirectional gated recurrent network with attention pooling over all windows of a text.

A word comes in as two vectors: one of the whole word, by its hash, and the mean of those of its character
trigrams, so that spellings of a word share the second. Two recurrent layers read a window forwards and
backwards; attention weighs their states; a logistic unit scores the window. Windows overlap, so that
what is said is seen whole in one of them, and a text's score is that of its highest window. Training sees
labels of texts only: each step the highest of a text's likely windows answers for the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .textkit import U, Words, map_texts, mix

#: Words of a window and of the stride; units of each direction; sizes of vectors and of their tables.
WINDOW, STRIDE, HIDDEN, VEC, WORD_ROWS, CHAR_ROWS = 40, 30, 8, 6, 1 << 15, 1 << 13
#: Labelled texts sampled for each label at most; updates, texts in each, windows of a text in training, rate.
SAMPLE, UPDATES, BATCH, WINDOWS, RATE = 900, 300, 32, 3, 0.02
#: A text is marked from this score on.
THRESHOLD = 0.7


def trigrams(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character table for each trigram of the chosen words, with a mark at both ends; trigrams of each."""
    s, e = words.start[which], words.end[which]
    n = np.maximum(e - s, 1)  # of the word between two blanks, its length
    at = np.repeat(s - 1, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    b = np.append(words.body, [32, 32]).astype(np.uint32)
    # a blank on either side is a mark, whichever blank stands there
    h = (b[at] * np.uint32(b[at] > 32) * np.uint32(65599) + b[at + 1]) * np.uint32(65599) + b[at + 2] * np.uint32(b[at + 2] > 32)
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.int64) % CHAR_ROWS, n


def rows_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct words: row of the word table, trigram rows, trigrams of each; and each word's number among them."""
    h, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    chars, n = trigrams(words, first)
    return (mix(h) % U(WORD_ROWS)).astype(np.int64), chars, n, which


def cut(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word in it of every window; a text without words has one empty window."""
    n = np.maximum(1, -(-(n_words - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n_words)), n)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


@dataclass
class Model:
    p: dict[str, np.ndarray]

    def inputs(self, word_rows: np.ndarray, chars: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Vectors of distinct words; the last row stands for no word."""
        p = self.p
        if not len(n):
            return np.zeros((1, 2 * VEC), np.float32)
        means = np.add.reduceat(p["char"][chars], np.cumsum(n) - n, axis=0) / n[:, None]
        return np.vstack([np.hstack([p["word"][word_rows], means]), np.zeros((1, 2 * VEC), np.float32)]).astype(np.float32)

    def run(self, x: np.ndarray, ids: np.ndarray, train: bool = False):
        """Logits of windows: ids (T, B) number rows of x, its last row where a window has ended."""
        p, t, b = self.p, *ids.shape
        keep = (ids < len(x) - 1).astype(np.float32)
        zero = np.zeros((b, HIDDEN), np.float32)
        xf, xb = x @ p["xf"] + p["bf"], x @ p["xb"] + p["bb"]
        f, cf = gru.forward(xf[ids], p["hf"], zero, keep=keep)
        r, cr = gru.forward(xb[ids[::-1]], p["hb"], zero, keep=keep[::-1])
        s = np.concatenate([f, r[::-1]], axis=2)
        u = np.tanh(s @ p["a"] + p["ab"])
        e = np.where(keep > 0, u @ p["v"], -30.0).astype(np.float32)
        w = np.exp(e - e.max(0)) * keep
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", w, s)
        logit = pooled @ p["o"] + p["ob"][0]
        return logit, (keep, cf, cr, s, u, w, pooled) if train else None

    def scores(self, words: Words) -> np.ndarray:
        """Score of each text: of its highest window."""
        word_rows, chars, n, which = rows_of(words)
        x = self.inputs(word_rows, chars, n)
        doc, at = cut(words.counts)
        first = np.cumsum(words.counts) - words.counts
        out = np.full(len(words.counts), -np.inf)
        which = np.append(which, len(x) - 1)
        for i in range(0, len(doc), 4096):
            d, a = doc[i : i + 4096], at[i : i + 4096]
            t = np.arange(WINDOW)[:, None] + a
            ids = which[np.where(t < words.counts[d], first[d] + t, len(which) - 1)]
            np.maximum.at(out, d, self.run(x, ids)[0])
        return gru.sigmoid(out)


def fit(texts: list[str], toxic: list[int], seed: int = 5, updates: int = UPDATES) -> Model:
    """Trains on labelled texts. The first number of each vector starts as the evidence that the word, or the
    trigram, gives by itself; the rest is learned."""
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale=0.1: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"word": f32(WORD_ROWS, VEC), "char": f32(CHAR_ROWS, VEC), "hf": f32(HIDDEN, 3 * HIDDEN, scale=0.3), "hb": f32(HIDDEN, 3 * HIDDEN, scale=0.3), "xf": f32(2 * VEC, 3 * HIDDEN, scale=0.4), "xb": f32(2 * VEC, 3 * HIDDEN, scale=0.4),
         "bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32), "a": f32(2 * HIDDEN, HIDDEN, scale=0.3), "ab": np.zeros(HIDDEN, np.float32), "v": f32(HIDDEN, scale=0.3), "o": f32(2 * HIDDEN, scale=0.3), "ob": np.full(1, -1.0, np.float32)}
    model, y = Model(p), np.array(toxic)
    if not len(y) or y.min() == y.max():
        p["o"][:] = 0
        p["ob"][:] = -4.0 if not len(y) or y.max() == 0 else 4.0
        return model
    words = Words(pa.array(texts, pa.string()))
    word_rows, chars, n_chars, which = rows_of(words)
    counts, first = words.counts, np.cumsum(words.counts) - words.counts

    def evidence(rows: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
        pairs = np.unique(doc * size + rows)
        has = [np.bincount(pairs[y[pairs // size] == k] % size, minlength=size) for k in (0, 1)]
        rate = [(has[k] + 0.5) / ((y == k).sum() + 1) for k in (0, 1)]
        sure = np.minimum(1.0, (has[0] + has[1]) / 5)
        return (np.clip(np.log(rate[1] / rate[0]), -3, 3) * sure).astype(np.float32)

    p["word"][:, 0] = evidence(word_rows[which], words.doc, WORD_ROWS) / 2
    every = trigrams(words, np.arange(len(words.start)))
    p["char"][:, 0] = evidence(every[0], np.repeat(words.doc, every[1]), CHAR_ROWS) / 2
    # likely windows of each text: those with the strongest word, then any
    doc, at = cut(counts)
    strong = np.append(p["word"][word_rows, 0][which], -9.0)
    t = np.arange(WINDOW)[:, None] + at
    places = np.where(t < counts[doc], first[doc] + t, len(which))
    top = strong[places].max(0) + rng.random(len(doc)) * 0.2
    order = np.lexsort((-top, doc))
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(np.bincount(doc)) - np.bincount(doc), np.bincount(doc))
    chosen = order[rank < WINDOWS]
    of_text = [chosen[doc[chosen] == i] for i in range(len(y))]
    which = np.append(which, len(word_rows))
    adam, pos, neg = gru.Adam(p, RATE), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for u in range(updates):
        batch = np.concatenate([rng.choice(pos, BATCH // 2), rng.choice(neg, BATCH // 2)])
        wins = [of_text[i] for i in batch]
        ids = which[places[:, np.concatenate(wins)]]
        # only the words at hand
        own, inner = np.unique(ids[ids < len(word_rows)], return_inverse=True)
        local = np.full(ids.shape, len(own))
        local[ids < len(word_rows)] = inner
        ends = np.cumsum(n_chars)
        cs = np.concatenate([chars[ends[i] - n_chars[i] : ends[i]] for i in own])
        x = model.inputs(word_rows[own], cs, n_chars[own])
        logit, (keep, cf, cr, s, un, w, pooled) = model.run(x, local, train=True)
        bounds = np.cumsum([0] + [len(k) for k in wins])
        best = np.array([a + int(np.argmax(logit[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        d = np.zeros(len(logit), np.float32)
        d[best] = (gru.sigmoid(logit[best]) - y[batch]) / len(batch)
        g = {"o": pooled.T @ d, "ob": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["o"]
        ds = w[:, :, None] * dp
        dw = np.einsum("tbh,bh->tb", s, dp)
        de = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tb,tbh->h", de, un)
        du = de[:, :, None] * p["v"] * (1 - un * un)
        g["a"], g["ab"] = np.einsum("tbi,tbj->ij", s, du), du.sum((0, 1))
        ds = (ds + du @ p["a"].T).astype(np.float32)
        dxf, g["hf"] = gru.backward(ds[:, :, :HIDDEN], cf, p["hf"], keep=keep)
        dxb, g["hb"] = gru.backward(ds[::-1, :, HIDDEN:], cr, p["hb"], keep=keep[::-1])
        flat = lambda z: np.stack([np.bincount(local.reshape(-1), z[..., j].reshape(-1), minlength=len(x)) for j in range(z.shape[2])], axis=1).astype(np.float32)
        gf, gb = flat(dxf), flat(dxb[::-1])
        g["xf"], g["xb"], g["bf"], g["bb"] = x.T @ gf, x.T @ gb, gf.sum(0), gb.sum(0)
        dx = (gf @ p["xf"].T + gb @ p["xb"].T)[:-1]
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], word_rows[own], dx[:, :VEC])
        np.add.at(g["char"], cs, np.repeat(dx[:, VEC:] / n_chars[own][:, None], n_chars[own], axis=0))
        adam.update(g, RATE * (1 - 0.9 * u / updates))
    return model


def sample(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most per_label usable texts of each label, those with the least digest. A document whose labels
    disagree is left out; of several texts of one id the least by code point is taken, so that every run learns the same."""
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_m")).filter("toxic = _m")
    counts = {r[0]: r[1] for r in marks.filter(usable).groupBy("toxic").count().collect()}  # two rows
    if not counts:
        return [], []
    h = F.abs(F.xxhash64("doc_id", F.lit("toxic")))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, 2 * per_label / max(counts.get(1, 0), 1)))).otherwise(F.lit(min(1.0, 2 * per_label / max(counts.get(0, 0), 1))))
    few = marks.filter(usable).withColumn("_h", h).filter(F.col("_h") <= share * float(2**63))
    picked = [few.filter(F.col("toxic") == k).orderBy("_h").limit(per_label) for k in (0, 1)]
    ids = {r.doc_id: r.toxic for d in picked for r in d.collect()}
    wanted = docs.sparkSession.createDataFrame([(k,) for k in ids], "doc_id long") if ids else None
    rows = docs.filter("text is not null").join(F.broadcast(wanted), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect() if ids else []
    return [r.text for r in rows], [ids[r.doc_id] for r in rows]


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with score and predicted for each row of docs (text).

    score is that of the highest of all overlapping windows of the whole text, however long; an empty or null text has one
    window without words. Windows that tie give the same score. Repeated rows give repeated rows; an empty table gives none;
    columns beyond those in keep and text are not read.
    """
    fields = [f for f in docs.schema.fields if f.name in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(t: pa.Table) -> pa.Table:
        score = shared.value.scores(Words(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()))).astype(float)
        return pa.table([*[t.column(f.name) for f in fields], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*[f.name for f in fields], "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_texts(docs.select(*[f.name for f in fields if f.name != "text"], "text"), work, f"{schema}, score double, predicted int")
