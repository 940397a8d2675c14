"""Language identification by nearest centroid of normalised TF-IDF vectors of letter n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import Words, map_texts, trim

#: Hashed n-gram dimensions; centroids for each language; labelled rows read for each language at most.
DIMS, CENTROIDS, SAMPLE = 4096, 4, 400
#: A text is rejected below what all but TAIL of rows that were held out reach at its length, at most halfway down
#: to what ALIEN of them reach at other languages' centroids. Lengths are measured on cuts of so many words.
TAIL, ALIEN, LEVELS = 0.02, 0.95, (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
UND = "und"
#: Texts whose vectors are made at once in learning.
BATCH = 50


def vectors(texts: pa.Array, dims: int = DIMS) -> np.ndarray:
    """Square roots of counts of hashed 1- to 4-byte n-grams of each text with a blank before and after it, a row
    for each text. No n-gram reaches into a neighbouring text, so a row does not depend on what else is in texts."""
    w = Words(pc.utf8_lower(texts.fill_null("")), lower=False)
    n = len(w.counts)
    if not n:
        return np.zeros((0, dims), np.float32)
    body = w.body.astype(np.uint32)
    body[(body >= 48) & (body <= 57)] = 48
    doc = np.repeat(np.arange(n), np.diff(w.offsets) + 1)  # of a text's bytes and the blank before them
    out = np.zeros(n * dims, np.float32)
    gram = body
    for k in range(1, 5):
        if k > 1:
            gram = gram[: len(body) - k + 1] * np.uint32(257) + body[k - 1 :]
        many = max(0, len(body) - max(k, 2) + 1)
        # the last byte may be the blank after the text, the one before it may not
        whole = doc[:many] == (doc[k - 2 : k - 2 + many] if k > 1 else doc[:many])
        h = gram[:many][whole]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        at = (h >> np.uint32(20)).astype(np.int64) % dims
        out += np.bincount(doc[:many][whole] * dims + at, minlength=n * dims).astype(np.float32)
    return np.sqrt(out.reshape(n, dims))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """Centroids with the language of each, IDF weights, and least accepted likeness by the log of n-grams."""

    langs: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def nearest(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, likeness 0 to 1, and whether the text is too far from every centroid."""
        likeness, size = self.likeness(texts)
        best = likeness.argmax(1)
        score = np.clip(likeness[np.arange(len(best)), best], 0, 1).astype(float)
        return self.owner[best], score, score < np.interp(size, self.sizes, self.least)

    def likeness(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of each text to each centroid, and the log of its n-grams."""
        x = vectors(texts)
        size = np.log1p((x * x).sum(1))
        return _unit(x * self.idf) @ self.centroids.T, size


def _centred(rows: list[tuple[str, str]], centroids: int, seed: int) -> Model:
    """IDF, then spherical k-means in each language from evenly spread starts; rejects nothing yet."""
    rng = np.random.default_rng(seed)
    langs = sorted({r[1] for r in rows})
    seen = np.zeros(DIMS, np.int64)
    for i in range(0, len(rows), BATCH):  # vectors are made again for each language, so that those of one are held at once
        seen += (vectors(pa.array([r[0] for r in rows[i : i + BATCH]], pa.string())) > 0).sum(0)
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    found, owner = [], []
    for k, lang in enumerate(langs):
        of = [r[0] for r in rows if r[1] == lang]
        own = np.concatenate([_unit(vectors(pa.array(of[i : i + BATCH], pa.string())) * idf) for i in range(0, len(of), BATCH)])
        c = own[rng.choice(len(own), min(centroids, len(own)), replace=False)]
        for _ in range(12):
            near = (own @ c.T).argmax(1)
            c = _unit(np.stack([own[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
        found.append(c)
        owner += [k] * len(c)
    return Model(langs, np.concatenate(found).astype(np.float32), np.array(owner), np.zeros(1), np.zeros(1), idf)


def fit(rows: list[tuple[str, str]], centroids: int = CENTROIDS, seed: int = 7) -> Model:
    """Learns centroids from (text, lang) rows, and the least likeness from rows that half of them have not seen.

    A text's likeness grows with its length, so the floor is set at each of several lengths, from the first
    words of held-out rows: against their own language, and against all others as rows that no one learned.
    """
    model = _centred(rows, centroids, seed)
    at: dict[str, int] = {}
    half = [at.__setitem__(lang, at.get(lang, 0) + 1) or at[lang] % 2 for _, lang in rows]
    seen = _centred([r for r, h in zip(rows, half, strict=True) if h], centroids, seed)
    held = [r for r, h in zip(rows, half, strict=True) if not h] or rows
    words = [(t.split(None, LEVELS[-1])[: LEVELS[-1]], seen.langs.index(lang)) for t, lang in held]
    sizes, least = [], []
    for n in LEVELS:
        cut = [(" ".join(w[:n]), k) for w, k in words if len(w) >= n]
        if not cut:
            break
        parts = [seen.likeness(pa.array([c[0] for c in cut[i : i + BATCH]], pa.string())) for i in range(0, len(cut), BATCH)]
        likeness, size = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        own = np.array([c[1] for c in cut])[:, None] == seen.owner
        low = np.quantile(np.where(own, likeness, 0).max(1), TAIL)
        alien = np.quantile(np.where(own, 0, likeness).max(1), ALIEN)
        sizes.append(np.median(size))
        least.append((low + min(low, alien)) / 2)
    if sizes:
        model.sizes, model.least = np.maximum.accumulate(sizes), np.array(least)
    return model


def sample(docs: DataFrame, usable: Column, per_lang: int = SAMPLE) -> list[tuple[str, str]]:
    """At most per_lang labelled rows of each language, those with the least digest of their content.

    Languages with more rows are thinned by digest before any ordering, so no language's rows meet in a task.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.abs(F.xxhash64("doc_id", F.lit("lang"))).alias("_h"), "text")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3 * per_lang / n))])
    thin = rows.filter(F.col("_h") <= share[F.col("lang")] * float(2**63))
    top = thin.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))).filter(F.col("_r") <= per_lang)
    return [(r.text, r.lang) for r in top.orderBy("lang", "_r").select("text", "lang").collect()]


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with lang_pred, score, rejected, for each row of docs.

    lang_pred is the language of the nearest centroid, score the cosine to it. A null text, and one without
    a letter, is `und` with score 0 and rejected; one that is farther from every centroid than nearly all
    held-out rows of its length keeps its nearest language and is rejected. Without a model (no labelled row) all are
    `und`. Repeated rows give repeated rows; an empty table gives none.
    """
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, rejected boolean"])
    trim()  # the driver lives on, and what learning the model freed is some 100 MB
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(t: pa.Table) -> pa.Table:
        m = shared.value
        text = t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string())
        letter = pc.match_substring_regex(text, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
        if m is None:
            lang, score, far = np.full(len(text), UND, object), np.zeros(len(text)), np.ones(len(text), bool)
        else:
            at, score, far = m.nearest(text)
            lang = np.where(letter, np.array(m.langs, object)[at], UND)
            score, far = np.where(letter, score, 0.0), far | ~letter
        return pa.table([t.column(f.name) for f in fields] + [pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(far)], names=[f.name for f in fields] + ["lang_pred", "score", "rejected"])

    return map_texts(docs.select(*[f.name for f in fields if f.name != "text"], "text"), work, schema)
