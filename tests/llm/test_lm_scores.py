"""Scores of the language model: one token at a time by hand, and the same for any split of the table."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duskline.llm import gru, lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(model, texts, trained):
    """log10 probability of each text: class, then the word in it; outside of the network a word's share is by count."""
    end, edge = "\0end", lm.CLASSES * lm.PER_CLASS
    tokens = [[*WORD.findall(t), end] for t in texts]
    every = sorted({w for ws in tokens for w in ws if w != end})
    number = dict(zip(every, model.ids(lm.tokens(pa.array([" ".join(every)]))[0]).tolist(), strict=False))
    number[end] = int(model.ids(np.array([lm.END]))[0])
    counts = collections.Counter(w for t, ws in zip(texts, tokens, strict=True) if t in trained for w in ws)
    of = lambda w: number[w] - edge
    total, kinds = collections.Counter(), collections.Counter()
    for w, n in counts.items():
        if of(w) >= 0:
            total[of(w)] += n
            kinds[of(w)] += 1
    p = {k: v.astype(float) for k, v in model.p.items()}
    share = lambda a: a - np.log(np.exp(a - a.max()).sum()) - a.max()
    out = []
    for ws in tokens:
        h, prev, sum_ = np.zeros((1, lm.HIDDEN)), edge + lm.SPELLED, 0.0
        for w in ws:
            h, y = gru.step(p["x"][[prev]], h, p["h"]), number[w]
            k = y // lm.PER_CLASS if y < edge else y - edge + lm.CLASSES
            sum_ += share(h[0] @ p["c"] + p["cb"])[k] / np.log(10)
            if y < edge:
                sum_ += share(h[0] @ p["w"][k] + p["wb"][k])[y % lm.PER_CLASS] / np.log(10)
            else:
                sum_ += np.log10((counts[w] + 1) / (total[y - edge] + kinds[y - edge] + 1))
            prev = y
        out.append(sum_)
    return out


def test_scores_by_hand(spark):
    rng = random.Random(3)
    words = [f"{rng.choice(['ab', 'Zü', '12', 'ж'])}{i}" for i in range(1600)]
    texts = [" ".join(words[min(1599, int(rng.expovariate(0.004)))] for _ in range(rng.randrange(1, 90))) for _ in range(120)] + [""]
    texts = sorted({t.translate({c: c + 32 for c in range(65, 91)}) for t in texts})
    model = lm.fit(texts[:100], updates=15)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") % 5 == 0, model).collect()}
    want = by_hand(model, texts, {t for i, t in enumerate(texts) if i % 5})
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-4)


def test_scores_do_not_depend_on_the_split(spark, monkeypatch):
    """Several messages, buckets and levels of sums; ids that are null or repeated, in three splits and orders."""
    for name, value in (("MESSAGE", 2500), ("GROUPS", 2), ("JOINED", 2), ("UPDATES", 10)):
        monkeypatch.setattr(lm, name, value)
    rng = random.Random(4)
    rows = [(None if i % 50 == 7 else i, None if i % 61 == 3 else " ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(0, 160)))) for i in range(900)]
    rows += rows[:20] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def scores(d):
        return sorted((r.doc_id or -1, r.n_tokens, round(r.base_score, 6), r.score) for r in lm.score(d, F.coalesce(F.col("doc_id"), F.lit(1)) % 6 == 0).collect())

    first = scores(docs.repartition(1))
    for split in (docs.repartition(7), docs.orderBy(F.desc("text")).coalesce(3)):
        other = scores(split)
        assert [x[:3] for x in other] == [x[:3] for x in first]
        assert [x[3] for x in other] == pytest.approx([x[3] for x in first], rel=1e-6)
