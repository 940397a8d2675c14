"""The ten operators and the pipeline against brute force, on small tables with all the odd cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duskline.llm import chat, decontaminate, iblt, jaccard, langid, lm, mix, pii, suffixes, toxicity
from duskline.llm.textkit import Words, distinct_pairs, pack, unpack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, size long, uid string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdeéüñ") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with copies, near copies, shared passages, nulls, empties, repeated rows and long ones; the columns
    after n_chars clash with names that operators use."""
    rng = random.Random(2)
    words = vocabulary(rng)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, rows = text(60), []
    for i in range(40):
        rows.append(text(rng.randrange(1, 90)))
    for i in range(12):
        w = rows[i].split()
        if len(w) > 20:
            w[rng.randrange(len(w))] = "edited"
        rows.append(" ".join(w))
    rows += [rows[3], rows[3], passage + " " + text(20), text(30) + "\n" + passage, text(10) + " " + passage, None, "", "  \n\t ", "one", "One", "two words", text(6000), "a" * 500, "a" * 400, "é" * 150]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), len(t or ""), 0.5, 7, 3, "x") for i, t in enumerate(rows)]
    out += [out[5], (None, rows[2], "en", "s1", 1, None, None, None, None)]
    return spark.createDataFrame(out, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_packing_and_words():
    a = np.array([1, 2**40, 3], np.uint64)
    assert (unpack(pack(a), np.uint64) == a).all() and not len(unpack(pack(a[:0]), np.uint64))
    w = Words(pa.array(["Ab  c\x0bd", None, "", " AB "]))
    assert w.counts.tolist() == [3, 0, 0, 1] and w.hash[0] == w.hash[3]
    assert len(Words(pa.array([], pa.string())).hash) == 0
    d, h = distinct_pairs(np.array([0, 0, 1]), np.array([5, 5, 5], np.uint64))
    assert d.tolist() == [0, 1] and h.tolist() == [5, 5]


@pytest.mark.parametrize("leaf", [1, 2000])
def test_near_duplicates(docs, rows, leaf, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.near_duplicates(docs).collect()}
    sets = {k: shingles(t) for k, t in rows if k is not None}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    want = {(k, len(s)): find(k) for k, s in sets.items()}
    want[None, len(shingles(dict((k, t) for k, t in rows if k is None)[None]))] = None
    assert got == want


def near_texts(rng, n, spread):
    """Texts around a few others: links, chains of links, and many that are almost linked."""
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(3)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(spread)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def linked_groups(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def test_regions_by_several_pivots():
    """Cells and windows lose no link, and items that hang together are not measured one by one."""
    for seed in range(6):
        texts = near_texts(random.Random(seed), 150, 1 + seed)
        hashed = jaccard.shingle_sets(pa.array(texts))
        task = jaccard.Task([hashed[1][hashed[0] == i] for i in range(len(texts))])
        jaccard.solve(list(range(len(texts))), task)
        got, want = [task.groups.find(i) for i in range(len(texts))], linked_groups(texts)
        assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))
        assert task.done.sum() <= len(set(want)) + 4 * jaccard.PIVOTS
    d = np.array([[0.0, 0.1, 0.9, 0.8], [0.9, 0.9, 0.0, 0.2]])
    assert jaccard.cells(d).tolist() == [[True, True, False, False], [False, False, True, True]]


def test_large_regions_in_rounds(spark, monkeypatch):
    for name, x in (("LEAF", 20), ("WIDE", 6), ("GATHER", 2000)):
        monkeypatch.setattr(jaccard, name, x)
    texts = near_texts(random.Random(3), 240, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == dict(enumerate(linked_groups(texts)))


def test_shared_text_alone_makes_no_region():
    """Sets that share three quarters of their shingles and no more are not linked: no shingle of the inner windows
    is common to them, so not one pair is measured."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 75, dtype=np.uint64)
    rows = [np.sort(np.concatenate([common, rng.integers(0, 1 << 62, 25, dtype=np.uint64)])) for _ in range(300)]
    doc, h, n = np.repeat(np.arange(300), 100), np.concatenate(rows), np.full(300, 100)
    table, bits = np.zeros(jaccard.SLOTS, np.uint8), 40
    table[(jaccard.mix(common >> np.uint64(64 - bits)) % np.uint64(jaccard.SLOTS)).astype(np.int64)] = 8
    outer, inner = jaccard.windows(doc, h, n, table, bits)
    assert inner.sum() == 300 * (100 - 86 + 1 + 6) and not np.isin(h[inner], common).any() and np.isin(h[outer], common).any()


def test_language(docs, spark):
    rng = random.Random(5)
    en, fr = ["the", "of", "and", "that", "with"], ["les", "été", "où", "ça", "des"]
    made = [(" ".join(rng.choice(w) for _ in range(30)), lang) for lang, w in (("en", en), ("fr", fr)) for _ in range(40)]
    model = langid.fit(made)
    df = spark.createDataFrame([(1, "the of and that THE"), (2, "LES ÉTÉ où ça"), (3, "123 !!!"), (4, None), (5, ""), (6, "中文字符漢字")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred) == ("en", "fr") and not got[1].rejected
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (3, 4, 5))
    assert got[6].lang_pred in ("en", "fr") and got[6].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    assert len(langid.sample(docs, F.lit(True), 3)) <= 6


def test_vectors_are_of_each_text_alone():
    """N-grams of a text between blanks, counted one by one; what stands beside it in the array changes nothing."""

    def brute(text):
        b, out = bytes(48 if 48 <= x <= 57 else x for x in f" {text.lower()} ".encode()), np.zeros(langid.DIMS)
        for k in range(1, 5):
            for i in range(len(b) - max(k, 2) + 1):
                g = 0
                for x in b[i : i + k]:
                    g = (g * 257 + x) % 2**32
                out[(((g ^ (g >> 15)) * 0x85EBCA6B) % 2**32 >> 20) % langid.DIMS] += 1
        return np.sqrt(out)

    texts = ["Hello wörld 123", "", "q", "zebra  crossing x ", "hello wörld 456"]
    got = langid.vectors(pa.array(texts))
    assert all(np.allclose(v, brute(t)) for v, t in zip(got, texts, strict=True))
    assert all((langid.vectors(pa.array([t]))[0] == v).all() for v, t in zip(got, texts, strict=True))
    assert langid.vectors(pa.array([], pa.string())).shape == (0, langid.DIMS)
    assert (langid.vectors(pa.array([None], pa.string())) == langid.vectors(pa.array([""]))).all()


def test_unlearned_languages_and_letter_junk_are_rejected(spark, sf_dir):
    """Latin letters alone bring no text near a language; clean documents stay, short ones too."""
    table = spark.read.parquet(f"{sf_dir[:-5]}0.01/documents.parquet").filter("text is not null").orderBy("doc_id")
    texts = collections.defaultdict(list)
    for r in table.collect():
        texts[r.lang].append(r.text)
    rng = random.Random(4)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(n)) for n in (5, 20, 60, 200) * 10]
    rejected = lambda model, rows: model.nearest(pa.array(rows, pa.string()))[2].mean()
    for left_out in texts:
        learned = {k: v for k, v in texts.items() if k != left_out}
        model = langid.fit([(t, k) for k, v in learned.items() for t in v[::2]])
        assert rejected(model, texts[left_out]) > 0.6 and rejected(model, junk) > 0.85
        clean = [t for v in learned.values() for t in v[1::2]]
        assert rejected(model, clean) < 0.08
        short = [t for t in clean if 4 <= len(t.split()) <= 40]
        assert short and rejected(model, short) < 0.08


def slow_coverage(item, text, least):
    """Longest unmarked common run first, all by direct comparison."""
    fi, ft, covered = [1] * len(item), [1] * len(text), 0
    while True:
        best, size = [], 0
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and fi[i + k] and ft[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k > size:
                    best, size = [(i, j)], k
                elif k == size and k:
                    best.append((i, j))
        if size < min(least, len(item)):
            return covered
        for i, j in best:
            if all(fi[i : i + size]) and all(ft[j : j + size]):
                fi[i : i + size] = ft[j : j + size] = [0] * size
                covered += size


def test_decontamination(spark, docs):
    rng = random.Random(9)
    words = vocabulary(rng, 60)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(8, 25))) for i in range(6)] + [(6, "tiny item"), (7, None), (8, "")]
    items += [(9, items[0][1]), (10, "tiny item")]
    rows = []
    for i, t in items[:6]:
        w = t.split()
        rows += [text(5) + " " + t + " " + text(5), " ".join(w[len(w) // 2 :]) + " zzz " + " ".join(w[: len(w) // 2]), " ".join(w[: len(w) // 3]), t.upper()]
    rows += ["a tiny item here", None, "", text(40)]
    d = spark.createDataFrame(list(enumerate(rows)) + [(0, rows[0])], "doc_id long, text string").withColumn("n", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    want = collections.Counter()
    for k, t in [*enumerate(rows), (0, rows[0])]:
        for i, x in items:
            w = split(x)
            if w and (c := slow_coverage(w, split(t), 5)) >= 0.75 * len(w):
                want[k, i, c] += 1
    for blocks in (1 << 20, 150):
        got = collections.Counter((r.doc_id, r.item_id, r.n_covered) for r in decontaminate.contaminated(d, it, broadcast_bytes=blocks).collect())
        assert got == want
    assert (1, 0) in {(k, i) for k, i, _ in want}
    dirty = {k for k, _, _ in want}
    for blocks in (1 << 20, 150):
        assert sorted(r.doc_id for r in decontaminate.clean(d, it, broadcast_bytes=blocks).collect()) == sorted(k for k in range(len(rows)) if k not in dirty)
    assert decontaminate.contaminated(d, it.limit(0), broadcast_bytes=-1).count() == 0 and decontaminate.contaminated(docs.limit(0), it, broadcast_bytes=1).count() == 0
    assert decontaminate.contaminated(d, it.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), it).count() == 0


def test_tiles_of_a_repeated_word():
    import time

    start = time.time()
    one = np.full(20_000, 7, np.uint64)
    assert decontaminate.tile(one[:200], one) == [(0, 0, 200)] and decontaminate.tile(one, one[:900]) == [(0, 0, 900)]
    text = np.concatenate([one[:50], np.arange(100, 130, dtype=np.uint64), one[:50]])
    assert sum(n for _, _, n in decontaminate.tile(np.concatenate([one[:80], text[50:80]]), text)) == 110
    assert time.time() - start < 5


def test_conversations(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (2, 2, "user", "ok"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "ok"), (4, 0, "user", "hi"), (4, 1, "bot", "no"), (5, 0, None, None), (6, 0, "", ""), (7, None, "user", "x"), (7, 0, "user", "y"), (7, 0, "user", "y"), (None, 0, "user", "hi")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("digest", F.lit(1))
    got = {r.conv_id: r for r in chat.maximal_conversations(df).collect()}
    assert set(got) == {2, 4, 5, 6, 7}
    assert got[2].n_snapshots == 2 and got[2].n_turns == 3 and got[7].n_turns == 2
    assert got[7].rendered == "<|user|>\ny<|end|>\n<|user|>\nx<|end|>\n"
    assert chat.maximal_conversations(df.limit(0)).count() == 0


def pieces(t):
    return {x[i : i + iblt.PIECE] for x in re.split(r"\n|(?<=[.!?|…]) |(?<=[。！？])", t) for i in range(0, len(x), iblt.PIECE)}


def test_fingerprints(docs, rows):
    docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    text = {k: t or "" for k, t in rows if k is not None}
    ids = sorted(text, reverse=True)
    parts = pieces
    like = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0
    got = {r.doc_id: r for r in iblt.fingerprints(docs).collect()}
    for i, k in enumerate(ids):
        t, n = text[k], text[ids[(i + 1) % len(ids)]]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert len(r.differing_edited) == len(set(r.differing_edited)) == len(parts(t) ^ parts(e)) and len(r.differing_next) == len(parts(t) ^ parts(n))
        assert len(t) <= 2 * iblt.PIECE or r.near_edited > 0
        assert r.near_edited == pytest.approx(like(parts(t), parts(e))) and r.near_next == pytest.approx(like(parts(t), parts(n)))
    same = collections.defaultdict(set)
    for k, r in got.items():
        same[text[k]].add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert iblt.fingerprints(docs.limit(0)).count() == 0


def test_fingerprints_cut_at_every_sentence_end(spark):
    """In lower case, before letters after E and with accents, in another script: whatever follows the end."""
    texts = ["one is. two is. three is.", "Zum Ersten. Für alle! Über uns? 9 of them.", "Été. Être là. Où?", "北京。上海！广州？", "no end here", "Aa bb. Cc dd."]
    got = {r.doc_id: r for r in iblt.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_paragraphs for i in range(6)] == [3, 4, 3, 3, 1, 2]
    assert got[0].near_edited > 0


def test_fingerprints_of_odd_ids(spark):
    """Null and repeated ids, one that lies far away, ids in other quantiles: each text meets its successor once."""
    rows = [(None, "null b"), (None, "null a"), (7, "x"), (7, "x"), (7, "y"), (1 << 60, "far")] + [(i, f"text {i}") for i in range(20, 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.text, r.next_text) for r in iblt.with_next(df).collect())
    line = sorted((r for r in rows if r[0] is not None), reverse=True) + sorted((r for r in rows if r[0] is None), key=lambda r: r[1], reverse=True)
    assert got == collections.Counter((k, t, line[(i + 1) % len(line)][1]) for i, (k, t) in enumerate(line))
    assert [tuple(r) for r in iblt.with_next(spark.createDataFrame([(None, "a")], "doc_id long, text string")).collect()] == [(None, "a", "a")]


def test_fingerprints_are_made_once_for_a_document(spark):
    """What is made of a text is handed to the document before it, also across slices, quantiles and from the first to the last."""
    rows = [(i, f"{i}." * (i % 7)) for i in range(1500)] + [(1 << 60, "far"), (None, "null")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = iblt.with_next(df, {"n": "length(text)", "m": "n + 1"}).collect()
    assert len(got) == len(rows) and all((r.n, r.m, r.next_n, r.next_m) == (len(r.text), len(r.text) + 1, len(r.next_text), len(r.next_text) + 1) for r in got)


def test_peeling_leaves_no_empty_cells(spark):
    """A cell that holds nothing is not looked at again; the digests of either side are read off with the right sign."""
    keys = lambda xs: f"transform(array({', '.join(f'{x}L' for x in xs)}), k -> named_struct('k', k, 'c', xxhash64(k, 7L)))"
    a, b = (iblt._masked(keys(xs), iblt.WIDTH) for xs in ([1, 2, 3, 4], [3, 4, 5]))
    cells = iblt._minus(iblt._cells(a, iblt.WIDTH), iblt._cells(b, iblt.WIDTH))
    r = spark.range(1).selectExpr(f"{iblt._left(cells)} AS t", f"{iblt._peel(cells, iblt.WIDTH)} AS p").first()
    assert 0 < len(r.t) <= 9 and all(x.n or x.k or x.c for x in r.t)
    assert r.p.whole and sorted(r.p.m) == [1, 2, 5]


def test_large_differences_are_whole(spark):
    a = "\n".join(f"left {i}" for i in range(700))
    b = "\n".join([f"right {i}" for i in range(300)] + [f"left {i}" for i in range(100)])
    df = spark.createDataFrame([(2, a), (1, b)], "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in iblt.fingerprints(df).collect()}
    assert got[2] == pytest.approx(200 / 1100) == got[1]


def test_mixing(spark, docs):
    rows = [(i, s, n) for s, k, n in (("a", 40, 30), ("b", 60, 50), ("c", 5, 10), (None, 200, 20)) for i in range(k)]
    df = spark.createDataFrame([(j, s, n) for j, (_, s, n) in enumerate(rows)], "doc_id long, source string, words int").withColumn("target", F.lit("clash")).repartition(5)
    got = mix.fair_queue(df, F.col("words").cast("long")).collect()
    size = collections.Counter()
    for _, s, n in rows:
        size[s] += n
    weight, total, target, capped = dict(zip(["a", "b", "c", None], (5, 2, 1, 5))), sum(size.values()), {}, {}
    while True:
        left = total - sum(capped.values())
        w = sum(weight[s] for s in size if s not in capped)
        target = {s: capped.get(s, left * weight[s] / w if w else 0) for s in size}
        over = {s: 3 * size[s] for s in size if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size and r.taken % r.size == 0
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in size)
    again = mix.fair_queue(df.repartition(2), F.col("words").cast("long")).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    assert mix.fair_queue(docs, mix.n_words(F.col("text"))).count() == docs.count()
    assert mix.fair_queue(docs.limit(0), mix.n_words(F.col("text"))).count() == 0


def test_toxicity(spark, docs):
    rng = random.Random(3)
    words = vocabulary(rng, 200)
    make = lambda bad, n: " ".join([*(rng.choice(words) for _ in range(n)), *(["zmoron"] if bad else []), *(rng.choice(words) for _ in range(n))])
    y = [i % 2 for i in range(240)]
    model = toxicity.fit([make(b, rng.randrange(3, 60)) for b in y], y, updates=80)
    test = spark.createDataFrame([(i, make(i % 2, 50)) for i in range(60)] + [(98, None), (99, "")], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.scored(test, model).collect()}
    assert np.mean([got[i].predicted == i % 2 for i in range(60)]) > 0.9
    assert got[98].score == got[99].score and 0 <= got[98].score <= 1
    long = " ".join(rng.choice(words) for _ in range(3000))
    hidden = spark.createDataFrame([(1, long), (2, long + " zmoron ")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.scored(hidden, model).collect()}
    assert s[2] > s[1]
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert toxicity.fit([], []).scores(Words(pa.array(["x"])))[0] < 0.7
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.sample(docs, labels, F.lit(True))[1] == [1]


def test_gradients_of_the_network():
    from duskline.llm import gru

    rng = np.random.default_rng(0)
    xp, wh, h0 = rng.standard_normal((4, 3, 12)), rng.standard_normal((4, 12)) * 0.4, rng.standard_normal((3, 4)) * 0.1
    keep, reset = np.array([[1, 1, 0], [1, 0, 1], [1, 1, 1], [0, 1, 1]], float), np.array([[0, 0, 1], [0, 1, 0], [0, 0, 0], [1, 0, 0]], float)
    up = rng.standard_normal((4, 3, 4))
    loss = lambda: float((gru.forward(xp, wh, h0, keep, reset)[0] * up).sum())
    dxp, dwh = gru.backward(up, gru.forward(xp, wh, h0, keep, reset)[1], wh, keep, reset)
    for a, g in ((xp, dxp), (wh, dwh)):
        for _ in range(12):
            i = tuple(rng.integers(n) for n in a.shape)
            old, e = a[i], 1e-5
            a[i] = old + e
            hi = loss()
            a[i] = old - e
            lo = loss()
            a[i] = old
            assert (hi - lo) / (2 * e) == pytest.approx(g[i], abs=1e-4)


@pytest.mark.parametrize("slots", [lm.SLOTS, 64])
def test_language_model(docs, rows, slots, monkeypatch):
    monkeypatch.setattr(lm, "SLOTS", slots)  # with 64, most words go the way of seldom ones
    model = lm.fit([t for _, t in rows if t], updates=20)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    got = lm.score(docs, crc, model).collect()
    held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2
    toks = [(k, [*WORD.findall((t or "").translate(LOWER)), "\0end"]) for k, t in rows]
    c = collections.Counter(w for k, ws in toks if not held(k) for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((k, held(k), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for k, ws in toks)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score(docs.limit(0), crc, model).count() == 0


def test_model_probabilities_sum_to_one():
    model = lm.fit(["a b c d e f g h " * 40, "b a d c x1 y2 é ö " * 30], updates=10)
    s = np.random.default_rng(1).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.CLASSES * lm.PER_CLASS + lm.SPELLED)
    p = np.exp(model._loss(np.repeat(s, len(every), 0), every)[0])
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_language_model_learns_from_all_texts(spark, monkeypatch):
    """A vocabulary that no small share of the texts shows, and blocks of all rounds: all tokens are trained on."""
    rows = [(i, " ".join(f"w{i % 50}x{j}" for j in range(8)) + " common words here") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    want = collections.Counter(w for _, t in rows for w in t.split())
    hashes = dict(zip(want, lm.tokens(pa.array([" ".join(want)]))[0].tolist(), strict=False))
    monkeypatch.setattr(lm, "MESSAGE", 3000)
    monkeypatch.setattr(lm, "UPDATES", 1)
    docs = docs.withColumn("held_out", F.lit(False))
    start, often, _ = lm._vocabulary(docs, 12)
    messages = lm._messages(docs, 12, *map(spark.sparkContext.broadcast, (start, often))).cache()
    assert messages.filter("learnt > 0").selectExpr("explode(filter(sequence(1, size(turns) - 1), k -> turns[k] > turns[k - 1])) AS round").distinct().count() == lm.ROUNDS
    model = lm.learn(messages, start)
    assert {hashes[w] for w in want} < set(model.head.tolist()) and len(model.head) == len(want) + 1
    ids, n, _ = lm.tokens(pa.array([t for _, t in rows]))
    assert model.log10(model.ids(ids), n).sum() > 0.95 * start.log10(start.ids(ids), n).sum()
    tail = lm.windows(np.arange(1003), 7, 64)
    assert sorted(x for _, y in tail for x in y.reshape(-1) if x >= 0) == list(range(1003))
    assert lm.train(start, [start.ids(ids)[:5001]], lambda u, n: 0.01) == 5001
    assert lm.score(docs.limit(0), F.lit(False)).count() == 0


def slow_dedup(rows, n=100):
    seen, out = set(), {}
    for k, b in sorted(rows):
        m, fresh = bytearray(len(b)), []
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                m[i : i + n] = b"\1" * n
            else:
                seen.add(b[i : i + n])
        out[k] = (len(b), sum(m), len([x for x in bytes(m).split(b"\0") if x]), hashlib.sha256(bytes(c for c, x in zip(b, m) if not x)).hexdigest())
    return out


def test_suffix_dedup(docs, rows):
    text = {(1 << 62 if k is None else k): (t or "").encode() for k, t in rows}
    want = slow_dedup(text.items())
    got = {(1 << 62 if r.doc_id is None else r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000
    assert suffixes.deduplicate(docs.limit(0)).count() == 0


def test_multikey_sort_and_prefixes():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, (300, 20)).astype(np.uint8)
    w = suffixes.words_of(rows)
    order = suffixes.multikey_sort(w)
    as_bytes = [bytes(rows[i]) for i in order]
    assert as_bytes == sorted(as_bytes)
    lcp = suffixes.common_prefix(w, order)
    for i in range(1, 300):
        a, b = as_bytes[i - 1], as_bytes[i]
        n = next((k for k in range(20) if a[k] != b[k]), 24)
        assert lcp[i] == n


def test_personal_data(spark, docs):
    text = "Mail a.b@c.example.com, x@y.z.org; ip 10.0.0.255 and 1.2.3.999, 1.2.3.4.5\ncard 4539 1488 0343 6467 or 4539148803436468, call +1 (202) 555-0143; pi 3.14 and 2024-01-02"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "write to jo.doe [at] mail [dot] org or (202) 555-0143 é"), (5, "é" * 5 + " 10.1.1.1"), (6, "plain words only"), (7, "9" * 3000)], "doc_id long, text string").withColumn("spans", F.lit(0))
    got = {r.doc_id: r for r in pii.find(df).collect()}
    r = got[1]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (2, 2, 1, 1)
    base = pii.base_spans(text)
    assert [text[s:e] for k, s, e in base] == ["a.b@c.example.com", "x@y.z.org", "10.0.0.255", "1.2.3.4", "4539 1488 0343 6467", "+1 (202) 555-0143"]
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    assert set(f"{k}:{s}:{e}" for k, s, e in base) <= set(r.spans.split(","))
    assert got[2].spans == "" and got[2].masked_text is None and got[3].masked_text == "" and got[6].masked_text == "plain words only"
    assert got[4].spans.startswith("email:") and "phone:" in got[4].spans and got[4].n_email == 0
    assert got[5].spans == "ip:6:14" and got[5].masked_text == "ééééé [IP]"
    assert pii.find(docs.limit(0)).count() == 0 and pii.find(docs).count() == docs.count()


def test_emails_as_the_pattern_finds_them():
    rng = random.Random(6)
    slow = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(3000):
        t = "".join(rng.choice("ab.@-_ c%") for _ in range(rng.randrange(30)))
        assert pii._emails(t) == [m.span() for m in slow.finditer(t)]


def test_a_span_may_start_five_tokens_before_its_cue():
    """As many tokens on either side of a cue are looked at as a span with it may have."""
    text = "zero a b c d e f (at) g h i j k l"
    assert [text[r[0][0] : r[-1][1]] for r in pii.regions(text)] == ["b c d e f (at) g h i j k"]


def test_gradient_and_best_segmentation_of_the_field():
    """Forward and backward sums, label pairs included, against all segmentations written out."""
    rng = random.Random(4)
    text = "call 555-1234 now 10.0.0.1"
    tokens, gold = [m.span() for m in pii.TOKEN.finditer(text)], {(1, 2): "phone", (3, 4): "ip"}
    field = pii.Field({})
    cand = field.candidates(text, tokens)
    for f in cand.values():
        for k in pii.KINDS:
            for x in f:
                field.weights[k, x] = rng.uniform(-1, 1)
    for a in pii.LABELS:
        for b in pii.LABELS:
            field.weights["pair", (a, b)] = rng.uniform(-1, 1)

    def every(at, former):
        if at == len(tokens):
            yield 0.0, []
            return
        for j, label in [(at + 1, "out")] + [(j, k) for i, j in cand if i == at for k in pii.KINDS]:
            own = field.weights["pair", (former, label)] + (field.score(label, cand[at, j]) if label != "out" else 0)
            for s, rest in every(j, label):
                yield own + s, [(at, j, label), *rest]

    ways = list(every(0, "out"))
    total = np.log(sum(np.exp(s) for s, _ in ways))
    want = next(s for s, w in ways if {(i, j): k for i, j, k in w if k != "out"} == gold) - total
    like, grad = field.gradient(text, tokens, gold)
    assert like == pytest.approx(want)
    for key in [*rng.sample(sorted(grad, key=str), 12), ("pair", ("out", "phone")), ("pair", ("phone", "out"))]:
        old = field.weights.get(key, 0.0)
        field.weights[key] = old + 1e-5
        up = field.gradient(text, tokens, gold)[0]
        field.weights[key] = old
        assert (up - like) / 1e-5 == pytest.approx(grad[key], abs=1e-3)
    best = max(ways, key=lambda x: x[0])[1]
    assert [k for k, _, _ in field.decode(text, tokens)] == [k for _, _, k in best if k != "out"]


def test_whole_spans_beat_parts():
    field = pii.trained()
    text = "call 202-555-0143 now, card 4539148803436467."
    got = [(k, text[s:e]) for k, s, e in pii.all_spans(text, field, [])]
    assert ("phone", "202-555-0143") in got and ("card", "4539148803436467") in got and len(got) == 2


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp
    from duskline.session import materialize

    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "source_mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after = [docs]
    for name, f in cp.STAGES:
        after.append(materialize(f(spark, after[-1], sf_dir), name))
        if name != "source_mixing":
            assert after[-1].columns == list(cp.COLUMNS)
    start, lang, one, clean, masked, mixed = after
    assert lang.count() >= 0.97 * start.count()
    texts = {r.doc_id: shingles(r.text) for r in lang.collect()}
    kept = {r.doc_id for r in one.collect()}
    pairs = [(a, b) for a in texts for b in texts if a < b and texts[a] and 100 * len(texts[a] & texts[b]) >= 75 * len(texts[a] | texts[b])]
    assert kept <= set(texts) and {b for _, b in pairs} == set(texts) - kept
    items = [WORD.findall(r.text.translate(LOWER)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for r in clean.collect():
        low = " ".join(WORD.findall(r.text.translate(LOWER)))
        assert not any(" ".join(i) in low for i in items)
    assert masked.count() == clean.count() and not any(pii.base_spans(r.text) for r in masked.collect())
    assert all(r.n_chars == len(r.text) for r in masked.filter("text like '%[IP]%'").collect())
    got = mixed.collect()
    assert got and all(r.taken == r.copies * r.size and 1 <= r.copies <= 3 for r in got)
    empty = docs.limit(0)
    for _, f in cp.STAGES:
        empty = materialize(f(spark, empty, sf_dir), "empty")
    assert empty.count() == 0
