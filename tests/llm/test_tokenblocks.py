"""Token blocks against the tokenizer run on whole texts, and exact round trips of the file format."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duskline.llm import tokenblocks as tb

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "It's 42nd's  ÉCOLE'S école İstanbul <|endoftext|>x a<|startoftext|>b <|endoftext|", "x́ ́y z w 北京大学。你好, ok", "", None, "  \n\t ", "\x00\x01 \x7f\x1c\x1d '' 's's |'re|", "ſ K ﬁ ǅ ẞ",
    "1234-abc'D don't DON'T", "a'" * 5, "가 ȩ́", " a b　c", "a" * 70_000, "word " * 20_000, "!?#$%" * 300, "🙂👩‍👩‍👧 a🙂b", "A-Z_0.9e-5,x",
]


TOKENIZERS = {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}


def whole(path, text):
    return TOKENIZERS[path].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2000), st.integers(0, 2**32 - 1), st.sampled_from([0, 1, 5, 300, 50_000, 2**32 - 1]), st.floats(0, 0.3), st.integers(0, 2100), st.integers(0, 2100))
def test_round_trip_of_blocks(n, seed, spread, outliers, a, b):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, spread, n, dtype=np.uint64, endpoint=True)
    ids = np.where(rng.random(n) < outliers, rng.integers(0, 2**32, n, dtype=np.uint64), ids).astype(np.uint32)
    cuts = np.sort(rng.integers(0, n + 1, 3))
    counts = np.diff(np.concatenate([[0], cuts, [n]]))
    f = tb.TokenFile(tb.to_file(np.array([-5, 0, 7, 2**62]), np.array([True, False, False, False]), counts, ids))
    assert (f.ids() == ids).all() and (f.ids(a, b) == ids[a:b]).all() and len(f.starts) == -(-n // 256) + 1
    assert f.doc_ids.tolist() == [-5, 0, 7, 2**62] and f.missing.tolist() == [True, False, False, False] and (f.counts == counts).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(256, 9)
    ids[::25] = 40_000
    starts, body = tb.pack(ids)
    assert len(body) == starts[-1] == 6 + 0 * 32 + 11 * 5 and (tb.unpack(starts, np.frombuffer(body, np.uint8)) == ids).all()


def test_broken_files_are_told():
    good = tb.to_file(np.array([1]), np.array([False]), np.array([3]), np.array([1, 2, 3]))
    for bad in (b"XXXX" + good[4:], good[:-1]):
        with pytest.raises(ValueError, match="token blocks"):
            tb.TokenFile(bad)


@pytest.mark.parametrize("path, by_word", [(WORDS, True), (BYTES, False)])
def test_encoder_equals_whole_texts(path, by_word, monkeypatch):
    monkeypatch.setattr(tb, "REMEMBERED", 3)
    e = tb.Encoder(path)
    assert e.by_word == by_word
    rng = random.Random(1)
    letters = "aAbzé'’1 \n,.|<>İſ́北 "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    for part in (texts, texts[5:9], [None], []):
        ids, counts = e.encode(pa.array(part, pa.string()))
        at = np.append(0, np.cumsum(counts))
        for i, x in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == whole(path, x)[: at[i + 1] - at[i] + 1], x


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_corpus_is_brute_force(spark, coalesce):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        corpus(spark, shards=coalesce == "false")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def corpus(spark, shards):
    rng = random.Random(6)
    rows = [(rng.randrange(10**6), " ".join(rng.choice(["cat", "Dog,", "école", "42"]) for _ in range(rng.randrange(90))), "n", i) for i in range(200)]
    rows += [(10**6 + i, x, "n", i) for i, x in enumerate(ODD)] + [(None, "null id", "n", 0), (None, None, "n", 0), (5, "same id", "n", 0), (5, "same", "n", 0)] + rows[:3] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, start long").repartition(7)
    files = tb.write(docs, WORDS, file_ids=500, step_bytes=300)
    got = tb.read(files, with_ids=True).collect()
    want = sorted((-1 if i is None else i, whole(WORDS, x) + [2]) for i, x, _, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in got) == want
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and (-1 if r.doc_id is None else r.doc_id) >= last
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    assert files.count() > files.select("shard").distinct().count() > shards
    assert tb.read(tb.write(docs.limit(0), WORDS)).count() == 0
