"""Odd rows through each stage of the pipeline: null ids, repeats, ties, clashing columns, very long texts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from duskline.llm import toxicity
from duskline.session import materialize


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = base.filter("lang is not null and length(text) between 400 and 4000 and lang in ('en')").orderBy("doc_id").limit(60)
    texts = [r.text for r in some.collect()]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    long = " ".join(texts) * (1 + 1_000_000 // len(" ".join(texts)))
    t = [" ".join(reversed(x.split())) for x in texts[:6]]  # no near copy of what is there
    rows = [
        (None, t[0] + " alpha", "en", "s"), (None, t[1] + " beta", "en", None), (900_001, t[2] + " gamma", None, "s"), (900_001, t[2] + " gamma", None, "s"), (900_001, t[3] + " delta", "en", "s"),
        (900_002, None, "en", "s"), (900_003, "", "en", "s"), (900_004, "12345 67890 !!", "en", "s"), (900_005, t[4] + " " + item, "en", "s"), (None, t[5] + " " + item, "en", None),
        (900_006, long, "en", "s"), (900_007, " ".join(sorted(t[0].split())) + " mail jane.roe@example.org now", "en", None), (900_008, texts[10], "en", "s"), (900_009, texts[10], "en", "other"),
    ]
    odd = spark.createDataFrame([(i, x, lang, s, len(x or "")) for i, x, lang, s in rows], base.schema)
    docs = base.unionByName(odd)
    for c in ("score", "size", "component_id", "held_out", "text_", "_t", "spans"):
        docs = docs.withColumn(c, F.lit("clash"))
    out, now = {"start": docs}, docs
    for name, f in cp.STAGES:
        now = out[name] = materialize(f(spark, now.withColumn("extra", F.lit(1)), sf_dir), name)
    return out, item


def rows(df, where):
    return df.filter(where).collect()


def test_odd_rows_have_their_defined_results(stages):
    out, item = stages
    lang, one, clean, masked, mixed = (out[n] for n, _ in cp.STAGES)
    for df in (lang, one, clean, masked):
        assert df.columns == list(cp.COLUMNS)
    # language: no letters, no row; ids and repeats do not matter
    assert rows(lang, "doc_id in (900002, 900003, 900004)") == [] and len(rows(lang, "doc_id = 900001")) == 3 and len(rows(lang, "doc_id is null")) == 3
    # duplicates: one row of each id, documents without id all, equal texts by the least id
    assert len(rows(one, "doc_id = 900001")) == 1 and len(rows(one, "doc_id is null")) == 3 and rows(one, "doc_id in (900008, 900009)") == []
    # benchmark passages go, whatever the id
    assert rows(clean, "doc_id = 900005") == [] and not any(item in r.text for r in rows(clean, "doc_id is null")) and len(rows(clean, "doc_id is null")) == 2
    got = rows(masked, "doc_id = 900007")
    assert not got or ("jane.roe" not in got[0].text and "[EMAIL]" in got[0].text and got[0].n_chars == len(got[0].text))
    assert masked.count() == clean.count()
    assert all(len(r.text) >= 1_000_000 for r in rows(one, "doc_id = 900006"))
    assert mixed.filter("copies < 1 or taken != copies * size").count() == 0 and mixed.filter("text is null").count() == 0


def test_stages_do_not_depend_on_the_order_of_rows(spark, sf_dir, stages):
    out, _ = stages
    for k, (name, f) in enumerate(cp.STAGES[2:], 2):
        before = out[cp.STAGES[k - 1][0]]
        again = f(spark, before.repartition(5).orderBy(F.rand(3)), sf_dir)
        assert sorted(map(str, again.collect())) == sorted(map(str, out[name].collect())), name


def test_repeated_ids_teach_the_same_texts(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, None), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.sample(docs.repartition(3), labels, F.lit(True)) == (["a", "c"], [1, 0])
