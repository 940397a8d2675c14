"""A component's result is kept by digest: a change works out one component and gives what a full run gives."""

import pytest
from pyspark.sql import functions as F

from duskline.operators import components as cp
from duskline.operators import evidence as ev
from duskline.session import shared_dir

PERSON, EVENT = ev.Field("p", "key", "people", "person"), ev.Field("e", "key", "events", "event")


def world(spark, flags):
    """Assertions of three groups of documents; flags: the sensitive value of each group's event."""
    rows = cells = primary = None
    names = spark.createDataFrame([(f"names-{g}", f"p{g}{i}", f"name {g} {i}") for g in flags for i in range(3)], "document_id string, p string, name string")
    links = spark.createDataFrame([(f"links-{g}", f"p{g}{i}", f"e{g}") for g in flags for i in range(2)], "document_id string, p string, e string")
    facts = spark.createDataFrame([(f"facts-{g}", f"e{g}", v) for g, v in flags.items() if v], "document_id string, e string, flag string")
    shapes = ((names, ev.Template("p", (PERSON, ev.Field("name", "identity")))), (links, ev.Template("p", (PERSON, EVENT))), (facts, ev.Template("e", (EVENT, ev.Field("flag", "sensitive")))))
    add = lambda a, b: b if a is None else a.unionByName(b)
    for df, t in shapes:
        for doc in [r[0] for r in df.select("document_id").distinct().collect()]:
            own = df.filter(F.col("document_id") == doc).drop("document_id")
            rows = add(rows, ev.assertions(own, t, doc))
            for f in t.fields:
                cells = add(cells, own.select(F.lit(doc).alias("document_id"), F.lit(f.role).alias("role"), F.lit(f.entity_type).alias("entity_type"), F.lit(f.namespace).alias("namespace"), F.col(f.name).alias("value")))
            key = next(f for f in t.fields if f.name == t.primary)
            primary = add(primary, spark.createDataFrame([(doc, key.entity_type, key.namespace)], "document_id string, entity_type string, namespace string"))
    text = rows.groupBy("document_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("source", F.coalesce("target", F.lit("")), F.coalesce("value", F.lit("")))))), 256).alias("revision"))
    return rows, cells, primary, text


def witnesses(df):
    return sorted((r.rule, r.subject, r.endpoint, tuple(r.chain)) for r in df.collect())


@pytest.fixture()
def cache(spark):
    import uuid

    return cp.ResultCache(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", cp.WITNESSES)


def test_one_changed_document_recomputes_one_component(spark, cache):
    full = lambda w: witnesses(ev.witnesses(ev.evidence(w[0])))
    first, second = world(spark, {"a": "x", "b": "y", "c": None}), world(spark, {"a": "x", "b": "z", "c": None})
    steps = [(first, 3, 0), (first, 0, 3), (second, 1, 2), (first, 0, 3), (second, 0, 3)]
    for w, rebuilt, hits in steps:
        got = cp.refresh_witnesses(*w, cache)
        counts = got.counts.first()
        assert (counts.rebuilt_components, counts.cache_hits, counts.components) == (rebuilt, hits, 3)
        assert witnesses(got.results) == full(w)
    assert counts.documents == 8 and counts.read_documents == 0
    assert cp.refresh_witnesses(*second, cache, max_support=1).counts.first().rebuilt_components == 3


def test_two_components_that_meet_are_one_new_one(spark, cache):
    w = world(spark, {"a": "x", "b": "y"})
    assert cp.refresh_witnesses(*w, cache).counts.first().components == 2
    anchors = spark.createDataFrame([("c1", "names-a"), ("c1", "facts-b")], "correction_id string, document_id string")
    got = cp.refresh_witnesses(*w, cache, anchors=anchors)
    assert (got.counts.first().components, got.counts.first().rebuilt_components) == (1, 1)
    assert witnesses(got.results) == witnesses(ev.witnesses(ev.evidence(w[0])))


def test_cache_reads_whole_batches_and_empty_results(spark, cache):
    done = spark.createDataFrame([("d1",), ("d2",)], "digest string")
    row = ("d1", "r", "s", "e", ["x"], None, None)
    rows = spark.createDataFrame([row], f"digest string, {cp.WITNESSES}")
    assert cache.digests().count() == 0 and cache.rows(done).count() == 0
    rows.withColumn("batch", F.lit("broke off")).write.mode("append").parquet(f"{cache.folder}/rows")
    assert cache.rows(done).count() == 0
    cache.put(done, rows)
    cache.put(done, rows)
    assert {r.digest for r in cache.digests().collect()} == {"d1", "d2"} and [tuple(r) for r in cache.rows(done).collect()] == [row]
    less = cache.pruned(done.filter("digest = 'd1'"), cache.folder + "-pruned")
    assert [r.digest for r in less.digests().collect()] == ["d1"] and less.rows(done).count() == 1 and cache.digests().count() == 2
