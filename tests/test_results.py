"""Results of a stream and their filtered views: a view equals the batch filter, also after the filter changed."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from duskline.operators.review import filter_results
from duskline.session import shared_dir
from duskline.streaming.results import Filter, ResultLog

SCHEMA = "relpath string, is_dir boolean, signals array<struct<category:string,surface:string>>"


@pytest.fixture()
def place(spark):
    return f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"


def rows(rng, n):
    sig = lambda: [(rng.choice(["KEYWORD", "PATTERN"]), rng.choice(["Token", "x@y.z"])) for _ in range(rng.randrange(3))]
    return [(f"{rng.choice(['a', 'B', 'c'])}/{i:04d}", rng.random() < 0.3, sig()) for i in range(n)]


def plain(df):
    return sorted(map(str, df.select("relpath", "is_dir", "signals").collect()))


def test_view_follows_the_stream_and_a_new_filter_starts_again(spark, place):
    rng = random.Random(1)
    source, log = f"{place}/in", ResultLog(spark, f"{place}/log", SCHEMA)
    add = lambda n: spark.createDataFrame(rows(rng, n), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda f: log.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), f"{place}/at", f).awaitTermination()
    first, second = Filter("file", ("KEYWORD",), " TOKEN "), Filter(query="b/")
    for n in (30, 5):
        add(n)
    run(first)
    whole = lambda: spark.read.schema(SCHEMA).parquet(source)
    assert plain(log.results()) == plain(whole()) and plain(log.results(first)) == plain(filter_results(whole(), "file", ["KEYWORD"], "token"))
    add(12)
    run(second)
    assert plain(log.results(second)) == plain(filter_results(whole(), query="b/")) and log.results(second).count() > 0
    assert log.page(0, 3, first)[2] == 1 and log.catch_up(first) == 0
    assert plain(log.results(first)) == plain(filter_results(whole(), "file", ["KEYWORD"], "token"))
    for f in (None, first, second):
        c, r = log.counters(f).first(), log.results(f)
        assert (c.batches, c.rows, c.directories, c.with_signals) == (3, r.count(), r.filter("is_dir").count(), r.filter(F.size("signals") > 0).count())
    assert {r.batch for r in log.results().select("batch").distinct().collect()} == {0, 1, 2}


def test_what_broke_off_does_not_count_and_pages_stay_in_range(spark, place):
    log, f = ResultLog(spark, place, SCHEMA), Filter(kind="dir")
    assert log.results().count() == 0 and log.counters().first().rows == 0 and log.catch_up(f) == 0 and log.page(4, 10)[1] == 0
    df = spark.createDataFrame(rows(random.Random(2), 25), SCHEMA)
    df.write.parquet(f"{place}/results/0")
    assert log.results().count() == 0
    log._put("results", 0, df)
    log._put("results", 0, df)
    log._put("results", 1, df.limit(0))
    assert log.catch_up(f, most=1) == 1 and log.catch_up(f) == 0
    assert log.results(f).count() == df.filter("is_dir").count() and log.counters().first().batches == 2
    page, number, behind = log.page(9, 10)
    assert (number, behind) == (2, 0) and [r.relpath for r in page.collect()] == sorted(r.relpath for r in df.collect())[20:]
    assert Filter(categories=("b", "a", "a")).key == Filter(categories=("a", "b")).key != Filter().key
