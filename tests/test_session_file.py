"""A saved session comes back as it was, or what is wrong with it is named."""

import pytest
from pyspark.sql import functions as F

from duskline.operators import session_file as sf
from duskline.session import materialize

SCHEMA = "id long, name string, tags array<string>"


@pytest.fixture(scope="module")
def saved(spark):
    rows = [(i, None if i % 7 == 0 else f'né "{i}"\n', [] if i % 3 else ["a", None]) for i in range(25)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    frames, man = sf.save(df, ["id"], "secret", 10)
    return rows, materialize(frames, "frames"), materialize(man, "manifest")


def test_rows_come_back(spark, saved):
    rows, frames, man = saved
    got = sf.load(frames, man, "secret", SCHEMA, 10).orderBy("place").collect()
    assert [(r.id, r.name, r.tags) for r in got] == rows and [r.place for r in got] == list(range(1, 26))
    assert sorted((r.slice, r.n_rows) for r in man.collect()) == [(0, 10), (1, 10), (2, 5)]
    empty, none = sf.save(spark.createDataFrame([], SCHEMA), ["id"], "k")
    assert sf.load(empty, none, "k", SCHEMA).count() == 0 and none.count() == 0


def test_what_is_wrong_is_named(spark, saved):
    _, frames, man = saved
    at = F.col("place")
    swap = F.when(at == 3, 14).when(at == 14, 3).otherwise(at).cast("long")
    cases = {
        "changed": (frames.withColumn("frame", F.when(at == 12, F.lit("{}")).otherwise(F.col("frame"))), {(12, "changed")}),
        "lost": (frames.filter(at != 8), {(8, "lost")}),
        "end lost": (frames.filter(at < 24), {(24, "lost"), (25, "lost")}),
        "slice lost": (frames.filter(~at.between(11, 20)), {(i, "lost") for i in range(11, 21)}),
        "moved": (frames.withColumn("place", swap), {(3, "changed"), (14, "changed")}),
        "repeated": (frames.unionByName(frames.filter(at == 5)), {(5, "repeated")}),
        "added": (frames.unionByName(frames.filter(at == 25).withColumn("place", F.lit(26).cast("long"))), {(26, "changed")}),
    }
    for name, (f, want) in cases.items():
        assert {(r.place, r.fault) for r in sf.faults(f, man, "secret", 10).collect()} == want, name
    other = man.withColumn("seal", F.when(F.col("slice") == 1, F.lit("x")).otherwise(F.col("seal")))
    assert [(r.place, r.fault) for r in sf.faults(frames, other, "secret", 10).collect()] == [(11, "slice")]
    with pytest.raises(ValueError, match="changed 1"):
        sf.load(frames, man, "another key", SCHEMA, 10)
    with pytest.raises(ValueError, match="lost 8"):
        sf.load(frames.filter(at != 8), man, "secret", SCHEMA, 10)
