"""Batches packed in parallel are those of one pass over the rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from duskline.operators import packing as pk


def one_pass(records, items, most):
    """Batches as rows come one by one, as lists of (path, is_dir, number)."""
    text = lambda rs: len((pk.HEAD + ",".join(json.dumps({"path": p, "kind": "directory" if d else "file", "id": f"E{n}"}, ensure_ascii=False, separators=(",", ":")) for p, d, n in rs) + pk.TAIL).encode())
    parent = lambda r: r[0].rsplit("/", 1)[0] if "/" in r[0] else ""
    fits = lambda rs: len(rs) <= items and text(rs) <= most
    out, large, pending = [], [], []
    for r in records:
        if not fits([r]):
            large.append(r)
            continue
        while pending and not fits([*pending, r]):
            cut = len(pending)
            while cut and parent(pending[cut - 1]) == parent(r):
                cut -= 1
            cut = cut or len(pending)
            out.append(pending[:cut])
            pending = pending[cut:]
        pending.append(r)
    return [b for b in [*out, pending] if b], large


@pytest.mark.parametrize("items, most, slice_rows", [(5, 400, 5), (7, 300, 40), (40, 600, 64), (3, 10_000, 10), (1, 200, 1), (50, 700, 1000)])
def test_packing_is_one_pass(spark, items, most, slice_rows):
    rng = random.Random(items)
    paths = {"/".join(rng.choice(["a", "bé", "c" * 20, "北"]) for _ in range(rng.randrange(1, 4))) + f"/{'x' * rng.randrange(60)}{i}" for i in range(150)} | {f"same/{i}" for i in range(60)} | {"y" * 900, "top", "z/" + "w" * 2000}
    rows = sorted(((p, rng.random() < 0.2) for p in paths), key=lambda r: r[0].encode())
    batches, large = one_pass([(p, d, n) for n, (p, d) in enumerate(rows, 1)], items, most)
    df = spark.createDataFrame(rows, "relpath string, is_dir boolean").withColumn("seq", F.lit(1)).repartition(5)
    got = {}
    for r in pk.pack_entries(df, items, most, slice_rows).orderBy("number").collect():
        got.setdefault(r.batch, []).append((r.relpath, r.is_dir, r.number))
    assert got.pop(None, []) == large and list(got.values()) == batches
    starts = [0]
    for b in batches[:-1]:
        starts.append(starts[-1] + len(b))
    assert list(got) == starts


def test_packing_of_nothing(spark):
    df = spark.createDataFrame([], "relpath string, is_dir boolean")
    assert pk.pack_entries(df, 4, 100).count() == 0
    with pytest.raises(ValueError):
        pk.pack_entries(df, 10, 100, slice_rows=5)
