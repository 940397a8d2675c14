"""Connected components, bounded reachability and parent chains over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of edges; component is the least node it is joined with.

    Alternates large-star and small-star steps, which need a number of rounds in the logarithm of the
    longest chain; each round's edges are written once, so lineage stays short. Self edges name single
    nodes; null ends are left out; an empty table gives no rows.
    """
    both = edges.filter(f"{src} is not null and {dst} is not null").select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    # self edges are written with the others, so that what makes the edges is worked out once
    both = materialize(both.distinct(), "edges")
    alone = both.filter("u = v").select(F.col("u").alias("node"))
    now = both.filter("u != v")
    state = _state(now)
    for _ in range(most_rounds if state[0] else 0):
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(now)
        if hasattr(last, "_written"):
            discard(last)
        if after == state:
            break
        state = after
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    rest = alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(rest)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
