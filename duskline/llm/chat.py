"""Chat formatting by collapse of cumulative snapshots, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def _field(name: str):
    """A field behind its length; -1 stands for null, which no text has."""
    c = F.col(name)
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-1:"))


def maximal_conversations(turns: DataFrame, template: str = "<|{role}|>\n{text}<|end|>\n") -> DataFrame:
    """Rows (conv_id, n_turns, n_snapshots, digest, rendered): the conversations that prefix no longer one.

    turns has (conv_id, turn, role, text). A rolling digest over the turns in order names each prefix.
    A conversation whose last digest is an inner digest of another is a snapshot that was logged before
    the talk went on, and goes. Of equal conversations the least conv_id stays, and n_snapshots counts
    how many were equal to it. Both sides of the anti-join have one row for each digest, so a first turn
    or conversation that a third of the log shares is one row there.

    Turns are ordered by turn (null last), role, text; rows repeated in full count once. Null roles and
    texts differ from empty ones in digests and render as empty. Rows without conv_id belong to no
    conversation and are left out. An empty table gives no rows; other columns are not read.
    """
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", "role", "text")
    key = F.sha2(F.concat(_field("role"), _field("text")), 256)
    # one array for each conversation, which is rendered as one string anyway
    turn = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text", key.alias("key"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))

    def step(acc, t):
        now = F.sha2(F.concat(acc["last"], t["key"]), 256)
        return F.struct(now.alias("last"), F.concat(acc["all"], F.array(now)).alias("all"))

    chained = convs.withColumn("chain", F.aggregate("turns", start, step)["all"])
    chained = chained.withColumn("digest", F.element_at("chain", -1)).withColumn("n_turns", F.size("turns").cast("long"))
    inner = chained.select(F.explode(F.slice("chain", 1, F.size("chain") - 1)).alias("digest")).distinct()
    least = chained.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_snapshots"))
    kept = least.join(inner, "digest", "left_anti")
    head, rest = template.split("{role}")
    middle, tail = rest.split("{text}")
    line = lambda t: F.concat(F.lit(head), F.coalesce(t["role"], F.lit("")), F.lit(middle), F.coalesce(t["text"], F.lit("")), F.lit(tail))
    shown = chained.select("conv_id", "n_turns", F.array_join(F.transform("turns", line), "").alias("rendered"))
    return kept.join(shown, "conv_id").select("conv_id", "n_turns", "n_snapshots", "digest", "rendered")
