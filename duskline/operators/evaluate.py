"""Scores of detectors and attackers against gold data, and gates between reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """Null, not 0, where there is nothing to divide by."""
    return a / F.nullif(b, F.lit(0))


def with_rates(df: DataFrame) -> DataFrame:
    """tp, fp, fn with precision, recall and f1; null where undefined."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return df.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def set_score(gold: DataFrame, predicted: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """Gold against predictions as sets of keys, for each group in by."""
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, keys, "full_outer")
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    agg = [n(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"), n(F.col("_g").isNull() & F.col("_p").isNotNull()).alias("fp"), n(F.col("_g").isNotNull() & F.col("_p").isNull()).alias("fn")]
    return with_rates(both.groupBy(*by).agg(*agg))


def multiset_score(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Gold against predictions where a key may stand several times: each counts as often as on both sides."""
    g, p = gold.groupBy(*keys).agg(F.count("*").alias("_g")), predicted.groupBy(*keys).agg(F.count("*").alias("_p"))
    a, b = F.coalesce("_g", F.lit(0)), F.coalesce("_p", F.lit(0))
    both = g.join(p, keys, "full_outer").select(F.least(a, b).alias("tp"), F.greatest(b - a, F.lit(0)).alias("fp"), F.greatest(a - b, F.lit(0)).alias("fn"))
    return with_rates(both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))


def attack_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs (status, correct, claims) by group: counts of all, rates over completed ones only."""
    done = F.col("status") == "completed"
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = runs.groupBy(*by).agg(F.count("*").alias("scheduled"), n("completed"), n("failed"), n("rejected"), n("missing"), F.coalesce(F.sum(F.when(done, F.col("correct"))), F.lit(0)).alias("correct"), F.coalesce(F.sum(F.when(done, F.col("claims"))), F.lit(0)).alias("claims"))
    return out.withColumn("success_rate", _ratio(F.col("correct"), F.col("claims")))


def paired(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """One row: cases completed on both sides, those left out, and the mean change of a value over the pairs."""
    b, a = before.select(key, F.col("status").alias("_b"), F.col(value).alias("_bv")), after.select(key, F.col("status").alias("_a"), F.col(value).alias("_av"))
    both = b.join(a, key, "full_outer")
    ok = F.coalesce((F.col("_b") == "completed") & (F.col("_a") == "completed"), F.lit(False))
    return both.agg(F.count_if(ok).alias("pairs"), F.count_if(~ok).alias("excluded"), F.avg(F.when(ok, F.col("_av") - F.col("_bv"))).alias("mean_change"))


def regressions(old: DataFrame, new: DataFrame, lower_is_better: list[str], tolerance: float = 0.0) -> DataFrame:
    """Metrics (metric, value) that got worse: rows (metric, old, new, verdict). A value that appears or goes
    missing is told apart from one that got worse; a missing one is no zero."""
    o, n = old.select("metric", F.col("value").alias("old"), F.lit(True).alias("_o")), new.select("metric", F.col("value").alias("new"), F.lit(True).alias("_n"))
    j = o.join(n, "metric", "full_outer")
    worse = F.when(F.col("metric").isin(*lower_is_better), F.col("new") - F.col("old")).otherwise(F.col("old") - F.col("new")) > tolerance
    better = F.when(F.col("metric").isin(*lower_is_better), F.col("old") - F.col("new")).otherwise(F.col("new") - F.col("old")) > tolerance
    verdict = F.when(F.col("old").isNull() & F.col("new").isNull(), "same").when(F.col("old").isNull(), "available").when(F.col("new").isNull(), "unavailable").when(worse, "worse").when(better, "better").otherwise("same")
    return j.select("metric", "old", "new", verdict.alias("verdict"))


def bridge_join(clients: DataFrame, bridges: DataFrame, facts: DataFrame) -> DataFrame:
    """Clients (cid, name) led by bridges (cid, mid) to facts (mid, topic, fact); empty keys join nothing."""
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return clients.filter(full("cid")).join(bridges.filter(full("cid") & full("mid")), "cid").join(facts.filter(full("mid")), "mid").select("cid", "name", "topic", "fact").distinct()


def knowledge_pairs(known: DataFrame) -> DataFrame:
    """Rows (identity, topic): what knowing (identity, key, topic) tells by equal keys."""
    a = known.filter("coalesce(identity, '') != '' and coalesce(key, '') != ''").select("key", "identity")
    b = known.filter("coalesce(topic, '') != '' and coalesce(key, '') != ''").select("key", "topic")
    return a.join(b, "key").select("identity", "topic").distinct()


def background_claims(known: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows (subject, identity): subjects (subject, topic) that exactly one known identity (identity, key, topic)
    matches, by its key or by a topic. A key or topic is told by its least and its greatest identity: they differ just
    if there are several, so that no subject meets all identities of a topic."""
    k = known.filter("coalesce(identity, '') != ''")
    ends = lambda c: k.groupBy(c).agg(F.min("identity").alias("least"), F.max("identity").alias("greatest"))
    by_key = subjects.select("subject").distinct().join(ends("key").withColumnRenamed("key", "subject"), "subject")
    by_topic = subjects.filter("coalesce(topic, '') != ''").join(ends("topic"), "topic").select("subject", "least", "greatest")
    every = by_key.unionByName(by_topic).groupBy("subject").agg(F.min("least").alias("identity"), F.max("greatest").alias("last"))
    return every.filter("identity = last").select("subject", "identity")


def merge_verdicts(batch: DataFrame, replies: DataFrame) -> DataFrame:
    """batch (id) with the verdict of its reply (id, verdict). An id that was not asked for, or one answered twice,
    is an error; one without an answer stays null, which is not the verdict NONE."""
    n = replies.groupBy("id").agg(F.count("*").alias("n"), F.min("verdict").alias("verdict"))
    if not n.filter("n > 1").isEmpty() or not n.join(batch, "id", "left_anti").isEmpty():
        raise ValueError("a reply names an unknown id, or one twice")
    return batch.join(n.select("id", "verdict"), "id", "left")


def request_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with request and sha256: canonical JSON, keys in order, and its digest."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))
    return rows.select("*", body.alias("request"), F.sha2(body, 256).alias("sha256"))


def selected_split(cases: DataFrame, split: str, known: tuple[str, ...] = ("development", "validation", "holdout"), key: str = "case_id") -> DataFrame:
    """The cases (case_id, split, ...) of one split. A split that is not known, a case without or with another one, and a case in two
    splits are errors: what was tuned on must not be scored."""
    if split not in known:
        raise ValueError(f"unknown split {split!r}")
    per = cases.groupBy(key).agg(F.count_distinct("split").alias("n"), F.count_if(~F.coalesce(F.col("split").isin(*known), F.lit(False))).alias("odd"))
    if not per.filter((F.col("n") != 1) | (F.col("odd") > 0)).isEmpty():
        raise ValueError("a case has no known split, or several")
    return cases.filter(F.col("split") == split)


def attack(cases: DataFrame, attacker, gold: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows (case_id, status, correct, claims) of an attacker, a function from cases to rows (case_id, claim), against gold (case_id, claim).

    A case without a claim is completed with none; claims on cases that were not given are an error; repeated claims count
    once. Where the attacker raises before it returns its rows, every case is failed.
    """
    try:
        claims = attacker(cases)
    except Exception:  # an attacker that is down fails its cases, not the evaluation
        return cases.select(key).distinct().select(key, F.lit("failed").alias("status"), F.lit(0).cast("long").alias("correct"), F.lit(0).cast("long").alias("claims"))
    if set(claims.columns) != {key, "claim"}:
        raise ValueError(f"an attacker returns ({key}, claim)")
    claims = claims.filter("claim is not null").distinct()
    given = cases.select(key).distinct()
    known = claims.join(given.withColumn("_given", F.lit(True)), key, "left")
    known = known.filter(F.when(F.col("_given").isNull(), F.raise_error(F.lit("a claim on a case that was not given")).cast("boolean")).otherwise(True))
    right = known.join(gold.select(key, "claim", F.lit(1).alias("_right")).distinct(), [key, "claim"], "left")
    per = right.groupBy(key).agg(F.count("*").alias("claims"), F.count("_right").alias("correct"))
    zero = F.lit(0)
    return given.join(per, key, "left").select(key, F.lit("completed").alias("status"), F.coalesce("correct", zero).alias("correct"), F.coalesce("claims", zero).alias("claims"))
