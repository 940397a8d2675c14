"""Scores of detectors and attackers over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as el
from ..session import table
from .registry import query

_RATES = "tp, fp, fn, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1"
_HIT = "regexp_matches(lower(text), 'idiot|moron|loser|clown|scum|pathetic|worthless')"


@query(f"""
WITH g AS (SELECT DISTINCT l.doc_id, lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE toxic = 1),
p AS (SELECT DISTINCT d.doc_id, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE {_HIT}),
s AS (SELECT coalesce(g.lang, p.lang) AS lang, count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn
  FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.lang = p.lang GROUP BY 1)
SELECT lang, {_RATES} FROM s""")
def detector_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "text", "toxic")
    return el.set_score(d.filter("toxic = 1"), d.filter(F.lower("text").rlike("idiot|moron|loser|clown|scum|pathetic|worthless")), ["doc_id", "lang"], ["lang"])


@query(f"""
WITH g AS (SELECT o_custkey AS k, count(*) AS a FROM orders GROUP BY 1), p AS (SELECT user_id AS k, count(*) AS b FROM events GROUP BY 1),
s AS (SELECT sum(least(coalesce(a, 0), coalesce(b, 0)))::BIGINT AS tp, sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0))::BIGINT AS fp, sum(greatest(coalesce(a, 0) - coalesce(b, 0), 0))::BIGINT AS fn FROM g FULL JOIN p ON g.k = p.k)
SELECT {_RATES} FROM s""")
def multiset_score(spark, sf_dir):
    return el.multiset_score(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), ["k"])


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'rejected' END"


@query(f"""
WITH r AS (SELECT o_orderpriority AS attacker, {_STATUS} AS status, (o_orderkey % 2)::BIGINT AS correct, 1::BIGINT AS claims FROM orders)
SELECT attacker, count(*) AS scheduled, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'rejected') AS rejected, 0 AS missing,
  coalesce(sum(correct) FILTER (status = 'completed'), 0)::BIGINT AS correct, coalesce(sum(claims) FILTER (status = 'completed'), 0)::BIGINT AS claims,
  (coalesce(sum(correct) FILTER (status = 'completed'), 0))::DOUBLE / nullif(coalesce(sum(claims) FILTER (status = 'completed'), 0), 0) AS success_rate FROM r GROUP BY 1""")
def attack_summary(spark, sf_dir):
    s = F.col("o_orderstatus")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("attacker"), F.when(s == "F", "completed").when(s == "O", "failed").otherwise("rejected").alias("status"), (F.col("o_orderkey") % 2).alias("correct"), F.lit(1).cast("long").alias("claims"))
    return el.attack_summary(runs, ["attacker"])


@query("""
SELECT count(*) FILTER (b.s = 'F' AND a.s = 'F') AS pairs, count(*) FILTER (NOT coalesce(b.s = 'F' AND a.s = 'F', false)) AS excluded, avg(CASE WHEN b.s = 'F' AND a.s = 'F' THEN a.v - b.v END) AS mean_change
FROM (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS v FROM orders WHERE o_orderkey % 6 <> 0) b FULL JOIN (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey % 100 AS v FROM orders WHERE o_orderkey % 6 <> 1) a ON a.k = b.k""")
def paired_cases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status")
    before = o.filter("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("k"), status, F.col("o_custkey").alias("v"))
    after = o.filter("o_orderkey % 6 <> 1").select(F.col("o_orderkey").alias("k"), status, (F.col("o_custkey") % 100).alias("v"))
    return el.paired(before, after, "k", "v")


@query("""
SELECT n_name AS metric, n_regionkey AS old, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey % 5 END AS new,
  CASE WHEN n_nationkey % 4 = 0 THEN 'unavailable' WHEN CASE WHEN n_name IN ('CHINA', 'INDIA') THEN n_nationkey % 5 - n_regionkey ELSE n_regionkey - n_nationkey % 5 END > 0 THEN 'worse'
    WHEN n_nationkey % 5 = n_regionkey THEN 'same' ELSE 'better' END AS verdict FROM nation""")
def report_regressions(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = n.select(F.col("n_name").alias("metric"), F.col("n_regionkey").alias("value"))
    new = n.select(F.col("n_name").alias("metric"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") % 5).alias("value"))
    return el.regressions(old, new, ["CHINA", "INDIA"])


@query("SELECT DISTINCT c_custkey::VARCHAR AS cid, c_name AS name, l_returnflag AS topic, l_linestatus AS fact FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def bridged_facts(spark, sf_dir):
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    s = lambda x: F.col(x).cast("string")
    return el.bridge_join(c.select(s("c_custkey").alias("cid"), F.col("c_name").alias("name")), o.select(s("o_custkey").alias("cid"), s("o_orderkey").alias("mid")), li.select(s("l_orderkey").alias("mid"), F.col("l_returnflag").alias("topic"), F.col("l_linestatus").alias("fact")))


_KNOWN = "SELECT s_name AS identity, s_suppkey::VARCHAR AS key, 't' || s_nationkey AS topic FROM supplier"


@query(f"WITH k AS ({_KNOWN}) SELECT DISTINCT identity, topic FROM k")
def knowledge_pairs(spark, sf_dir):
    return el.knowledge_pairs(_known(spark, sf_dir))


def _known(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("identity"), F.col("s_suppkey").cast("string").alias("key"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("topic"))


@query(f"""
WITH k AS ({_KNOWN}), s AS (SELECT c_custkey::VARCHAR AS subject, CASE WHEN c_custkey % 3 = 0 THEN 't' || c_nationkey ELSE '' END AS topic FROM customer)
SELECT subject, min(identity) AS identity FROM (SELECT DISTINCT subject, identity FROM s JOIN k ON k.key = s.subject OR (s.topic <> '' AND k.topic = s.topic)) GROUP BY subject HAVING count(*) = 1""")
def background_claims(spark, sf_dir):
    subjects = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("subject"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("t"), F.col("c_nationkey").cast("string"))).otherwise("").alias("topic"))
    return el.background_claims(_known(spark, sf_dir), subjects)


@query("SELECT d.doc_id AS id, CASE WHEN toxic = 1 THEN 'YES' WHEN toxic = 0 THEN 'NONE' END AS verdict FROM documents d LEFT JOIN (SELECT doc_id, min(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def merged_verdicts(spark, sf_dir):
    batch = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    replies = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.when(F.min("toxic") == 1, "YES").otherwise("NONE").alias("verdict"))
    return el.merge_verdicts(batch, replies)


@query("""SELECT r_regionkey, sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') AS sha256 FROM region""")
def request_digests(spark, sf_dir):
    return el.request_digest(table(spark, sf_dir, "region"), ["r_regionkey", "r_name"]).select("r_regionkey", "sha256")
