"""Release plans over customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import generalize as gz
from ..operators import release as rl
from ..operators import session_file
from ..session import materialize, table
from .registry import query

PLANS = (
    rl.Plan("c_custkey", "key", required=True), rl.Plan("c_name", "identity"), rl.Plan("c_mktsegment", "quasi", "generalize", bands=(("AUTOMOBILE", "goods"), ("MACHINERY", "goods"), ("FURNITURE", "goods"), ("HOUSEHOLD", "home"), ("BUILDING", "home"))),
    rl.Plan("c_nationkey", "quasi", "keep"),
)


def _alias(c):
    return F.concat(F.lit("CUST_"), F.substring(F.sha2(c, 256), 1, 24))


@query("SELECT * FROM (SELECT 'requested' AS strategy, count(*) * (1 + 2 + 1 + 0 + 2) AS loss FROM customer UNION ALL SELECT 'essential_only', count(*) * (1 + 2 + 3 + 3 + 2) FROM customer UNION ALL SELECT 'suppress_all', count(*) * (1 + 2 + 3 + 3 + 2) FROM customer)")
def plan_losses(spark, sf_dir):
    return rl.losses(table(spark, sf_dir, "customer"), PLANS)


@query("""
SELECT strategy, action, c * n AS n FROM (SELECT count(*) AS n FROM customer), (VALUES ('requested', 'alias', 1), ('requested', 'drop', 1), ('requested', 'generalize', 1), ('requested', 'keep', 1),
 ('essential_only', 'alias', 1), ('essential_only', 'drop', 1), ('essential_only', 'suppress', 2), ('suppress_all', 'alias', 1), ('suppress_all', 'drop', 1), ('suppress_all', 'suppress', 2)) t(strategy, action, c)""")
def plan_actions(spark, sf_dir):
    return rl.action_counts(table(spark, sf_dir, "customer"), PLANS)


@query("""
SELECT 'CUST_' || substr(sha256(c_custkey::VARCHAR), 1, 24) AS c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY', 'FURNITURE') THEN 'goods' ELSE 'home' END AS c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer""")
def requested_artifact(spark, sf_dir):
    return rl.artifact(table(spark, sf_dir, "customer"), PLANS, "requested", _alias)


@query("""
WITH q AS (SELECT c_mktsegment AS a, c_nationkey::VARCHAR AS b, (c_custkey % 4)::VARCHAR AS c FROM customer)
SELECT * FROM (SELECT 'a+b' AS subset, a || '|' || b AS key, count(*) AS n FROM q GROUP BY 2 UNION ALL SELECT 'a+c', a || '|' || c, count(*) FROM q GROUP BY 2
 UNION ALL SELECT 'b+c', b || '|' || c, count(*) FROM q GROUP BY 2 UNION ALL SELECT 'a+b+c', a || '|' || b || '|' || c, count(*) FROM q GROUP BY 2) WHERE n < 3""")
def small_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    q = c.select(F.col("c_mktsegment").alias("a"), F.col("c_nationkey").cast("string").alias("b"), (F.col("c_custkey") % 4).cast("string").alias("c"))
    return rl.small_groups(q, ("a", "b", "c"), 3)


@query("""SELECT 'text' AS "column", count(*) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])(idiot|moron)([^a-z0-9_]|$)') HAVING count(*) > 0""")
def residual_terms(spark, sf_dir):
    return rl.residuals(table(spark, sf_dir, "documents").select("text", "lang"), ["idiot", "moron"])


@query("""
SELECT p_partkey, regexp_matches(v, '^[=+\\-@\\t\\r]') AS active, CASE WHEN regexp_matches(v, '^\\s*[=+\\-@]') THEN '''' || v ELSE v END AS safe
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '-' ELSE '' END || p_name AS v FROM part)""")
def spreadsheet_safe_cells(spark, sf_dir):
    lead = F.element_at(F.array(*map(F.lit, ("=", " +", "-", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    v = F.concat(lead, "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", gz.active_value(v).alias("active"), gz.csv_safe(v).alias("safe"))


@query("SELECT 'r_regionkey=' || r_regionkey || ';r_name=' || r_name || ';state=positive' AS value FROM region")
def record_lines(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("r_regionkey"), "r_name", F.lit("positive").alias("state"))
    return rl.record_lines(r, "state")


@query("SELECT 'requested' AS strategy, 6 * count(*) AS loss FROM customer")
def best_plan(spark, sf_dir):
    loss = rl.losses(table(spark, sf_dir, "customer"), PLANS)
    return rl.best(loss.withColumn("feasible", F.lit(True)))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN NULL WHEN 2 THEN '[REDACTED]' ELSE 'band' END AS value FROM orders""")
def applied_operators(spark, sf_dir):
    op = F.element_at(F.array(*map(F.lit, ("identity", "drop", "redact", "generalize"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", gz.apply(F.col("o_orderpriority"), op, F.when(op == "generalize", "band")).alias("value"))


@query("""
SELECT k, CASE WHEN k % 50 = 1 THEN NULL WHEN k % 7 = 0 THEN 'seg' ELSE 'state' END AS "column",
  CASE WHEN k % 50 = 1 THEN 'TASK_ROWS_CHANGED' WHEN k % 7 = 0 THEN 'TASK_VALUE_CHANGED' ELSE 'ASSERTION_STATE_CHANGED' END AS reason
FROM (SELECT c_custkey AS k FROM customer) WHERE k % 50 = 1 OR k % 7 = 0
UNION ALL SELECT k, 'state', 'ASSERTION_STATE_CHANGED' FROM (SELECT c_custkey AS k FROM customer) WHERE k % 50 <> 1 AND k % 11 = 0""")
def verified_rows(spark, sf_dir):
    """A written table held against its plan by key: rows left out, values and states changed."""
    source = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.lit("positive").alias("state"))
    out = source.filter("k % 50 != 1").withColumn("seg", F.when(F.col("k") % 7 == 0, "OTHER").otherwise(F.col("seg"))).withColumn("state", F.when(F.col("k") % 11 == 0, "negative").otherwise(F.col("state")))
    return rl.changed_cells(out, source, (rl.Plan("seg", "label", "keep"),), "requested", lambda c: c, "k", "state")


@query("""
SELECT coalesce(f.name, e.name) AS name, CASE WHEN f.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unexpected' ELSE 'changed' END AS problem
FROM (SELECT p_partkey AS name, length(p_name) AS l, sha256(p_name) AS d FROM part WHERE p_partkey % 9 <> 0) f
FULL JOIN (SELECT p_partkey AS name, length(p_name) AS l, sha256(CASE WHEN p_partkey % 8 = 3 THEN upper(p_name) || '!' ELSE p_name END) AS d FROM part WHERE p_partkey % 9 <> 1) e ON f.name = e.name
WHERE f.name IS NULL OR e.name IS NULL OR f.l <> e.l OR f.d <> e.d""")
def compared_files(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name, text = F.col("p_partkey").alias("name"), F.col("p_name")
    found = p.filter("p_partkey % 9 != 0").select(name, F.length(text).alias("length"), F.sha2(text, 256).alias("sha256"))
    other = F.when(F.col("p_partkey") % 8 == 3, F.concat(F.upper(text), F.lit("!"))).otherwise(text)
    expected = p.filter("p_partkey % 9 != 1").select(name, F.length(text).alias("length"), F.sha2(other, 256).alias("sha256"))
    return rl.compare_manifest(found, expected)


@query("""
WITH p AS (SELECT row_number() OVER (ORDER BY c_custkey) AS place FROM customer)
SELECT place, CASE WHEN place % 97 = 0 THEN 'lost' ELSE 'changed' END AS fault FROM p WHERE place % 97 = 0 OR place % 89 = 0""")
def session_file_faults(spark, sf_dir):
    """What is named where rows of a saved file were taken out, and others changed, behind its back."""
    frames, manifest = session_file.save(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"], "key")
    frames, manifest = materialize(frames, "frames"), materialize(manifest, "manifest")
    spoiled = frames.filter("place % 97 != 0").withColumn("frame", F.when(F.col("place") % 89 == 0, F.concat("frame", F.lit(" "))).otherwise(F.col("frame")))
    return session_file.faults(spoiled, manifest, "key")
