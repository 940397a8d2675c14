"""Evidence over customers (identities), orders (relations) and line items (sensitive facts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..session import table
from .registry import query

PERSON = ev.Field("cust", "key", "customers", "person")
ORDER = ev.Field("ord", "key", "orders", "event")


def _facts(spark, sf_dir, by_document=False):
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    people = c.select(F.col("c_custkey").cast("string").alias("cust"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").cast("string").alias("nat"))
    bridges = o.select(F.col("o_custkey").cast("string").alias("cust"), F.col("o_orderkey").cast("string").alias("ord"))
    facts = li.select(F.col("l_orderkey").cast("string").alias("ord"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_linestatus") == "F", "negative").otherwise("positive").alias("state"))
    rows = ev.assertions(people, ev.Template("cust", (PERSON, ev.Field("name", "identity"), ev.Field("seg", "quasi"), ev.Field("nat", "quasi"))), "customer")
    rows = rows.unionByName(ev.assertions(bridges, ev.Template("cust", (PERSON, ORDER)), "orders"))
    rows = rows.unionByName(ev.assertions(facts, ev.Template("ord", (ORDER, ev.Field("flag", "sensitive")), state_field="state"), "lineitem"))
    return ev.evidence(rows, by_document=by_document, written=True)


_OPEN = "SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_linestatus = 'O') > 0 AND count(*) FILTER (l_linestatus = 'F') = 0"


@query(f"SELECT c_name AS name, count(*) AS n_joins FROM customer JOIN orders ON o_custkey = c_custkey JOIN ({_OPEN}) ON l_orderkey = o_orderkey GROUP BY 1")
def numbered_joins(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    names = facts.filter("kind = 'identity'").select(F.col("source").alias("subject"), F.col("value").alias("name"))
    found = ev.witnesses(facts, rules=("numbered_join",))
    return found.join(names, "subject").groupBy("name").agg(F.count("*").alias("n_joins"))


@query(f"SELECT count(*) AS incremental FROM customer JOIN orders ON o_custkey = c_custkey JOIN ({_OPEN}) ON l_orderkey = o_orderkey")
def joins_over_several_files(spark, sf_dir):
    found = ev.witnesses(_facts(spark, sf_dir), rules=("numbered_join",))
    alone = ev.witnesses(_facts(spark, sf_dir, by_document=True), by_document=True, rules=("numbered_join",))
    return ev.incremental_joins(found, alone).agg(F.count("*").alias("incremental"))


@query("""
WITH g AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT n AS support, sum(n)::BIGINT AS entities, (SELECT count(*) FROM customer) AS population FROM g WHERE n <= 8 GROUP BY n""")
def quasi_combinations(spark, sf_dir):
    found = ev.witnesses(_facts(spark, sf_dir), ("seg", "nat"), max_support=8, rules=("quasi_combination",))
    return found.groupBy("support").agg(F.count("*").alias("entities"), F.max("population").alias("population"))


@query("SELECT count(*) AS conflicts FROM (SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linestatus) = 2)")
def conflicting_facts(spark, sf_dir):
    return ev.conflicts(_facts(spark, sf_dir))


@query("""
SELECT s AS state, coalesce(n, 0) AS n FROM (SELECT unnest(['positive', 'negative', 'quoted', 'unknown']) AS s) LEFT JOIN (
  SELECT state, count(*) AS n FROM (
    SELECT 'positive' AS state FROM customer UNION ALL SELECT 'positive' FROM customer UNION ALL SELECT 'positive' FROM customer UNION ALL
    SELECT 'positive' FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) UNION ALL
    SELECT CASE l_linestatus WHEN 'F' THEN 'negative' ELSE 'positive' END FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem)) GROUP BY state) ON state = s""")
def facts_by_state(spark, sf_dir):
    return ev.state_counts(_facts(spark, sf_dir))


@query("SELECT lower(c_mktsegment) AS label, count(*) AS n_members FROM customer GROUP BY 1 HAVING count(*) > 1")
def name_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cust"), F.col("c_mktsegment").alias("seg"))
    facts = ev.evidence(ev.assertions(c, ev.Template("cust", (PERSON, ev.Field("seg", "label"))), "customer"))
    return ev.candidates(facts).select("label", F.size("members").cast("long").alias("n_members"))


@query("SELECT count(*) AS cuts, count(*) AS blocking FROM (SELECT 1 FROM customer UNION ALL SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey JOIN (" + _OPEN + ") ON l_orderkey = o_orderkey, range(3))")
def witness_cuts(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return ev.cuts(ev.witnesses(facts), facts).agg(F.count("*").alias("cuts"), F.count_if("blocks").alias("blocking"))


@query("SELECT r_name AS name, r_regionkey::VARCHAR AS id, r_regionkey % 2 = 1 AS quoted FROM region")
def line_records(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    line = F.concat(F.when(F.col("r_regionkey") % 2 == 1, "> ").otherwise(""), F.lit("id="), F.col("r_regionkey").cast("string"), F.lit(";name="), "r_name")
    return ev.line_records(r.select(F.concat(line, F.lit("\n\n")).alias("text")), ("id", "name")).select("name", "id", "quoted")
