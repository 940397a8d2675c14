"""Combination risk over customers, and over an inventory of invented subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import alias, detect, graph, policy, risk
from ..operators import inventory as iv
from ..session import materialize, spread, table
from .registry import query

_BAND = "CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 3000 THEN 'low' WHEN c_acctbal < 6000 THEN 'mid' ELSE 'high' END"
_Q = f"SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_nationkey::VARCHAR AS nat, {_BAND} AS band FROM customer"


def _customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    b = F.col("c_acctbal")
    band = F.when(b >= 0, F.when(b < 3000, "low").when(b < 6000, "mid").otherwise("high"))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("seg"), F.col("c_nationkey").cast("string").alias("nat"), band.alias("band"))


@query(f"WITH q AS ({_Q}) SELECT c_custkey, count(*) OVER (PARTITION BY seg, nat, band) AS support FROM q WHERE seg IS NOT NULL AND nat IS NOT NULL AND band IS NOT NULL")
def k_support(spark, sf_dir):
    return risk.support(_customers(spark, sf_dir), ("seg", "nat", "band")).select("c_custkey", "support")


@query(f"""
WITH q AS ({_Q})
SELECT a.c_custkey, concat_ws('+', CASE WHEN a.seg IS NOT NULL THEN 'seg' END, 'nat', CASE WHEN a.band IS NOT NULL THEN 'band' END) AS identifying, count(*) AS support
FROM q a JOIN q b ON b.nat = a.nat AND (a.seg IS NULL OR b.seg = a.seg) AND (a.band IS NULL OR b.band = a.band)
WHERE (a.seg IS NOT NULL)::INT + (a.band IS NOT NULL)::INT >= 1 GROUP BY 1, 2""")
def superset_support(spark, sf_dir):
    s = risk.superset_support(_customers(spark, sf_dir), ("seg", "nat", "band"), id_column="c_custkey")
    return s.select("c_custkey", F.array_join("identifying", "+").alias("identifying"), "support")


@query(f"""
WITH q AS ({_Q})
SELECT 'seg+nat' AS subset, seg || '|' || nat AS key, count(*) AS n FROM q WHERE seg IS NOT NULL GROUP BY 2
UNION ALL SELECT 'seg+band', seg || '|' || band, count(*) FROM q WHERE seg IS NOT NULL AND band IS NOT NULL GROUP BY 2
UNION ALL SELECT 'nat+band', nat || '|' || band, count(*) FROM q WHERE band IS NOT NULL GROUP BY 2
UNION ALL SELECT 'seg+nat+band', seg || '|' || nat || '|' || band, count(*) FROM q WHERE seg IS NOT NULL AND band IS NOT NULL GROUP BY 2""")
def all_subset_groups(spark, sf_dir):
    return risk.subset_groups(_customers(spark, sf_dir), ("seg", "nat", "band"))


@query("""
WITH RECURSIVE e AS (SELECT a.c_custkey AS s, b.c_custkey AS d FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 7 WHERE a.c_custkey % 5 <> 0),
r AS (SELECT s AS node, s AS root FROM e UNION SELECT d, d FROM e UNION SELECT e.d, r.root FROM r JOIN e ON e.s = r.node)
SELECT node, min(root) AS component FROM r GROUP BY node""")
def connected_components(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    edges = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 7).alias("dst")).join(c.withColumnRenamed("c_custkey", "dst"), "dst", "left_semi")
    return graph.connected_components(edges)


def _subjects(spark, sf_dir):
    """A folder for every hundredth customer key, with a dated school record for each customer."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    month = F.lpad((F.col("c_custkey") % 12 + 1).cast("string"), 2, "0")
    path = F.concat(F.lit("subject-"), (F.col("c_custkey") % 100).cast("string"), F.lit("/北京大学/计算机专业/2024-"), month, F.lit("-记录-"), F.col("c_custkey").cast("string"), F.lit(".txt"))
    paths = c.select(path.alias("relpath"), F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("size"))
    special = ("case-1/北京市海淀区/2024-06-17住院记录.txt", "case-2/上海市浦东区/2023-01-02判决书.txt", "case-3/某某公司/工程师/上海.txt")
    special = spark.createDataFrame([(p, False, 1) for p in special], "relpath string, is_dir boolean, size long").coalesce(1)
    return iv.entries(paths.unionByName(special))


@query()
def combination_risks(spark, sf_dir):
    entries = _subjects(spark, sf_dir)
    found = risk.analyze(entries, materialize(detect.signals(entries, lx.Rules()), "signals"))
    return found.groupBy("risk_type", "severity", "score").agg(F.count("*").alias("n"), F.min("support").alias("least_support"))


@query()
def enforced_policy(spark, sf_dir):
    entries = _subjects(spark, sf_dir).withColumn("hidden", F.lit(False))
    result = policy.enforce(entries, detect.signals(entries, lx.Rules(), context=False), lx.Rules())
    return result["entries"].select("relpath", "is_dir", "hidden", "depth")


@query("""
SELECT n_name || unnest(['', '/[PATH]', '/[PATH]/file.txt']) AS relpath, unnest([true, true, false]) AS is_dir FROM nation""")
def blurred_structure(spark, sf_dir):
    c = table(spark, sf_dir, "nation")
    leaf = c.select(F.concat(F.col("n_name"), F.lit("/a/b/c/file.txt")).alias("relpath"), F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("size"))
    dirs = c.select(F.explode(F.array(*[F.concat(F.col("n_name"), F.lit(s)) for s in ("", "/a", "/a/b", "/a/b/c")])).alias("relpath"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"))
    return policy.blur_structure(iv.entries(leaf.unionByName(dirs))).select("relpath", "is_dir")


_SEEN = "SELECT c_name AS surface, min(o_orderdate) AS first_seen FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"


@query(f"""
WITH s AS ({_SEEN}), m AS (SELECT surface, row_number() OVER (ORDER BY surface) AS i FROM s WHERE surface LIKE '%7')
SELECT 'PERSON' AS category, surface, 'PERSON_' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS alias FROM (
  SELECT surface, row_number() OVER (ORDER BY first_seen, surface) + (SELECT coalesce(max(i), 0) FROM m) AS n FROM s WHERE NOT surface LIKE '%7')""")
def new_aliases(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    seen = c.join(o, c.c_custkey == o.o_custkey).select(F.lit("PERSON").alias("category"), F.col("c_name").alias("surface"), F.col("o_orderdate").alias("first_seen"))
    return alias.allocate(seen, _mapping(seen))


def _mapping(seen):
    """The mapping that a run before this one would have left."""
    old = iv.number_rows(seen.filter("surface like '%7'").select("surface").distinct(), "surface", kind="long")
    return old.select(F.lit("NAME_LIST").alias("category"), "surface", F.concat(F.lit("PERSON_"), alias.numeral(F.col("ordinal"))).alias("alias"))


@query(f"""WITH s AS ({_SEEN})
SELECT surface, 'PERSON_' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS alias FROM (SELECT surface, row_number() OVER (ORDER BY surface) AS i FROM s WHERE surface LIKE '%7')""")
def known_aliases(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    seen = c.join(o, c.c_custkey == o.o_custkey).select(F.lit("PERSON").alias("category"), F.col("c_name").alias("surface"))
    return alias.lookup(seen.distinct(), _mapping(seen)).filter("alias is not null").select("surface", "alias")


@query("""
WITH n AS (SELECT p_partkey, p_brand, p_type || '.txt' AS leaf, row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY lpad(p_partkey::VARCHAR, 12, '0')) AS i, p_type FROM part)
SELECT p_partkey, CASE WHEN i = 1 THEN leaf ELSE p_type || '__' || i || '.txt' END AS planned FROM n""")
def collision_free_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat("p_type", F.lit(".txt")).alias("leaf"), F.lit(False).alias("is_dir"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("relpath"))
    return alias.plan_paths(p, "p_brand", "leaf").select("p_partkey", "planned")
