"""Path inventories made of page addresses and of the region, nation, customer tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import generalize as gz
from ..operators import inventory as iv
from ..operators import packing, review
from ..session import table
from .registry import query

_PATH = "regexp_replace(url, '^[a-z]+://', '')"


def _pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.regexp_replace("url", "^[a-z]+://", "").alias("relpath"), F.lit(False).alias("is_dir"), F.length("html").cast("long").alias("size"), "page_id")
    return iv.entries(rows)


@query(f"""
WITH f AS (SELECT string_split({_PATH}, '/') AS p, length(html) AS size FROM pages)
SELECT array_to_string(p[1:i], '/') AS directory, sum(size)::BIGINT AS total_size, count(*) AS n_files
FROM (SELECT p, size, unnest(range(1, len(p))) AS i FROM f) GROUP BY 1""")
def directory_sizes(spark, sf_dir):
    return iv.directory_sizes(_pages(spark, sf_dir))


@query(f"""
WITH f AS (SELECT string_split({_PATH}, '/') AS p, length(html) AS size FROM pages), d AS (
SELECT array_to_string(p[1:i], '/') AS directory, sum(size) AS s FROM (SELECT p, size, unnest(range(1, len(p))) AS i FROM f) GROUP BY 1)
SELECT CASE WHEN s <= 0 THEN '0 B' WHEN s < 1024 THEN '<1 KB' WHEN s < 10240 THEN '1-10 KB' WHEN s < 102400 THEN '10-100 KB' WHEN s < 1048576 THEN '100 KB-1 MB'
  WHEN s < 10485760 THEN '1-10 MB' WHEN s < 104857600 THEN '10-100 MB' WHEN s < 1073741824 THEN '100 MB-1 GB' ELSE '1 GB+' END AS size_label, count(*) AS n FROM d GROUP BY 1""")
def directory_size_bands(spark, sf_dir):
    sizes = iv.directory_sizes(_pages(spark, sf_dir))
    return sizes.groupBy(gz.bucket_size(F.col("total_size")).alias("size_label")).agg(F.count("*").alias("n"))


@query(f"""
SELECT {_PATH} AS relpath FROM pages WHERE len(list_filter(string_split({_PATH}, '/'), lambda x: regexp_full_match(lower(x), '.*7') OR regexp_full_match(lower(x), 'p.1.*'))) = 0""")
def excluded_by_glob(spark, sf_dir):
    return iv.drop_excluded(_pages(spark, sf_dir), ["*7", "P?1*"]).select("relpath")


@query(f"""
SELECT {_PATH} AS relpath, len(string_split({_PATH}, '/')) AS depth FROM pages WHERE len(list_filter(string_split({_PATH}, '/')[:-2], lambda x: contains(lower(x), '3'))) = 0""")
def hidden_subtrees(spark, sf_dir):
    return iv.hide(_pages(spark, sf_dir), ["3"]).select("relpath", F.col("depth").cast("long").alias("depth"))


@query(f"SELECT {_PATH} AS relpath FROM pages WHERE len(string_split({_PATH}, '/')) <= 2")
def depth_limited(spark, sf_dir):
    return iv.limit_depth(_pages(spark, sf_dir), 2).select("relpath")


_TREE = """
WITH t AS (
  SELECT r_name AS p, true AS d, 0 AS s FROM region UNION ALL
  SELECT r_name || '/' || n_name, true, 0 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
  SELECT r_name || '/' || n_name || '/' || c_name, false, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def _tree(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rn = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name", "n_name")
    top = r.select(F.col("r_name").alias("relpath"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"))
    mid = rn.select(F.concat_ws("/", "r_name", "n_name").alias("relpath"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"))
    low = c.join(F.broadcast(rn), c.c_nationkey == rn.n_nationkey).select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("relpath"), F.lit(False).alias("is_dir"), F.col("c_custkey").alias("size"))
    return iv.entries(top.unionByName(mid).unionByName(low))


@query(_TREE + "SELECT a.p AS parent, count(*) AS n_children FROM t a JOIN t b ON b.p LIKE a.p || '/%' AND NOT substr(b.p, length(a.p) + 2) LIKE '%/%' GROUP BY 1")
def parent_edges(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    names = tree.select(F.col("entry_id").alias("parent_id"), F.col("relpath").alias("parent"))
    return iv.parent_edges(tree).join(names, "parent_id").groupBy("parent").agg(F.count("*").alias("n_children"))


@query(_TREE + "SELECT count(*) FILTER (NOT d) AS files, count(*) FILTER (d) AS dirs, 0 AS hidden_dirs FROM t")
def inventory_counts(spark, sf_dir):
    return iv.counts(_tree(spark, sf_dir))


@query(_TREE + ", o AS (SELECT p, row_number() OVER (ORDER BY string_split(p, '/')) AS ordinal FROM t) SELECT p AS relpath, ordinal FROM o")
def tree_in_depth_first_order(spark, sf_dir):
    return iv.flatten_tree(_tree(spark, sf_dir)).select("relpath", F.col("ordinal").cast("long").alias("ordinal"))


@query(_TREE + "SELECT p AS relpath FROM t WHERE NOT d AND p LIKE 'ASIA/%' OR p LIKE '%/%' AND d AND p LIKE 'ASIA/%' OR NOT p LIKE '%/%'")
def tree_with_open_directories(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    open_ = tree.filter("is_dir and (relpath = 'ASIA' or relpath like 'ASIA/%')").select(F.col("relpath").alias("directory"))
    return iv.flatten_tree(tree, open_).select("relpath")


@query("""
SELECT r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name FROM region""")
def resolved_node_paths(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nodes = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("top").alias("parent"), F.col("r_name").alias("name"))
    nodes = nodes.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
    nodes = nodes.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name")))
    return iv.resolve_paths(nodes, "top").select("path")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def names_under_allowed_parents(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    allowed = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    names = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return iv.names_in_allowed(c, allowed, names).select(F.col("id").alias("c_custkey"), F.col("name").alias("c_name"))


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 51")
def page_after_key(spark, sf_dir):
    return iv.keyset_page(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100, 51)


@query("SELECT doc_id, source FROM documents WHERE doc_id < 100 ORDER BY doc_id DESC LIMIT 51")
def page_before_key(spark, sf_dir):
    return iv.keyset_page_before(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100, 51)


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25 OFFSET 40")
def page_by_offset(spark, sf_dir):
    return iv.offset_page(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 40, 25)


@query("SELECT lower(p_name) AS target, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_targets(spark, sf_dir):
    return iv.duplicate_targets(table(spark, sf_dir, "part"), "p_name")


@query("""
SELECT n_name AS parent, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS names FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment <> 'BUILDING' GROUP BY 1""")
def ignore_list_names(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    flagged = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("parent"), F.col("c_mktsegment").alias("name"))
    old = n.select(F.col("n_name").alias("parent"), F.lit("BUILDING").alias("name"))
    return iv.ignore_names(flagged, old).select("parent", F.array_join("names", ",").alias("names"))


@query(_TREE + """SELECT '{"path":"' || p || '","type":"' || CASE WHEN d THEN 'dir' ELSE 'file' END || '","size":"' || s || '"}' AS value FROM t""")
def listing_lines(spark, sf_dir):
    return iv.listing_json(_tree(spark, sf_dir))


@query(_TREE + """, o AS (SELECT p, d, s, row_number() OVER (ORDER BY p) AS i FROM t)
SELECT 0 AS ordinal, '{"root":"all","stats":{"files":' || count(*) FILTER (NOT d) || ',"dirs":' || count(*) FILTER (d) || ',"hidden_dirs":0},"entries":[' AS value FROM t
UNION ALL SELECT i, CASE WHEN i > 1 THEN ',' ELSE '' END || '{"path":"' || p || '","type":"' || CASE WHEN d THEN 'dir' ELSE 'file' END || '","size":"' || s || '"}' FROM o
UNION ALL SELECT count(*) + 1, ']}' FROM t""")
def listing_object(spark, sf_dir):
    return iv.listing(_tree(spark, sf_dir), "all").select(F.col("ordinal").cast("long").alias("ordinal"), "value")


@query("""
SELECT p_partkey, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) ELSE printf('%.1f MB', s / 1048576.0) END AS shown
FROM (SELECT p_partkey, p_partkey * p_size AS s FROM part)""")
def sizes_for_people(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", gz.human_size(F.col("p_partkey") * F.col("p_size")).alias("shown"))


@query("""
SELECT CASE WHEN n <= 0 THEN '0' WHEN n <= 4 THEN '1-4' WHEN n <= 9 THEN '5-9' WHEN n <= 19 THEN '10-19' WHEN n <= 49 THEN '20-49' WHEN n <= 99 THEN '50-99'
  WHEN n <= 499 THEN '100-499' WHEN n <= 999 THEN '500-999' ELSE '1000+' END AS band, count(*) AS n_users
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) GROUP BY 1""")
def event_count_bands(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return per.groupBy(gz.bucket_count(F.col("n")).alias("band")).agg(F.count("*").alias("n_users"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(source), 'src1') AND contains(lower(text), 'token')")
def filtered_results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.lower("source").contains("src1"))
    sig = F.array(F.struct(F.lit("KEYWORD").alias("category"), F.col("text").alias("surface")))
    return review.filter_results(docs.select("doc_id", F.col("source").alias("relpath"), F.lit(False).alias("is_dir"), sig.alias("signals")), "file", ["KEYWORD"], "TOKEN").select("doc_id")


def _customer_files(spark, sf_dir):
    """One path for each order: nation, customer, order."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    named = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return named.select(F.concat_ws("/", "n_name", F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("relpath"), F.lit(False).alias("is_dir"))


@query("""
WITH RECURSIVE f AS (SELECT n_name || '/' || c_custkey || '/' || o_orderkey AS p, n_name || '/' || c_custkey AS d FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
e AS (SELECT p, d, row_number() OVER (ORDER BY p) - 1 AS i FROM f),
s AS (SELECT *, length('{"path":"' || p || '","kind":"file","id":"E' || (i + 1) || '"}') + 1 AS b, coalesce(d <> lag(d) OVER (ORDER BY i), true) AS fresh FROM e),
t AS (SELECT *, sum(b) OVER (ORDER BY i) AS total, max(CASE WHEN fresh THEN i END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s),
l AS (SELECT list(total ORDER BY i) AS totals, list(run ORDER BY i) AS runs, count(*) AS n FROM t),
q AS (SELECT i, total - b AS past, least(i + 40, n) AS j, n, runs,
  list_position(list_transform(totals[i + 1 : i + 41], lambda x: x - (total - b) > 4029), true) AS over FROM t, l),
w AS (SELECT i, n, CASE WHEN over IS NOT NULL THEN least(j, i + over - 1) ELSE j END AS j, runs FROM q),
x AS (SELECT i, CASE WHEN j < n AND runs[j + 1] > i THEN runs[j + 1] ELSE j END AS nxt FROM w),
r AS (SELECT i, nxt FROM x WHERE i = 0 UNION ALL SELECT x.i, x.nxt FROM r JOIN x ON x.i = r.nxt)
SELECT i AS batch, nxt - i AS n_entries FROM r""")
def packed_batches(spark, sf_dir):
    packed = packing.pack_entries(_customer_files(spark, sf_dir), 40, 4096)
    return packed.groupBy("batch").agg(F.count("*").alias("n_entries"))
