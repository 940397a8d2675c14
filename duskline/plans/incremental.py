"""Versions of documents, change logs of events, decisions on documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import build as bd
from ..operators import components as cp
from ..operators import evidence as ev
from ..operators import incremental as ic
from ..session import materialize, shared_dir, table
from ..streaming import changes as st
from ..streaming import results as rs
from .registry import query

_OLD = "SELECT doc_id, sha256(text) AS d FROM documents WHERE doc_id % 6 <> 0"
_NEW = "SELECT CASE WHEN doc_id % 10 = 7 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, sha256(CASE WHEN doc_id % 5 = 1 THEN text || '.' ELSE text END) AS d FROM documents WHERE doc_id % 6 <> 1"


def _versions(spark, sf_dir):
    """Two versions of all documents: some are only in the one, others only in the other, some changed or moved."""
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 6 <> 0").select("doc_id", F.sha2("text", 256).alias("d"))
    new = docs.filter("doc_id % 6 <> 1").select(F.when(F.col("doc_id") % 10 == 7, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")).alias("doc_id"), F.sha2(F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("d"))
    return old, new


@query(f"""
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.d <> n.d THEN 'changed' ELSE 'same' END AS change
FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.doc_id = n.doc_id""")
def document_diff(spark, sf_dir):
    return ic.diff(*_versions(spark, sf_dir), "doc_id", "d").select("doc_id", "change")


@query(f"""
WITH o AS ({_OLD}), n AS ({_NEW}), r AS (SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)), a AS (SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o))
SELECT min(r.doc_id) AS removed, min(a.doc_id) AS added FROM r JOIN a ON r.d = a.d GROUP BY r.d HAVING count(DISTINCT r.doc_id) = 1 AND count(DISTINCT a.doc_id) = 1""")
def inferred_renames(spark, sf_dir):
    return ic.renames(*_versions(spark, sf_dir), "doc_id", "d")


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def uncached_work(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return ic.work_left(docs, docs.filter("doc_id % 2 = 0").select("digest"), "digest").select("doc_id")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_change(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return ic.latest(e, "user_id", "event_id")


_LAST = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events {}) WHERE r = 1"


@query(f"""
WITH c AS ({_LAST.format("WHERE event_id >= 50")}), b AS ({_LAST.format("WHERE event_id < 50")})
SELECT user_id, event_id, event_type FROM c WHERE event_type <> 'purchase' UNION ALL SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM c)""")
def merged_snapshot(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    base = ic.latest(e.filter("event_id < 50"), "user_id", "event_id")
    log = e.filter("event_id >= 50").withColumn("deleted", F.col("event_type") == "purchase")
    return ic.merge_changes(base, log, "user_id", "event_id")


@query(f"SELECT user_id, event_id, event_type FROM ({_LAST.format('')}) WHERE event_type <> 'purchase'")
def streamed_snapshot(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = st.read_changes(spark, f"{sf_dir}/events*.parquet", schema).select("user_id", "event_id", "event_type", (F.col("event_type") == "purchase").alias("deleted"))
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = st.keep_snapshot(stream, f"{at}/table", f"{at}/progress", "user_id", "event_id")
    return st.last_snapshot(spark, q, f"{at}/table", key="user_id", order="event_id")


@query("SELECT 'u' || user_id || '/' || event_id AS relpath FROM events WHERE event_type = 'purchase' AND ('u' || user_id) LIKE '%7%'")
def refiltered_stream(spark, sf_dir):
    """A view of all events as they stream, after the filter changed: it has what a filter over all of them has."""
    schema = table(spark, sf_dir, "events").schema
    stream = st.read_changes(spark, f"{sf_dir}/events*.parquet", schema).select(
        F.concat(F.lit("u"), "user_id", F.lit("/"), "event_id").alias("relpath"), (F.col("event_type") == "view").alias("is_dir"),
        F.array(F.struct(F.col("event_type").alias("category"), F.concat(F.lit("u"), "user_id").alias("surface"))).alias("signals"))
    at = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    log = rs.ResultLog(spark, at, "relpath string, is_dir boolean, signals array<struct<category:string,surface:string>>")
    log.follow(stream, f"{at}-progress", rs.Filter(kind="dir")).awaitTermination()
    changed = rs.Filter(categories=("purchase",))
    while log.catch_up(changed):
        pass
    return log.results(changed).filter(F.array_contains(F.transform("signals", lambda s: s["surface"].contains("7")), True)).select("relpath")


@query("SELECT event_id, user_id FROM events WHERE event_id >= 100 AND event_id < 900 AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def late_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("usn"), F.col("user_id").alias("parent"))
    allowed = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    log = ic.change_range(e, 100, 900, 0, "j", "j")
    return ic.late_changes(log, 100, allowed).select(F.col("usn").alias("event_id"), F.col("parent").alias("user_id"))


@query("SELECT event_id, user_id FROM events WHERE event_id >= 100 AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def late_changes_to_end(spark, sf_dir):
    """All changes after the checkpoint, up to the last one of the log."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("usn"), F.col("user_id").alias("parent"))
    allowed = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    last = e.agg(F.max("usn")).first()[0]
    log = ic.change_range(e, 100, max(100, (100 if last is None else last + 1)), 0, "j", "j")
    return ic.late_changes(log, 100, allowed).select(F.col("usn").alias("event_id"), F.col("parent").alias("user_id"))


@query("""
WITH l AS (SELECT event_id AS seq, user_id AS row_id, event_type AS state, event_id % 3 = 0 AS undo FROM events),
o AS (SELECT *, sum(CASE WHEN undo THEN -1 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM l)
SELECT row_id, coalesce(arg_max(state, seq) FILTER (open >= 1), 'pending') AS state FROM o GROUP BY row_id""")
def standing_decisions(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("row_id"), F.col("event_type").alias("state"), (F.col("event_id") % 3 == 0).alias("undo"))
    return ic.decisions(log)


@query("SELECT CASE WHEN quality = 1 THEN 'confirmed' WHEN quality IS NOT NULL THEN 'rejected' ELSE 'pending' END AS state, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality IS NOT NULL GROUP BY 1")
def review_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    done = table(spark, sf_dir, "labels").filter("quality is not null").select(F.col("doc_id").alias("row_id"), F.when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("state"))
    return ic.review_counts(rows, done)


@query("SELECT c_custkey AS correction_id FROM customer LEFT JOIN documents ON doc_id = c_custkey WHERE n_chars IS NULL OR n_chars <> 500 OR lang <> 'en' OR lang IS NULL")
def stale_corrections(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("correction_id"), F.col("c_custkey").alias("document_id"), F.lit(500).cast("long").alias("revision"), F.lit("en").alias("template"))
    f = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("revision"), F.col("lang").alias("template"))
    return ic.stale(a, f)


@query("SELECT CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 1 THEN 'NEEDS_REVIEW' WHEN o_orderstatus = 'O' THEN 'VALIDATED' ELSE 'PUBLISHED' END AS state, count(*) AS n FROM orders GROUP BY 1")
def invalidated_plans(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    plans = o.select(F.col("o_orderkey").alias("workspace"), F.lit(1).alias("revision"), F.when(F.col("o_orderstatus") == "O", "VALIDATED").otherwise("PUBLISHED").alias("state"))
    now = o.select(F.col("o_orderkey").alias("workspace"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("revision"))
    return ic.invalidate(plans, now).groupBy("state").agg(F.count("*").alias("n"))


# ---- an inventory of users' files under regions and nations, built from a snapshot and its journal of events -------


def _built(spark, sf_dir):
    """Built at four tenths, eight tenths and the end of the events: view events change no name, a purchase removes its user's file."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    last = (e.agg(F.max("event_id")).first()[0] or 0) + 1
    at = bd.Cursors("events", last * 4 // 10, last * 8 // 10, last)
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    yes, no = F.lit(True), F.lit(False)
    place = (F.col("user_id") % 25 + 10).cast("long")
    columns = lambda id_, parent, name, is_dir, is_link: [id_.cast("long").alias("id"), parent.cast("long").alias("parent"), name.alias("name"), is_dir.alias("is_dir"), is_link.alias("is_link")]
    dirs = region.select(*columns(F.col("r_regionkey") + 1, F.lit(0), F.col("r_name"), yes, no))
    dirs = dirs.unionByName(nation.select(*columns(F.col("n_nationkey") + 10, F.col("n_regionkey") + 1, F.col("n_name"), yes, F.col("n_nationkey") == 5)))
    dirs = dirs.unionByName(spark.createDataFrame([(0, 0, ".", True, False), (99, 17, ".keep", False, False)], dirs.schema))
    own = lambda df: ic.latest(df, "user_id", "event_id").select(*columns(F.col("user_id") + 1000, place, F.concat(F.lit("u"), "user_id", F.lit("-"), "event_type"), no, no), "event_type", "user_id")
    base = own(e.filter(F.col("event_id") < at.start))
    now = own(e.filter(F.col("event_id") < at.end)).filter("event_type != 'purchase'")
    journal = e.select(F.col("event_id").alias("usn"), (F.col("user_id") + 1000).cast("long").alias("id"), place.alias("parent"), F.col("event_type").alias("name"), F.when(F.col("event_type") == "view", 1).otherwise(0x200).alias("reason"))
    structural = journal.filter((F.col("usn") >= at.start) & (F.col("usn") < at.end) & (F.col("reason") != 1)).select("id").distinct()
    merged = base.join(structural, "id", "left_anti").unionByName(now.join(structural, "id", "left_semi"))
    second = merged.filter("user_id % 7 = 0").select("id", (F.pmod(F.col("user_id") + 1, F.lit(25)) + 10).cast("long").alias("parent"), F.concat(F.lit("v"), "user_id").alias("name"))
    links = merged.select("id", "parent", "name").unionByName(second).unionByName(dirs.filter("not is_dir").select("id", "parent", "name"))
    nodes = dirs.unionByName(base.select(dirs.columns))
    return bd.build_inventory(nodes, journal, now.select(dirs.columns), links, 0, at, known_journal="events", excludes=("a*",), marker=".keep")


_BUILT = """
WITH m AS (SELECT (coalesce(max(event_id), 0) + 1) * 4 // 10 AS a, (coalesce(max(event_id), 0) + 1) * 8 // 10 AS b FROM events),
base AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events, m WHERE event_id < a GROUP BY 1),
now AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events, m WHERE event_id < b GROUP BY 1),
changed AS (SELECT DISTINCT user_id FROM events, m WHERE event_id >= a AND event_id < b AND event_type <> 'view'),
merged AS (SELECT * FROM base WHERE user_id NOT IN (SELECT user_id FROM changed) UNION ALL SELECT * FROM now WHERE t <> 'purchase' AND user_id IN (SELECT user_id FROM changed)),
region_ AS (SELECT * FROM region WHERE NOT r_name ILIKE 'a%'),
nation_ AS (SELECT n_nationkey, r_name || '/' || n_name AS p FROM nation JOIN region_ ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (5, 7) AND NOT n_name ILIKE 'a%'),
names AS (SELECT user_id % 25 AS n, 'u' || user_id || '-' || t AS name FROM merged UNION ALL SELECT (user_id + 1) % 25, 'v' || user_id FROM merged WHERE user_id % 7 = 0)
"""


@query(_BUILT + """SELECT p || '/' || name AS relpath, false AS is_dir FROM names JOIN nation_ ON n = n_nationkey
UNION ALL SELECT p, true FROM nation_ UNION ALL SELECT r_name, true FROM region_""")
def built_inventory(spark, sf_dir):
    return _built(spark, sf_dir).entries.select("relpath", "is_dir")


@query(_BUILT + """SELECT (SELECT count(*) FROM base) + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + 2 AS records, (SELECT count(*) FROM changed) AS journal_updates,
  (SELECT count(*) FROM names JOIN nation_ ON n = n_nationkey) AS link_names,
  (SELECT count(*) FROM events, m WHERE event_id >= b AND event_type <> 'view' AND user_id % 25 IN (SELECT n_nationkey FROM nation_)) AS late_changes""")
def built_inventory_counts(spark, sf_dir):
    return _built(spark, sf_dir).counts.select("records", "journal_updates", "link_names", "late_changes")


# ---- witnesses by dependency component: each nation's customers, orders and items, and one nation that changes ------

_PERSON, _ORDER = ev.Field("cust", "key", "customers", "person"), ev.Field("ord", "key", "orders", "event")
_CHANGED = 7


def _placed(spark, sf_dir):
    """Customers with their nation, and orders and items with that of their customer, written once for all versions."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cust"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("ord"), F.col("o_custkey").cast("string").alias("cust")).join(c.select("cust", "n"), "cust")
    o = materialize(o, "orders")
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("ord"), F.col("l_returnflag").alias("flag")).join(o.select("ord", "n"), "ord")
    return c, o, materialize(i, "items")


def _nations(c, o, i, changed: bool):
    """Assertions, cells, primary keys and revisions of three documents for each nation. In the second version the items of
    one nation that were returned are denied."""
    denied = (F.col("n") == _CHANGED) & (F.col("flag") == "R") if changed else F.lit(False)
    i = i.withColumn("state", F.when(denied, "negative").otherwise("positive"))
    shapes = (("customer", c, ev.Template("cust", (_PERSON, ev.Field("name", "identity")))), ("orders", o, ev.Template("cust", (_PERSON, _ORDER))), ("items", i, ev.Template("ord", (_ORDER, ev.Field("flag", "sensitive")), state_field="state")))
    rows, cells, primary, revisions = [], [], [], []
    for name, df, t in shapes:
        doc = F.concat(F.lit(name + "-"), F.col("n").cast("string"))
        of = {f.name: f for f in t.fields}
        # every document of a table is asserted at once, named by the nation; what is said of a narrow written row needs no table of its own
        named = df.withColumn("document_id", doc)
        rows.append(ev.assertions(named, t, F.col("document_id")))
        cells += [named.select("document_id", F.lit(f.role).alias("role"), F.lit(f.entity_type).alias("entity_type"), F.lit(f.namespace).alias("namespace"), F.col(f.name).alias("value")) for f in t.fields]
        primary.append(named.select("document_id", F.lit(of[t.primary].entity_type).alias("entity_type"), F.lit(of[t.primary].namespace).alias("namespace")).distinct())
        content = F.xxhash64(*[F.col(x) for x in named.columns])
        revisions.append(named.groupBy("document_id").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(content.cast("decimal(38,0)")).cast("string")).alias("revision")))

    def union(dfs):
        out = dfs[0]
        for more in dfs[1:]:
            out = out.unionByName(more)
        return out

    return union(rows), union(cells), materialize(union(primary), "nations"), materialize(union(revisions), "nations")


@query(f"""
WITH i AS (SELECT DISTINCT o_custkey, l_orderkey, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
d AS (SELECT c_nationkey AS n, count(*) AS k FROM i JOIN customer ON c_custkey = o_custkey WHERE NOT (c_nationkey = {_CHANGED} AND l_returnflag = 'R') GROUP BY 1)
SELECT 'customer-' || c_nationkey AS component, c_nationkey = {_CHANGED} AS recomputed, count(*) AS names, coalesce(max(k), 0)::BIGINT AS joins FROM customer LEFT JOIN d ON n = c_nationkey GROUP BY c_nationkey""")
def recomputed_components(spark, sf_dir):
    cache = cp.ResultCache(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", cp.WITNESSES)
    placed = _placed(spark, sf_dir)
    cp.refresh_witnesses(*_nations(*placed, False), cache)
    got = cp.refresh_witnesses(*_nations(*placed, True), cache)
    n = lambda rule: F.count_if(F.col("rule") == rule)
    per = got.results.groupBy("component").agg(n("identity_mapping").alias("names"), n("numbered_join").alias("joins"))
    return got.components.join(per, "component").select("component", "recomputed", "names", "joins")
