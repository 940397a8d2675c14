"""Detectors over documents, conversations and order dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import generalize as gz
from ..functions import lexicon as lx
from ..functions.text import apply_edits, find_latin_names, normalize_with_map
from ..operators import detect, inspect, locators, review
from ..session import table
from .registry import query

WORD = r"[\p{L}\p{N}_"
EMAIL = WORD + r".+-]+@" + WORD + r"-]+\." + WORD + ".]+"
CARD = "(^|[^0-9])[0-9]{16,19}([^0-9]|$)"
LISTED = ["idiot", "moron", "loser", "clown", "scum", "pathetic", "worthless"]
ALERTS = ["apache license", "general public license", "licensed under", "token ="]


@query(f"""
SELECT source, count(*) AS n_docs, count(*) FILTER (regexp_matches(text, '{EMAIL}')) AS with_email, count(*) FILTER (regexp_matches(text, '{CARD}')) AS with_card
FROM documents GROUP BY source""")
def detect_pattern_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    has = lambda p: F.count_if(F.col("text").rlike("(?U)" + p))
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), has(lx.PATTERNS["email"]).alias("with_email"), has(lx.PARANOID_PATTERNS["bank_card"]).alias("with_card"))


@query(f"""
SELECT surface, count(*) AS n_found, count(DISTINCT doc_id) AS n_docs
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS surface FROM documents) GROUP BY surface""")
def detect_email_surfaces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?U)" + lx.PATTERNS["email"]), F.lit(0))).alias("surface"))
    return rows.groupBy("surface").agg(F.count("*").alias("n_found"), F.count_distinct("doc_id").alias("n_docs"))


_ALT = "|".join(sorted(LISTED + ALERTS, key=lambda t: (-len(t), t)))


@query(f"""
SELECT lang, CASE WHEN lower(surface) IN ({", ".join(f"'{t}'" for t in LISTED)}) THEN 'NAME_LIST' ELSE 'KEYWORD' END AS category, count(*) AS n
FROM (SELECT lang, unnest(regexp_extract_all(text, '(?i){_ALT}')) AS surface FROM documents) GROUP BY 1, 2""")
def detect_terms_by_language(spark, sf_dir):
    rules = lx.Rules(terms={"KEYWORD": ALERTS, "NAME_LIST": LISTED})
    found = table(spark, sf_dir, "documents").select("lang", F.explode(detect.terms("text", rules)).alias("f"))
    return found.groupBy("lang", F.col("f.category").alias("category")).agg(F.count("*").alias("n"))


@query("""
SELECT role, count(*) AS n_turns, count(*) FILTER (regexp_matches(lower(text), 'worthless|pathetic|idiot')) AS flagged FROM conversations GROUP BY role""")
def detect_conversation_terms(spark, sf_dir):
    rules = lx.Rules(terms={"NAME_LIST": ["worthless", "pathetic", "idiot"]})
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("role").agg(F.count("*").alias("n_turns"), F.count_if(F.size(detect.terms("text", rules)) > 0).alias("flagged"))


@query("""
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS d FROM orders)
SELECT CASE o_orderkey % 3 WHEN 0 THEN 'DATE_DAY' WHEN 1 THEN 'DATE_MONTH' ELSE 'DATE_YEAR' END AS category, d AS surface,
  CASE o_orderkey % 3 WHEN 0 THEN substr(d, 1, 7) WHEN 1 THEN substr(d, 1, 4) ELSE '[DATE]' END AS coarser, count(*) AS n
FROM s GROUP BY 1, 2, 3""")
def detect_and_generalize_dates(spark, sf_dir):
    kind = F.col("o_orderkey") % 3
    day = F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy"))
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("order "), day, F.lit(" note")).alias("name"))
    counted = names.groupBy("name").agg(F.count("*").alias("k"))
    found = counted.select("k", F.explode(detect.dates("name")).alias("f")).select("k", "f.category", "f.surface")
    return found.groupBy("category", "surface", gz.date(F.col("surface")).alias("coarser")).agg(F.sum("k").alias("n"))


@query("""
SELECT count(DISTINCT part) AS distinct_parts, sum(n) AS parts, sum(n) FILTER (regexp_matches(part, '(?i)item')) AS with_term
FROM (SELECT part, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) AS part FROM pages) GROUP BY part)""")
def detect_once_per_component(spark, sf_dir):
    rules = lx.Rules(terms={"KEYWORD": ["item"]}, patterns={}, organisation_ends=[])
    parts = table(spark, sf_dir, "pages").select(F.explode(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")).alias("part"))
    n = parts.groupBy("part").agg(F.count("*").alias("n"))
    hit = detect.findings(parts, "part", detect.terms("part", rules)).select("part").distinct().withColumn("hit", F.lit(True))
    return n.join(hit, "part", "left").agg(F.count("*").alias("distinct_parts"), F.sum("n").alias("parts"), F.sum(F.when(F.col("hit"), F.col("n"))).alias("with_term"))


@query(f"""
SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '{EMAIL}') AND NOT regexp_matches(text, '(?i)token =')""")
def detect_unmatched(spark, sf_dir):
    rules = lx.Rules(terms={"KEYWORD": ["token ="]}, patterns={"email": lx.PATTERNS["email"]})
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.explode(F.concat(detect.terms("text", rules), detect.patterns("text", rules))).alias("f"))
    return docs.join(found, "doc_id", "left_anti").select("doc_id")


@query("""
SELECT CASE WHEN regexp_matches(text, '(?i)token =') THEN 'KEYWORD' ELSE 'OTHER' END AS category, count(*) AS n FROM documents GROUP BY 1""")
def inspection_by_category(spark, sf_dir):
    kind = F.when(F.col("text").rlike("(?i)token ="), "KEYWORD")
    return review.inspection_report(table(spark, sf_dir, "documents").select(kind.alias("category")))


@query()
def normalize_documents(spark, sf_dir):
    """All documents in the normalised view, with the runs that lead back to their text."""
    v = table(spark, sf_dir, "documents").select("doc_id", normalize_with_map(F.col("text")).alias("v"))
    return v.select("doc_id", F.col("v.text").alias("view"), F.col("v.runs").alias("runs"))


@query("SELECT conv_id, turn, '[U]' || substr(text, 4) AS text FROM conversations WHERE role = 'user' AND length(text) >= 3")
def apply_text_edits(spark, sf_dir):
    edit = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("[U]").alias("text")), F.struct(F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("no").alias("text")))
    turns = table(spark, sf_dir, "conversations").filter("role = 'user' and length(text) >= 3")
    return turns.select("conv_id", "turn", apply_edits("text", edit).alias("text"))


@query()
def detect_latin_script_names(spark, sf_dir):
    """Names in Latin script in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.explode(find_latin_names(F.col("text"))).alias("surface"))


@query("""
SELECT doc_id, 'KEYWORD' AS category, u.i - 1 AS start, u.i + 6 AS "end", substr(text, u.i, 7) AS surface
FROM documents, unnest(range(1, length(text) + 1)) AS u(i)
WHERE text IS NOT NULL AND lower(substr(text, u.i, 7)) = 'token ='""")
def inspected_contents(spark, sf_dir):
    """Places of a keyword in all documents, found in the normalised view and led back to the text."""
    rules = lx.Rules(terms={"KEYWORD": ["token ="]}, patterns={})
    return inspect.inspect(table(spark, sf_dir, "documents").select("doc_id", "text"), rules).select("doc_id", "category", "start", "end", "surface")


@query("""
SELECT CASE WHEN d = 1 THEN 'PATTERN' END AS category, count(*) AS n FROM (
  SELECT 1 AS d, unnest(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.]+')) AS m FROM documents) GROUP BY 1""")
def inspected_patterns(spark, sf_dir):
    """E-mail addresses in all documents by the inspector: in the text and in its view a span counts once."""
    rules = lx.Rules(terms={}, patterns={"email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+"})
    return inspect.inspect(table(spark, sf_dir, "documents").select("doc_id", "text"), rules).groupBy("category").agg(F.count("*").alias("n"))


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, line_no, len(regexp_extract_all(line, '{EMAIL}'))::BIGINT AS n_found FROM l WHERE regexp_matches(line, '{EMAIL}')""")
def findings_by_line(spark, sf_dir):
    """Addresses found in whole texts, by the line that they stand in: places of both meet in an interval join."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    before = Window.partitionBy("document_id", "_row").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)

    def spans(pieces, step, name):
        """Pieces of a text with their places, each followed by `step` code points of what parts them."""
        rows = docs.withColumn("_row", F.xxhash64("text")).select("document_id", "_row", F.posexplode(pieces).alias("_i", name))
        past = F.coalesce(F.sum(F.length(f"{name}.a") + step(name)).over(before), F.lit(0))
        return rows.withColumn("_at", past + F.when(F.lit(name == "hit"), F.length(f"{name}.a")).otherwise(0))

    pattern = F.lit("(?U)" + lx.PATTERNS["email"])
    # gaps and hits in turn: a hit starts behind its gap
    turns = F.arrays_zip(F.split("text", "(?U)" + lx.PATTERNS["email"], -1).alias("a"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("b"))
    hits = spans(turns, lambda n: F.length(F.coalesce(F.col(f"{n}.b"), F.lit(""))), "hit").filter("hit.b is not null")
    hits = hits.select("document_id", F.col("_at").alias("start"), (F.col("_at") + F.length("hit.b")).alias("end"))
    lines = spans(F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("a"))), lambda n: F.lit(1), "line")
    lines = lines.select("document_id", F.col("_i").cast("long").alias("line_no"), F.col("_at").alias("start"), (F.col("_at") + F.length("line.a")).alias("end"))
    met = locators.overlapping(hits, lines, "inside")
    return met.groupBy(F.col("document_id").alias("doc_id"), "line_no").agg(F.count("*").alias("n_found"))
