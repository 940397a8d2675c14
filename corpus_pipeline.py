"""The corpus pipeline: language ID, near-duplicate removal, decontamination, masking of personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
for the next one. Stages work on all rows that came through: documents without id pass the filters like
any others, an empty table stays empty, columns beyond those of documents are dropped by each stage, texts of any
length are worked on whole, and no result depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.llm import decontaminate, jaccard, langid, mix, pii
from duskline.session import discard, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter and lies near enough to a language that the labelled rows teach. Null texts go; rows that
    are repeated, or have a null id, lang or source, are each judged by their text. Without a labelled row all go."""
    docs = docs.select(*COLUMNS)
    rows = langid.sample(docs, F.lit(True))
    return langid.identify(docs, langid.fit(rows) if rows else None, COLUMNS).filter("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id. Of rows that repeat a doc_id the least
    by their other columns stays; documents without id or without words are linked with nothing and stay."""
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"))
    # ids to take out, and ids that several rows have: both are few, and are written so that their size is known
    marks = groups.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("n"))
    later = materialize(marks.filter("doc_id != least or n > 1").filter("doc_id is not null").select("doc_id", (F.col("doc_id") == F.col("least")).alias("first")), "later")
    docs = docs.select(*COLUMNS)
    left = docs.join(later, "doc_id", "left_anti")
    rest = F.struct(*[c for c in COLUMNS if c != "doc_id"])
    again = docs.join(later.filter("first").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("r"))
    return left.unionByName(again.select("doc_id", "r.*").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row is judged by its text, whatever its id; null and empty texts stay, and
    with an empty benchmark all do."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars is of the new text where it changed. Null
    texts stay null; repeated rows stay; of spans that overlap the first, of equal starts the longest, is replaced."""
    found = pii.find(docs, COLUMNS)
    changed = F.col("spans") != ""
    return found.select("doc_id", F.col("masked_text").alias("text"), "lang", "source", F.when(changed, F.length("masked_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their words (size), copies taken, and their source's size and target. Null
    sources are one source; texts without words are never taken; rows that repeat id, text and source are one row here, which takes
    what all of them take; documents that tie in the shuffled order come by a digest of their text."""
    named = docs.select(*COLUMNS).withColumn("_t", F.xxhash64("text"))
    plan = mix.fair_queue(named, mix.n_words(F.col("text")), carry=("_t",)).filter("taken > 0")
    plan = plan.groupBy(F.col("doc_id").alias("_d"), "_t", F.col("source").alias("_s")).agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"))
    # of rows that repeat id, text and source the least by their other columns stands for all
    one = named.groupBy("doc_id", "_t", "source").agg(F.min(F.struct("lang", "n_chars", "text")).alias("_r")).select("doc_id", "_t", "source", "_r.*")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (one["_t"] == plan["_t"]) & F.col("source").eqNullSafe(F.col("_s"))
    return one.join(plan, same).select(*COLUMNS, "size", (F.col("taken") / F.col("size")).cast("int").alias("copies"), "taken", "source_size", "target")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
]

#: The first stage is a trained classifier, which SQL cannot express; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage wrote is deleted once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return docs
