"""The change log as a stream: a snapshot table kept up to date, duplicates dropped, windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import latest


def read_changes(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def once_each(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Events without those that repeat a key within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, delay: str, window: str, by: list[str]) -> DataFrame:
    """Events in each window by group; a window closes when the delay has passed."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def keep_snapshot(stream: DataFrame, target: str, checkpoint: str, key: str = "id", order: str = "usn", compact: int = 16) -> StreamingQuery:
    """Writes the last change of each key of a batch to `target/v=<batch>`; every so many batches a version holds all
    keys. Deletions stay in it as rows, so an older change that comes late cannot bring a row back. A batch that is
    tried again writes the same version again from those before it, so nothing is merged twice."""

    def merge(batch: DataFrame, number: int) -> None:
        now = batch
        if number and number % compact == 0:
            now = _versions(batch.sparkSession, target, number - 1, compact).unionByName(batch)
        latest(now, key, order).write.mode("overwrite").parquet(f"{target}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str, last: int, compact: int) -> DataFrame:
    return spark.read.parquet(*[f"{target}/v={v}" for v in range(last - last % compact, last + 1)])


def read_snapshot(spark: SparkSession, target: str, last: int, key: str = "id", order: str = "usn", deleted: str = "deleted", compact: int = 16) -> DataFrame:
    """The rows that stand after batch `last`: at most `compact` versions are merged."""
    return latest(_versions(spark, target, last, compact), key, order).filter(~F.col(deleted)).drop(deleted)


def last_snapshot(spark: SparkSession, query: StreamingQuery, target: str, **names) -> DataFrame:
    query.awaitTermination()
    return read_snapshot(spark, target, query.lastProgress["batchId"], **names)
