"""Session helpers: a local session for tests, and tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session as tests and the bench use it; a cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config(map={
        "spark.sql.shuffle.partitions": str(cpus), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", **conf,
    })
    return builder.getOrCreate()


#: Folders of local sessions without spark.checkpoint.dir, which cannot be set any more once a session runs.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster, whose
    executors share no local folder, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        found = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage is cut, and a lost
    executor costs only the tasks that ran on it."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize wrote for df, which nothing may read any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by the columns to as many tasks as a shuffle has or the cluster runs at once: for short rows that each take long, which
    their bytes alone would leave in one task."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # by a digest, so that it is never taken for the shuffle of a distinct or join before it, which may be put together again
    return df.repartition(n, F.xxhash64(*columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
