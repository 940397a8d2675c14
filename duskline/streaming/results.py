"""Results of a running scan, kept by micro-batch, with counters, filtered views that follow the stream, and pages of them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.review import filter_results

#: Batches that one call brings into a view that is behind.
STEP = 32
PROGRESS = "batch long, rows long, directories long, with_signals long"


@dataclass(frozen=True)
class Filter:
    """What review.filter_results takes. Equal filters have one view, whatever the order of categories and the query's case."""

    kind: str | None = None
    categories: tuple[str, ...] = ()
    query: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "categories", tuple(sorted(set(self.categories))))
        object.__setattr__(self, "query", (self.query or "").strip().lower() or None)

    @property
    def key(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:32]

    def of(self, rows: DataFrame) -> DataFrame:
        return filter_results(rows, self.kind, list(self.categories), self.query)


class ResultLog:
    """Results (relpath, is_dir, signals, ...) of a scan in a folder that all executors share.

    Each micro-batch is one folder, and so is what of it passes a filter; both are written whole before the note of
    progress that makes them count, and a batch that is tried again overwrites itself. So a view is the filter of all
    batches that it has reached, whatever broke off when. A changed filter starts a view of its own at the
    first batch; the views of former filters stay, and go on where they were if their filter comes back.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _note(self, name: str, batch: int, counts: dict) -> None:
        row = (batch, *(int(counts.get(k) or 0) for k in ("rows", "directories", "with_signals")))
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/progress/{name}/{batch}")

    def progress(self, name: str = "results") -> DataFrame:
        """Rows (batch, rows, directories, with_signals) of the batches that count: one for each."""
        return self._read(f"{self.folder}/progress/{name}/*", PROGRESS)

    def _put(self, name: str, batch: int, rows: DataFrame) -> None:
        """Writes a batch and counts it as it is written, in the same pass."""
        seen = Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("is_dir").alias("directories"), F.count_if(F.size("signals") > 0).alias("with_signals"))
        counted.write.mode("overwrite").parquet(f"{self.folder}/{name}/{batch}")
        self._note(name, batch, seen.get)

    def follow(self, stream: DataFrame, checkpoint: str, active: Filter | None = None) -> StreamingQuery:
        """Keeps the stream's batches and, with an active filter, brings its view up to each. With another filter the query
        is started again on the same checkpoint: it goes on with the next batch, and the new view catches up."""

        def keep(batch: DataFrame, number: int) -> None:
            self._put("results", number, batch)
            while active and self.catch_up(active):
                pass

        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _behind(self, active: Filter) -> list[int]:
        """Numbers of the batches that a view has not reached: the driver holds numbers of batches only."""
        done = self.progress(active.key).select("batch")
        return [r.batch for r in self.progress().select("batch").join(done, "batch", "left_anti").orderBy("batch").collect()]

    def catch_up(self, active: Filter, most: int = STEP) -> int:
        """Brings at most so many batches into a filter's view, the oldest first; returns how many are still missing."""
        behind = self._behind(active)
        for number in behind[:most]:
            self._put(active.key, number, active.of(self._read(f"{self.folder}/results/{number}", self.schema)))
        return len(behind[most:])

    def results(self, active: Filter | None = None) -> DataFrame:
        """Rows of all batches that count, with their batch; of a filter's view where there is one."""
        name = active.key if active else "results"
        numbers = [r.batch for r in self.progress(name).collect()]
        out = self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(None).cast("long"))
        if not numbers:
            return out
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{name}/{n}" for n in numbers])
        return rows.withColumn("batch", F.element_at(F.split("_metadata.file_path", "/"), -2).cast("long"))

    def counters(self, active: Filter | None = None) -> DataFrame:
        """One row: batches, rows, directories, with_signals, as they were counted when they were written."""
        p = self.progress(active.key if active else "results")
        return p.agg(F.count("*").alias("batches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "directories", "with_signals")])

    def page(self, number: int, size: int, active: Filter | None = None) -> tuple[DataFrame, int, int]:
        """A page of results or of a view in order of batch and path, its number, which stays within what there is, and the batches
        still missing in the view."""
        n = self.counters(active).first()["rows"]
        number = max(0, min(number, (n - 1) // size))
        rows = self.results(active).orderBy("batch", "relpath").offset(number * size).limit(size)
        return rows, number, len(self._behind(active)) if active else 0
