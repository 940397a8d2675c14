"""Results by dependency component under a digest of their inputs: what did not change is read, the rest is worked out."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import evidence as ev
from . import incremental as ic


class ResultCache:
    """Rows kept by digest in a folder that all executors share.

    A batch of rows is written first and its digests after it, so a batch that broke off is never read: rows count
    only with a mark of their batch. A digest without rows is a result as well. Two writers of one digest
    write the same rows, and one batch of them is read.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def digests(self) -> DataFrame:
        """Rows (digest, batch): what is kept."""
        return self._table("done", "digest string, batch string").groupBy("digest").agg(F.min("batch").alias("batch"))

    def rows(self, wanted: DataFrame) -> DataFrame:
        """Kept rows, with their digest, of wanted (digest)."""
        marks = self.digests().join(wanted.select("digest").distinct(), "digest", "left_semi")
        return self._table("rows", f"digest string, {self.schema}, batch string").join(marks, ["digest", "batch"], "left_semi").drop("batch")

    def put(self, digests: DataFrame, rows: DataFrame) -> None:
        """Keeps rows (digest, ...) of digests, which may have none."""
        batch = uuid.uuid4().hex
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.folder}/rows")
        digests.select("digest").distinct().withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.folder}/done")

    def pruned(self, referenced: DataFrame, folder: str) -> ResultCache:
        """A new cache in another folder with what is referenced (digest) alone; the old one stays as it is."""
        out = ResultCache(self.spark, folder, self.schema)
        kept = self.digests().join(referenced.select("digest").distinct(), "digest", "left_semi")
        out.put(kept, self.rows(kept).select("digest", *[f.name for f in self._table("rows", self.schema).schema]))
        return out


@dataclass(frozen=True)
class Refresh:
    """results: rows of all components, with component. components: (component, digest, recomputed). counts: one row of what was done."""

    results: DataFrame
    components: DataFrame
    counts: DataFrame


def refresh(members: DataFrame, revisions: DataFrame, cache: ResultCache, compute: Callable[[DataFrame], DataFrame], parameters: str = "") -> Refresh:
    """Results of all components of members (document_id, component).

    compute gets the members of the components whose digest is not kept, and returns rows (component, ...) for them; it must not look at
    other documents, and may return none. The digest is over the component's documents, their revisions
    (document_id, revision) and parameters, so a result is read again after other changes, after a
    change that was taken back, and wherever the same documents meet. counts has the documents, components, cache hits,
    rebuilt components, and documents read again.
    """
    digests = ic.component_digests(members, revisions).select("component", F.sha2(F.concat_ws("\x1f", "digest", F.lit(parameters)), 256).alias("digest"))
    kept = cache.digests().select("digest", F.lit(True).alias("_kept"))
    components = materialize(digests.join(kept, "digest", "left").select("component", "digest", F.col("_kept").isNull().alias("recomputed")), "components")
    new = components.filter("recomputed")
    todo = members.join(new.select("component"), "component", "left_semi")
    made = compute(todo).join(new.select("component", "digest"), "component").drop("component")
    names = [f.strip().split()[0] for f in cache.schema.split(", ")]
    cache.put(new, made.select("digest", *names))
    results = components.select("component", "digest").join(cache.rows(components), "digest").select("component", *names)
    size = members.join(components, "component").agg(F.count("*").alias("documents"), F.count_if("recomputed").alias("read_documents"))
    counts = components.agg(F.count("*").alias("components"), F.count_if(~F.col("recomputed")).alias("cache_hits"), F.count_if("recomputed").alias("rebuilt_components")).crossJoin(size)  # one row each
    return Refresh(results, components, materialize(counts, "counts"))


WITNESSES = "rule string, subject string, endpoint string, chain array<string>, support long, population long"


def refresh_witnesses(rows: DataFrame, cells: DataFrame, primary: DataFrame, revisions: DataFrame, cache: ResultCache, quasi: tuple[str, ...] = (), max_support: int = 2, anchors: DataFrame | None = None) -> Refresh:
    """Witnesses of assertions `rows` by dependency component, worked out for changed components alone.

    cells and primary, with anchors, say which documents depend on each other (incremental.dependency_edges); revisions (document_id,
    revision) are all documents. Components share no entity and no cohort, so their witnesses
    are those of a full run. A cache holds WITNESSES.
    """
    edges = ic.dependency_edges(cells, primary, anchors)
    members = materialize(ic.dependency_components(revisions, edges), "members")

    def compute(todo: DataFrame) -> DataFrame:
        # facts keep their component, so that a witness need not be joined with that of its subject
        own = rows.join(todo, "document_id")
        return ev.witnesses(ev.evidence(own, written=True, part=("component",)), quasi, max_support, part=("component",))

    return refresh(members, revisions, cache, compute, f"{sorted(quasi)} {max_support}")
