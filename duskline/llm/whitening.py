"""Embedding whitening by TSQR: QR of each partition's centred rows, a tree of merges of R factors, SVD of the last R.

No covariance is formed for the fit: the right singular vectors of R are the eigenvectors of the covariance, and
its singular values squared over n the eigenvalues. What a task holds is a slice of rows and one
triangle of dimension x dimension numbers, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .textkit import one_thread

#: Components returned, R factors that one merge takes, rows in one step of numpy.
COMPONENTS, FAN_IN, STEP = 8, 16, 8192
#: An eigenvalue below so many times the largest is zero in double precision: its direction is noise.
NOTHING = 1e-20


def usable(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """Rows whose vector has the most common length (of several the greatest), and that length; 0 where there is none.
    Entries are looked at where they are read, in _steps."""
    rows = vectors.filter(F.size(column) > 0)
    top = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size(column) == (top["d"] if top else 0)), top["d"] if top else 0


def _steps(batch: pa.RecordBatch, d: int, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch without the rows that hold null or non-finite entries, and their vectors as longs
    x = floor(1024 c) + 100000, held at 2**49 beyond it."""
    for at in range(0, len(batch), STEP):
        part = batch.slice(at, STEP)
        c = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        whole = np.isfinite(c).all(axis=1)
        if not whole.all():
            part, c = part.filter(pa.array(whole)), c[whole]
        if len(c):
            yield part, np.floor(np.clip(c * 1024, -(2.0**49), 2.0**49)).astype(np.int64) + 100_000


def sums(rows: DataFrame, d: int, column: str) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension: by task, then of all tasks as decimals that do not overflow."""

    def run(batches):
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            for _, x in _steps(batch, d, column):
                n, total = n + len(x), total + x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, d), pa.int32()), "s": pa.array([str(v) for v in (n, *total)])})

    parts = rows.select(column).mapInArrow(run, "dim int, s string")
    got = dict(parts.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    return int(got.get(-1, 0)), [int(got.get(i, 0)) for i in range(d)]


def centred(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - S/n with one rounding, from n x - S, which is exact; that as well, where longs hold it."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        exact = n * x - np.array(total, np.int64)
        return exact / n, exact
    exact = n * x.astype(object) - np.array(total, object)
    return (exact / n).astype(np.float64), exact


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    """The R factor of blocks on top of one another, square and with a diagonal that is not negative."""
    r = np.linalg.qr(np.concatenate(blocks), mode="r")
    d = r.shape[1]
    if len(r) < d:
        r = np.concatenate([r, np.zeros((d - len(r), d))])
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def r_factor(rows: DataFrame, n: int, total: list[int], column: str, fan_in: int = FAN_IN) -> np.ndarray:
    """R of all centred rows: one QR after another inside each partition, then merges of fan_in factors a level.

    The factors of a level are written in the shared folder, so a lost executor costs its tasks only. The driver gets the last R.
    """
    d = len(total)

    def local(batches):
        one_thread()
        r = None
        for batch in batches:
            for _, x in _steps(batch, d, column):
                r = triangle([centred(x, n, total)[0]] if r is None else [r, centred(x, n, total)[0]])
        if r is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def merged(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        blocks = [np.frombuffer(b, np.float64).reshape(d, d) for b in t.sort_values("node")["r"]]
        return pd.DataFrame({"node": [key[0]], "r": [triangle(blocks).tobytes()]})

    level = materialize(rows.select(column).mapInArrow(local, "node long, r binary"), "factors")
    while (top := level.agg(F.max("node")).first()[0]) is not None and top > 0:
        up = materialize(level.groupBy(F.expr(f"node DIV {fan_in}").alias("up")).applyInPandas(merged, "node long, r binary"), "factors")
        discard(level)
        level = up
    last = level.first()
    discard(level)
    return np.frombuffer(last["r"], np.float64).reshape(d, d)


def fit(rows: DataFrame, n: int, total: list[int], column: str, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, their unit eigenvectors as columns, and shares of the trace, by falling eigenvalue."""
    _, s, vt = np.linalg.svd(r_factor(rows, n, total, column))
    e = s**2 / n
    trace = e.sum()
    k = min(components, len(e))
    return e[:k], vt[:k].T, e[:k] / trace if trace else np.full(k, np.nan)


def identity_error(rows: DataFrame, n: int, total: list[int], axes: np.ndarray, column: str) -> float:
    """Largest absolute entry of the whitened rows' covariance, over all rows, less the identity."""
    d, k = axes.shape

    def run(batches):
        one_thread()
        out = np.zeros((k, k))
        for batch in batches:
            for _, x in _steps(batch, d, column):
                z = centred(x, n, total)[0] @ axes
                out += z.T @ z
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(k * k), pa.int32()), "s": pa.array(out.ravel(), pa.float64())})

    got = rows.select(column).mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    cov = np.zeros(k * k)
    for r in got:
        cov[r["i"]] = r["s"] / n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error): one for each usable row of vectors
    (vec_id, embedding) and each of the first components.

    Null vectors, empty ones, and those with null or non-finite entries are left out, and so are vectors of
    another length than the most common one. Null ids and repeated rows are rows of their own and
    count in the fit; order is that of no row. Equal eigenvalues share their plane in any turn. A component whose
    eigenvalue is zero in double precision (fewer rows or distinct rows than dimensions) is numbered, and its
    whitened is null; it is left out of identity_error, which is null where no component is left. Other columns are not
    read. An empty table gives no rows. A deviation beyond a long is an error.
    """
    spark, schema = vectors.sparkSession, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = usable(vectors.select("vec_id", column), column)
    n, total = sums(rows, d, column) if d else (0, [])
    if not n:
        return spark.createDataFrame([], schema)
    e, v, explained = fit(rows, n, total, column, components)
    live = e > NOTHING * max(e[0], 1e-300)
    axes = v[:, live] / np.sqrt(e[live])
    error = identity_error(rows, n, total, axes, column) if live.any() else None
    k = len(e)

    def run(batches):
        one_thread()
        for batch in batches:
            for part, x in _steps(batch, d, column):
                c, exact = centred(x, n, total)
                if (exact.astype(np.float64) ** 2).sum(axis=1).max() > 2**62.9:
                    exact = exact.astype(object)  # below that, longs that wrap on the way come out right
                deviation = np.repeat(np.asarray((exact**2).sum(axis=1)), k)
                z = np.full((len(x), k), np.nan)
                z[:, live] = c @ axes
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n)),
                    pa.array(deviation.tolist() if deviation.dtype == object else deviation, pa.int64()),
                    pa.array(z.ravel(), from_pandas=True),
                    pa.array(np.tile(explained, len(x)), from_pandas=True),
                    pa.array([error] * (len(x) * k), pa.float64()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
