"""Words, shingles and hashes of whole Arrow batches of texts in numpy, without a step for each text."""

from __future__ import annotations

import ctypes
import glob
import os
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U = np.uint64
_LIBC = ctypes.CDLL(None) if sys.platform == "linux" else None
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: Odd multipliers of the rolling hashes.
MUL, MUL2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Bytes and rows of text that one numpy step works on: bound a worker's memory, whatever the batch.
STEP_BYTES, STEP_ROWS = 1 << 20, 2000


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes, so that all bits depend on all bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets into them; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of all texts of an array: start and end bytes, 64-bit hash and the text of each."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = texts.cast(pa.large_string()).fill_null("")
        # a blank after each text, and one before the first, keep their words apart
        data, offsets = buffers(pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())))
        n = len(offsets) - 1
        body = np.empty(len(data) + 1, np.uint8)
        body[0], body[1:] = 32, _LOWER[data] if lower else data
        self.offsets = offsets - np.arange(n + 1)
        blank = _SPACE[body]
        edge = np.flatnonzero(blank[:-1] != blank[1:]) + 1
        self.body, self.start, self.end = body, edge[0::2], edge[1::2]
        self.doc_start = offsets[:-1] + 1  # first byte of each text in body
        self.doc = np.searchsorted(self.doc_start, self.start, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=n) if n else np.zeros(0, np.int64)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U)
        # sums of byte * MUL ** position over each word, divided by the power of its start by the inverse
        size = len(self.body)
        powers = power_table(size)
        sums = np.cumsum((self.body.astype(U) + U(1)) * powers[:size])
        raw = (sums[self.end - 1] - sums[self.start - 1]) * inverse_table(size)[self.start]
        return mix(raw ^ ((self.end - self.start).astype(U) * MUL2))

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of each run of k words; a text of fewer words has its whole sequence as one."""
        n_words = self.counts
        first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
        per = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
        doc = np.repeat(np.arange(len(n_words)), per)
        at = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
        width = np.minimum(n_words, k)[doc]
        h = width.astype(U) * MUL
        for i in range(k):
            inside = i < width
            step = self.hash[np.minimum(at + i, len(self.hash) - 1)] if len(self.hash) else h
            h = np.where(inside, mix(h * MUL2 + step), h)
        return h, doc


_POWERS: dict[str, np.ndarray] = {}


def power_table(n: int) -> np.ndarray:
    return _table("p", n, MUL)


def inverse_table(n: int) -> np.ndarray:
    return _table("i", n, U(pow(int(MUL), -1, 1 << 64)))


def _table(key: str, n: int, base: np.uint64) -> np.ndarray:
    found = _POWERS.get(key)
    if found is None or len(found) < n:
        out = np.full(max(n, 1 << 20), base, U)
        out[0] = 1
        found = _POWERS[key] = np.cumprod(out)
    return found


def steps(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.Table]:
    """Cuts a batch into slices of about `most` bytes of text and STEP_ROWS rows at most; a longer text is a slice of its own."""
    t = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    sizes = np.asarray(pc.binary_length(t.column(column).cast(pa.large_string())).fill_null(0).to_numpy(), np.int64)
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        low = ends[at - 1] if at else 0
        to = max(at + 1, min(at + STEP_ROWS, int(np.searchsorted(ends, low + most, side="right"))))
        yield t.slice(at, to - at)
        at = to


def one_thread() -> None:
    """Keeps numpy's matrix products in this worker on one thread: small products on more only wait for each other."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__) + ".libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)


def trim() -> None:
    """Gives freed memory back to the system: workers live on between tasks, and share a machine's limit."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def trimmed(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A group function that leaves no freed memory behind."""

    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        trim()
        return out

    return run


def map_texts(df: DataFrame, f: Callable[[pa.Table], Iterator[pa.Table] | pa.Table | None], schema, column: str = "text") -> DataFrame:
    """mapInArrow over bounded slices of each partition."""

    def run(batches):
        one_thread()
        for batch in batches:
            for part in steps(batch, column):
                out = f(part)
                for t in [out] if isinstance(out, pa.Table) else out or ():
                    yield from t.to_batches()
            trim()

    return df.mapInArrow(run, schema)


def distinct_pairs(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (doc, hash); doc is ascending already."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]


def pack(a: np.ndarray) -> bytes:
    """An array as byte planes, high bytes together: what is small or sorted compresses well."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    n = len(b) // size
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, n).T).view(dtype).reshape(n) if n else np.zeros(0, dtype)


def crc_of(ids: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """crc32 of each id as text; of a null id, of the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) for x in ids.to_pylist()], np.int64)
