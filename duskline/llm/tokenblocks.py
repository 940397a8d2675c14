"""Token ids of a corpus in ascending doc_id order, in files of patched frame-of-reference blocks.

A file is one value of bytes: a head, the documents in it, an index of block starts, and blocks of 256 ids. A block
subtracts its least id and packs the rest at the width that the 90th percentile needs; the high bits of what is
larger stand in a list of exceptions behind the packed bits. Ids between any two places are read through the
index without the other blocks. Files are rows that Spark writes, so they lie wherever Spark can write.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .textkit import buffers, steps, trim

MAGIC, BLOCK, PERCENTILE = b"PFR1", 256, 0.9
#: Magic, ids, documents, blocks. Before each block: its least id, its width, its exceptions.
HEAD, BLOCK_HEAD = struct.Struct("<4sQII"), 6
#: A file is closed once it has so many ids; text that one step cuts into words; words that a worker remembers.
FILE_IDS, STEP_BYTES, REMEMBERED = 1 << 20, 4 << 20, 1_000_000
FILES = "shard int, seq int, first long, n_ids long, n_docs int, content binary"


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """The place of each block and of the end, and the blocks."""
    n = -(-len(ids) // BLOCK)
    full = np.concatenate([ids.astype(np.uint32), np.repeat(ids[-1:].astype(np.uint32), n * BLOCK - len(ids))]).reshape(n, BLOCK)
    least = full.min(axis=1, initial=2**32 - 1) if n else np.zeros(0, np.uint32)
    rest = full - least[:, None]
    k = int(np.ceil(percentile * BLOCK)) - 1
    width = _widths(np.partition(rest, k, axis=1)[:, k]) if n else np.zeros(0, np.int64)
    block, place = np.nonzero(rest >> np.minimum(width, 31)[:, None].astype(np.uint32) * (width[:, None] < 32) > 0) if n else (np.zeros(0, np.int64),) * 2
    wide = width[block] < 32
    block, place = block[wide], place[wide]
    exceptions = np.bincount(block, minlength=n)
    starts = np.concatenate([[0], np.cumsum(BLOCK_HEAD + BLOCK // 8 * width + 5 * exceptions)]).astype(np.int64)
    out = np.zeros(starts[-1], np.uint8)
    put = lambda at, rows: out.__setitem__(at[:, None] + np.arange(rows.shape[1]), rows)
    put(starts[:-1], np.ascontiguousarray(least.astype("<u4")).view(np.uint8).reshape(n, 4))
    out[starts[:-1] + 4], out[starts[:-1] + 5] = width, exceptions
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        bits = np.unpackbits(rest[of].astype("<u4").view(np.uint8).reshape(len(of), BLOCK, 4), axis=2, count=int(w), bitorder="little")
        put(starts[of] + BLOCK_HEAD, np.packbits(bits.reshape(len(of), -1), axis=1, bitorder="little"))
    rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = starts[block] + BLOCK_HEAD + BLOCK // 8 * width[block]
    out[tail + rank] = place
    high = (rest[block, place] >> width[block].astype(np.uint32)).astype("<u4")
    put(tail + exceptions[block] + 4 * rank, np.ascontiguousarray(high).view(np.uint8).reshape(-1, 4))
    return starts, out.tobytes()


def unpack(starts: np.ndarray, body: np.ndarray) -> np.ndarray:
    """All ids of blocks at these starts in body; the last start is their end."""
    n = len(starts) - 1
    at = starts[:-1]
    take = lambda at, size: body[at[:, None] + np.arange(size)]
    least = np.ascontiguousarray(take(at, 4)).view("<u4").reshape(n)
    width, exceptions = body[at + 4].astype(np.int64), body[at + 5].astype(np.int64)
    out = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        bits = np.zeros((len(of), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(take(at[of] + BLOCK_HEAD, BLOCK // 8 * int(w)), axis=1, bitorder="little").reshape(len(of), BLOCK, int(w))
        out[of] = np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(of), BLOCK)
    block = np.repeat(np.arange(n), exceptions)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = at[block] + BLOCK_HEAD + BLOCK // 8 * width[block]
    place = body[tail + rank]
    high = np.ascontiguousarray(take(tail + exceptions[block] + 4 * rank, 4)).view("<u4").reshape(-1)
    out[block, place] |= high << width[block].astype(np.uint32)
    return (out + least[:, None]).reshape(-1)


def to_file(doc_ids: np.ndarray, missing: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of whole documents: their ids (missing where null), their numbers of token ids, and those."""
    starts, body = pack(ids)
    parts = (doc_ids.astype("<i8"), np.packbits(missing), counts.astype("<u8"), starts.astype("<u8"))
    return HEAD.pack(MAGIC, len(ids), len(counts), len(starts) - 1) + b"".join(x.tobytes() for x in parts) + body


class TokenFile:
    """A file as to_file makes it: doc_ids, missing, counts, and any stretch of its ids."""

    def __init__(self, content: bytes):
        magic, self.n, docs, blocks = HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a file of token blocks")
        at = HEAD.size
        self.doc_ids = np.frombuffer(content, "<i8", docs, at)
        at += 8 * docs
        self.missing = np.unpackbits(np.frombuffer(content, np.uint8, -(-docs // 8), at), count=docs).astype(bool)
        at += -(-docs // 8)
        self.counts = np.frombuffer(content, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self.starts = np.frombuffer(content, "<u8", blocks + 1, at).astype(np.int64)
        self.body = np.frombuffer(content, np.uint8, offset=at + 8 * (blocks + 1))
        if len(self.body) != self.starts[-1] or self.counts.sum() != self.n:
            raise ValueError("a file of token blocks is cut off")

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from start up to end, read from the blocks that hold them alone."""
        end = self.n if end is None else min(end, self.n)
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        return unpack(self.starts[first : last + 1], self.body)[start - first * BLOCK : end - first * BLOCK]


#: Kinds of bytes: white space, letters, digits, other ASCII; a word with any of the last kind is not cut further.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[ord("'"), ord("|")]] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Encoder:
    """Token ids of texts by a tokenizer file.

    Where the file says that white space parts words for good (the normaliser makes each run of it one blank, the
    pattern leaves it out, letters are lowered), each distinct word is encoded once and remembered. Plain ASCII words are
    cut further, where letters, single digits and other signs meet, as that pattern does. Other
    tokenizers get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            self.by_word = self._parts_words(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    @staticmethod
    def _parts_words(spec: dict) -> bool:
        steps = [(x["type"], x.get("pattern"), x.get("content")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        plain = not any(x["lstrip"] or x["rstrip"] or not x["content"].startswith("<|") or not x["content"].isascii() or any(c.isspace() for c in x["content"]) for x in spec.get("added_tokens", []))
        return plain and steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)] and split.get("pattern") == {"Regex": pattern} and split.get("behavior") == "Removed" and bool(split.get("invert")) and spec.get("post_processor") is None

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.size, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _words(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Pieces of all texts, and the number of pieces before each text and in all."""
        data, offsets = buffers(texts)
        kind = _KIND[data]
        held = kind != 0
        new = np.ones(len(data) + 1, bool)  # words begin behind white space and at each text
        np.logical_not(held, out=new[1:])
        new[offsets[:-1]] = True
        before = np.concatenate([np.zeros(1, np.int32), np.cumsum(held, dtype=np.int32)])[offsets]  # bytes kept before each text
        data, kind, new = data[held], kind[held], new[:-1][held]
        starts = np.flatnonzero(new)
        odd = np.maximum.reduceat(kind, starts) == 4 if len(starts) else np.zeros(0, bool)
        plain = np.repeat(~odd, np.diff(np.append(starts, len(data))))
        turn = kind == 2
        turn[1:] |= kind[1:] != kind[:-1]
        begin = np.flatnonzero(new | (plain & turn))
        low = np.where(plain, _LOWER[data], data)
        pieces = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(low)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(low)))
        return pieces.dictionary_encode(), np.searchsorted(begin, before)

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of new words: all are encoded as one text, and cut where a token's place passes a word's."""
        joined = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in words])
        of = np.searchsorted(ends, np.fromiter(chain.from_iterable(joined.offsets), np.int64, 2 * len(joined))[::2], side="right")
        size = np.bincount(of, minlength=len(words))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.first = np.concatenate([self.first, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.flat = np.concatenate([self.flat, np.array(joined.ids, np.uint32)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of them; null texts are empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_word:
            got = [x.ids for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter((i for x in got for i in x), np.uint32), np.array([len(x) for x in got], np.int64)
        pieces, cuts = self._words(texts)
        words = pieces.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self._forget()
        found = np.array(list(map(self.known.get, words, repeat(-1))), np.int32)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = len(self.known) + np.arange(len(new))
            self._learn([words[i] for i in new])
        at = found[pieces.indices.to_numpy()]
        size = self.size[at]
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])  # a step's ids are fewer than its bytes
        ids = self.flat[np.repeat(self.first[at] - total[:-1], size) + np.arange(total[-1], dtype=np.int32)]
        return ids, np.diff(total[cuts]).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker: a file is read once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id behind each text."""
    out = np.empty(len(ids) + len(counts), np.uint32)
    ends = np.cumsum(counts + 1) - 1
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own], out[ends] = ids, end_id
    return out, counts + 1


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, file_ids: int = FILE_IDS, step_bytes: int = STEP_BYTES) -> DataFrame:
    """Files of docs (doc_id, text), written in the shared folder: rows (shard, seq, first, n_ids, n_docs, content).

    Documents are dealt by ranges of doc_id and of a digest of the text, so one id in many rows is many
    tasks; shards and their files in turn are in ascending doc_id order, null ids first, equal ids in the order
    of that digest. tokenizer is the path of a file that every machine has. first is the number of ids before the file in
    its shard. Null and empty texts have the end id alone; a text of any length is in one file, whole. An
    empty table gives no files; other columns are not read.
    """
    ordered = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer).encode, TaskContext.get().partitionId()
        held: list[tuple] = []
        seq = first = n = 0

        def close() -> pa.RecordBatch:
            ids, missing, counts, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            row = (shard, seq, first, len(tokens), len(ids), to_file(ids, missing, counts, tokens))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["shard", "seq", "first", "n_ids", "n_docs", "content"])

        for batch in batches:
            for part in steps(batch, most=step_bytes):
                tokens, counts = with_end(*encode(part.column("text").combine_chunks()), end_id)
                ids = part.column("doc_id").combine_chunks().cast(pa.int64())
                held.append((ids.fill_null(0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), counts, tokens))
                n += len(tokens)
                if n >= file_ids:
                    yield close()
                    seq, first, n = seq + 1, first + n, 0
                    held.clear()
            trim()
        if held:
            yield close()

    return materialize(ordered.mapInArrow(run, FILES), "tokens")


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of files, and with_ids those of each document, in one row for each document.

    start counts the ids of all documents before it, over all files. Where a shard begins is summed over one row for each shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # as many rows as tasks that wrote
    base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                f = TokenFile(batch.column("content")[row].as_buffer().to_pybytes())
                ids = f.ids()
                ends = np.cumsum(f.counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), f.counts.tolist(), strict=True)), np.int64, len(ends))
                out = [pa.array(f.doc_ids, mask=f.missing), pa.array(batch.column("place")[row].as_py() + ends - f.counts), pa.array(f.counts), pa.array(crc)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])
            trim()

    placed = files.join(F.broadcast(base), "shard").select((F.col("base") + F.col("first")).alias("place"), "content")
    return placed.mapInArrow(run, schema)
