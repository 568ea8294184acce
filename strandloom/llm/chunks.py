"""Corpus-wide counting by chunks and buckets.

A chunk is a row that holds a few MB of whole documents. For a statistic over all documents, a
chunk sends each bucket of the hash range its distinct keys in sorted order with their counts,
as one row; a bucket adds up the counts of equal keys and answers each chunk in the order of
its own keys. A key that fills a third of the corpus is one entry per chunk, so no bucket is
larger than the others, and keys travel as deltas of three or four bytes.

Chunks and buckets both grow with the square root of the corpus, so the rows between them grow
in proportion to it. The chunk table is written to the shared folder once; a lost executor's
part is read again from there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .shared import block_count, estimated_bytes, written
from .textops import as_bytes

_KINDS = {1: np.dtype("u1"), 4: np.dtype("<u4"), 8: np.dtype("<u8")}
CHUNK_SCHEMA = "chunk bigint, ids array<bigint>, flags array<boolean>, sizes binary, body binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes of the narrowest width."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 4 if top < 1 << 32 else 8
    planes = np.ascontiguousarray(values.astype(_KINDS[width])).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(_KINDS[width]).ravel().astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def chunk_bytes(docs: DataFrame) -> int:
    return int(min(max(math.sqrt(min(estimated_bytes(docs), 1 << 54) * 16384), 1 << 20), 1 << 26))


def chunk_table(docs: DataFrame, flag: Column | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Whole documents in chunks, in the shared folder; a null text is an empty one. flag: a boolean kept per document."""
    most = chunk_bytes(docs)

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, flags, sizes, texts, held = [], [], [], [], 0

        def row():
            return pa.RecordBatch.from_pydict({
                "chunk": [(task << 32) + number], "ids": pa.array([ids], pa.list_(pa.int64())), "flags": pa.array([flags], pa.list_(pa.bool_())),
                "sizes": [np.array(sizes, "<i8").tobytes()], "body": [zstandard.ZstdCompressor(level=1).compress(b"".join(texts))],
            })

        for batch in batches:
            for i, f, t in zip(batch.column("doc_id").to_pylist(), batch.column("flag").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if held and held + len(t) > most:
                    yield row()
                    ids, flags, sizes, texts, held, number = [], [], [], [], 0, number + 1
                ids.append(i)
                flags.append(f)
                sizes.append(len(t))
                texts.append(t)
                held += len(t)
        if ids:
            yield row()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (F.lit(True) if flag is None else flag).alias("flag"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(run, CHUNK_SCHEMA), "chunks")


class Chunk:
    """A row of the chunk table, read."""

    def __init__(self, row: dict):
        self.chunk, self.ids, self.flags = row["chunk"], row["ids"], np.array(row["flags"], bool)
        sizes = np.frombuffer(row["sizes"], "<i8")
        body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(int(sizes.sum()), 1))
        ends = np.cumsum(sizes)
        self.texts = [body[a:b] for a, b in zip(ends - sizes, ends, strict=True)]


def ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of each bucket's slice of sorted 64-bit keys; a bucket is an equal range of the hash."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def slices(keys: np.ndarray, buckets: int):
    """bucket, start, end of the buckets that have keys."""
    bounds = ranges(keys, buckets)
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), int(bounds[b]), int(bounds[b + 1])


def answered(chunks: DataFrame, answers: DataFrame, columns: list[str]) -> DataFrame:
    """chunks with the answers to each of them, as an array of structs in order of `columns`."""
    listed = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("answers"))
    return chunks.join(listed.hint("merge"), "chunk", "left")


def buckets_for(docs: DataFrame) -> int:
    return block_count(docs)
