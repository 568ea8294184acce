"""Phred arithmetic and read summaries over quality text (Phred + 33).

Summaries are Arrow functions over whole batches: one lookup and one segmented sum, with no
per-base JVM rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

PROBABILITY = 10.0 ** (-np.arange(256) / 10.0)


def phred_to_prob(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(raw) else raw, offsets - offsets[0]


def phreds(raw: np.ndarray) -> np.ndarray:
    return np.maximum(raw.astype(np.int16) - 33, 0)


def _means(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = np.diff(offsets)
    out = np.zeros(len(n))
    full = n > 0
    if full.any():
        sums = np.add.reduceat(values, offsets[:-1][full])
        out[full] = sums / n[full]
    return out


@F.arrow_udf(T.DoubleType())
def mean_prob_q(qual: pa.Array) -> pa.Array:
    """Phred of the mean error probability; 0 for an empty read."""
    raw, offsets = flat(qual)
    mean = _means(PROBABILITY[phreds(raw)], offsets)
    return pa.array(np.where(mean > 0, -10 * np.log10(np.where(mean > 0, mean, 1.0)), 0.0) + 0.0)


@F.arrow_udf(T.DoubleType())
def mean_arith_q(qual: pa.Array) -> pa.Array:
    raw, offsets = flat(qual)
    return pa.array(_means(phreds(raw).astype(np.float64), offsets))


@F.arrow_udf(T.DoubleType())
def median_q(qual: pa.Array) -> pa.Array:
    raw, offsets = flat(qual)
    q = phreds(raw)
    return pa.array([float(np.median(q[a:b])) if b > a else 0.0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.float64())


def read_quality(qual: Column, mode: str = "mean") -> Column:
    return {"mean": mean_prob_q, "arith": mean_arith_q, "median": median_q}[mode](qual)


def segment_quality(qual: Column, segs: Column, mode: str = "mean") -> Column:
    """The quality of each segment (s, e) of a read, as an array."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def within(qual: pa.Array, segs: pa.Array) -> pa.Array:
        raw, offsets = flat(qual)
        q, out = phreds(raw), []
        for at, found in zip(offsets[:-1].tolist(), segs.to_pylist(), strict=True):
            out.append([_summary(q[at + g["s"] : at + g["e"]], mode) for g in found or ()])
        return pa.array(out, pa.list_(pa.float64()))

    return within(qual, segs)


def _summary(q: np.ndarray, mode: str) -> float:
    if not len(q):
        return 0.0
    if mode == "median":
        return float(np.median(q))
    # sums by reduceat, as for whole reads
    if mode == "arith":
        return float(np.add.reduceat(q.astype(np.float64), [0])[0] / len(q))
    return float(-10 * np.log10(np.add.reduceat(PROBABILITY[q], [0])[0] / len(q)) + 0.0)
