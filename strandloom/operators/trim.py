"""Crops, quality operators and their composition with adapter segments.

Segments are arrays of (s, e), zero-based and half open in the original read. Fixed crops are
Catalyst arithmetic; quality operators run over Arrow batches, since a fold over a hundred
thousand bases in the JVM's interpreted lambdas is slower by an order of magnitude."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quality import PROBABILITY, flat, phreds
from ..plans.model import QualityOp, TrimPlan

SEGMENTS = "array<struct<s:int,e:int>>"
_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def crop_window(n: Column, head: int, tail: int) -> Column:
    """One segment, or none if nothing is left."""
    s = F.least(F.lit(head), n)
    e = F.greatest(F.greatest(n - tail, F.lit(0)), s)
    segment = F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e")))
    return F.when(s < e, segment).otherwise(F.array().cast(SEGMENTS))


def end_trim(q: np.ndarray, cutoff: int) -> list[tuple[int, int]]:
    good = np.flatnonzero(q >= cutoff)
    return [(int(good[0]), int(good[-1]) + 1)] if len(good) else []


def best_segment(q: np.ndarray, cutoff: int) -> list[tuple[int, int]]:
    """Maximum-sum segment of p(cutoff) - p(q), the longer one of equal sums (modified Mott)."""
    gain = (PROBABILITY[cutoff] - PROBABILITY)[q].tolist()
    current, start, best, found, length = -1.0, 0, 0.0, None, 0
    for i, g in enumerate(gain):
        if current < 0:
            if g < 0:
                continue  # a start here ends here, and can't be the best
            current, start = 0.0, i
        current += g
        if current > best or (current == best and i - start + 1 > length):
            best, found, length = current, (start, i + 1), i - start + 1
    return [found] if found else []


def split_bounds(q: np.ndarray, cutoff: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of good bases, joined over fewer than `window` bad ones."""
    good = np.flatnonzero(q >= cutoff)
    if not len(good):
        return good, good
    cut = np.flatnonzero(np.diff(good) > max(window, 1))
    return good[np.concatenate([[0], cut + 1])], good[np.concatenate([cut, [len(good) - 1]])] + 1


def quality_split(q: np.ndarray, cutoff: int, window: int) -> list[tuple[int, int]]:
    s, e = split_bounds(q, cutoff, window)
    return list(zip(s.tolist(), e.tolist(), strict=True))


def run_quality(q: np.ndarray, op: QualityOp) -> list[tuple[int, int]]:
    if op.kind == "trim":
        return end_trim(q, op.cutoff)
    return best_segment(q, op.cutoff) if op.kind == "best" else quality_split(q, op.cutoff, op.window)


def _bounds(q: np.ndarray, op: QualityOp) -> tuple[np.ndarray, np.ndarray]:
    if op.kind == "split":
        return split_bounds(q, op.cutoff, op.window)
    found = np.array(run_quality(q, op), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def quality_within(qual: Column, segments: Column, op: QualityOp) -> Column:
    """The quality operator inside each segment, in coordinates of the read."""

    @F.arrow_udf(SEGMENTS)
    def within(qual: pa.Array, segments: pa.Array) -> pa.Array:
        # bounds stay NumPy arrays: a read may have hundreds
        raw, offsets = flat(qual)
        starts, ends, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [0]
        for at, segs in zip(offsets[:-1].tolist(), segments, strict=True):
            n = 0
            for g in segs.as_py() or ():
                s, e = _bounds(phreds(raw[at + g["s"] : at + g["e"]]), op)
                starts.append((s + g["s"]).astype(np.int32))
                ends.append((e + g["s"]).astype(np.int32))
                n += len(s)
            counts.append(n)
        found = pa.StructArray.from_arrays([pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], fields=list(_ARROW.value_type))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), found)

    return within(qual, segments)


def segments(reads: DataFrame, plan: TrimPlan, adapter_segments=None) -> DataFrame:
    """reads with `segs`: crop, then adapter segments of the window, then the quality operator.

    adapter_segments: a function from (seq, window) columns to segments within the window."""
    segs = crop_window(F.length("seq"), plan.head, plan.tail)
    out = reads.withColumn("segs", segs)
    if adapter_segments is not None:
        out = out.withColumn("segs", adapter_segments(F.col("seq"), F.col("segs")))
    if plan.quality:
        out = out.withColumn("segs", quality_within(F.col("qual"), F.col("segs"), plan.quality))
    return out


def exploded(trimmed: DataFrame) -> DataFrame:
    """A row per segment: the read's columns (seq, qual cut), idx, total, s, e. idx counts produced segments."""
    # an inner explode would filter by the size of segs first and so compute them twice
    rows = trimmed.select("*", F.size("segs").alias("total"), F.posexplode_outer("segs").alias("idx", "seg")).where("idx is not null")
    s, e = F.col("seg.s"), F.col("seg.e")
    cut = lambda c: F.substring(c, s + 1, e - s)
    kept = [c for c in trimmed.columns if c not in ("seq", "qual", "segs")]
    return rows.select(*kept, cut(F.col("seq")).alias("seq"), cut(F.col("qual")).alias("qual"), "idx", "total", s.alias("s"), e.alias("e"))
