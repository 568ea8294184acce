"""Per-segment filters: one CASE in the order short, long, low, high, gc; the first match is the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quality import read_quality, segment_quality
from ..functions.sequence import gc_fraction
from ..plans.model import FilterPlan

REASONS = ("too_short", "too_long", "low_quality", "high_quality", "gc")


def _reason(plan: FilterPlan, n: Column, quality: Column | None, gc: Column | None) -> Column:
    reason = F.when((n == 0) | (n < plan.min_length), "too_short")
    if plan.max_length is not None:
        reason = reason.when(n > plan.max_length, "too_long")
    if quality is not None:
        reason = reason.when(quality < plan.min_quality, "low_quality").when(quality > plan.max_quality, "high_quality")
    if gc is not None:
        reason = reason.when((gc < (plan.min_gc or 0.0)) | (gc > (1.0 if plan.max_gc is None else plan.max_gc)), "gc")
    return reason


def drop_reason(plan: FilterPlan, seq: str = "seq", qual: str = "qual", quality: Column | None = None) -> Column:
    """The reason as text, null for rows that pass. Bounds that are off cost nothing."""
    if plan.needs_quality and quality is None:
        quality = read_quality(F.col(qual), plan.mode)
    return _reason(plan, F.length(seq), quality if plan.needs_quality else None, gc_fraction(F.col(seq)) if plan.needs_gc else None)


def judged(rows: DataFrame, plan: FilterPlan) -> DataFrame:
    """rows with drop_reason. Quality is computed once, and only if a bound needs it."""
    if not plan.needs_quality:
        return rows.withColumn("drop_reason", drop_reason(plan))
    out = rows.withColumn("_q", read_quality(F.col("qual"), plan.mode))
    return out.withColumn("drop_reason", drop_reason(plan, quality=F.col("_q"))).drop("_q")


def with_reasons(trimmed: DataFrame, plan: FilterPlan) -> DataFrame:
    """Reads (seq, qual, segs) with `reasons`, the drop reason of each segment in order, null where it passes."""
    rows = trimmed.withColumn("_q", segment_quality(F.col("qual"), F.col("segs"), plan.mode)) if plan.needs_quality else trimmed

    def reason(g: Column, i: Column) -> Column:
        n = g["e"] - g["s"]
        gc = gc_fraction(F.substring(F.col("seq"), g["s"] + 1, n)) if plan.needs_gc else None
        return _reason(plan, n, F.get("_q", i) if plan.needs_quality else None, gc)

    return rows.withColumn("reasons", F.transform("segs", reason)).drop("_q")
