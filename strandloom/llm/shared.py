"""Tables in the folder that all executors share, and sizes for partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..sources.shared import shared_dir, written

__all__ = ["block_count", "checkpointed", "estimated_bytes", "shared_dir", "written"]


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df; exact file sizes for scans. Only for choosing partition counts."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def block_count(df: DataFrame, least: int = 64, most: int = 1 << 19) -> int:
    """How many buckets to deal a corpus into: each grows with the square root of the corpus.

    Rows exchanged between chunks and buckets are at most chunks x buckets, so letting both
    grow keeps that product in proportion to the corpus."""
    size = max(1, min(estimated_bytes(df), 1 << 54))
    width = min(max(math.sqrt(size * 16384), 1 << 20), 1 << 27)
    return int(min(max(least, math.ceil(size / width)), most))
