"""Plan parameters and their validation. A plan error is a ValueError before any job starts."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

QUALITY_MODES = ("mean", "arith", "median")
QUALITY_OPS = ("trim", "best", "split")


@dataclass(frozen=True)
class QualityOp:
    """One of end trimming, best segment and splitting at a Phred cutoff."""

    kind: str
    cutoff: int
    window: int = 1

    def __post_init__(self):
        if self.kind not in QUALITY_OPS:
            raise ValueError(f"unknown quality operator {self.kind!r}")
        if not 0 <= self.cutoff <= 255:
            raise ValueError("the quality cutoff must be within 0..255")


@dataclass(frozen=True)
class TrimPlan:
    head: int = 0
    tail: int = 0
    quality: QualityOp | None = None

    def __post_init__(self):
        if self.head < 0 or self.tail < 0:
            raise ValueError("head and tail crops can't be negative")

    @classmethod
    def of(cls, head: int = 0, tail: int = 0, qual_trim: int | None = None, qual_best_segment: int | None = None, qual_split: int | None = None, qual_split_window: int = 1) -> TrimPlan:
        """From separate options, of which at most one quality operator may be set."""
        chosen = [(k, v) for k, v in zip(QUALITY_OPS, (qual_trim, qual_best_segment, qual_split), strict=True) if v is not None]
        if len(chosen) > 1:
            raise ValueError("quality trimming, best segment and splitting exclude each other")
        return cls(head, tail, QualityOp(chosen[0][0], chosen[0][1], max(qual_split_window, 1)) if chosen else None)

    @property
    def identity(self) -> bool:
        return not (self.head or self.tail or self.quality)


@dataclass(frozen=True)
class FilterPlan:
    min_length: int = 1
    max_length: int | None = None
    min_quality: float = 0.0
    max_quality: float = 1000.0
    min_gc: float | None = None
    max_gc: float | None = None
    mode: str = "mean"

    def __post_init__(self):
        if self.mode not in QUALITY_MODES:
            raise ValueError(f"unknown quality mode {self.mode!r}")
        if any(x is not None and math.isnan(x) for x in (self.min_quality, self.max_quality, self.min_gc, self.max_gc)):
            raise ValueError("a bound is not a number")
        if self.max_length is not None and self.min_length > self.max_length:
            raise ValueError("the length bounds cross")
        if self.min_quality > self.max_quality:
            raise ValueError("the quality bounds cross")
        low, high = self.min_gc or 0.0, 1.0 if self.max_gc is None else self.max_gc
        if not 0 <= low <= 1 or not 0 <= high <= 1 or low > high:
            raise ValueError("GC bounds must be ordered and within 0..1")

    @property
    def needs_quality(self) -> bool:
        return self.min_quality > 0 or self.max_quality < 1000

    @property
    def needs_gc(self) -> bool:
        return self.min_gc is not None or self.max_gc is not None


@dataclass(frozen=True)
class AdapterPlan:
    adapters: tuple = ()
    error_rate: float = 0.2
    end_size: int = 150
    split: bool = True

    def __post_init__(self):
        if not 0 <= self.error_rate < 1:
            raise ValueError("the adapter error rate must be within 0..1")
        if self.end_size < 1:
            raise ValueError("the adapter end size must be positive")


@dataclass(frozen=True)
class Plan:
    """A whole run: crop, adapters, quality operator, filters, tag rules."""

    trim: TrimPlan = field(default_factory=TrimPlan)
    filters: FilterPlan = field(default_factory=FilterPlan)
    adapters: AdapterPlan | None = None
    update_moves: bool = False
    fastq_tags: str = "all"
    sample: int = 0

    def __post_init__(self):
        if self.sample and self.sample < 100:
            raise ValueError("the adapter sample must be 0 or at least 100 reads")
        selected_tags(self.fastq_tags)


def compression_level(level: int | None, gzip_fastq: bool) -> int:
    """The level given, or 4 for gzip FASTQ and 6 otherwise."""
    if level is None:
        return 4 if gzip_fastq else 6
    if not 0 <= level <= 9:
        raise ValueError("the compression level must be within 0..9")
    return level


def selected_tags(text: str) -> tuple[str, frozenset]:
    """('all' | 'none' | 'list', tags) from a tag selection."""
    if text in ("all", "none"):
        return text, frozenset()
    tags = [t.strip() for t in text.split(",")]
    if any(len(t) != 2 or not t.isascii() or not t.isalnum() for t in tags):
        raise ValueError("tags are 'all', 'none' or a list of two letters or digits each")
    return "list", frozenset(tags)
