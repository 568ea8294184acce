"""Text forms: FASTQ records, segment names, SAM tag text, and numbers in reports."""

from __future__ import annotations

import shlex
import struct

from pyspark.sql import Column, functions as F


def segment_name(name: Column, idx: Column, total: Column) -> Column:
    """The name with _segment_{idx + 1} before its first space or tab, if a read gave several segments."""
    head = F.regexp_extract(name, "^([^ \t]*)", 1)
    rest = F.substring(name, F.length(head) + 1, F.length(name))
    return F.when(total > 1, F.concat(head, F.lit("_segment_"), (idx + 1).cast("string"), rest)).otherwise(name)


def bam_segment_name(name: Column, idx: Column, total: Column) -> Column:
    return F.when(total > 1, F.concat(name, F.lit("_segment_"), (idx + 1).cast("string"))).otherwise(name)


def fastq_record(head: Column, seq: Column, qual: Column, tags: Column | None = None) -> Column:
    """The four lines of a record, without the last line end."""
    parts = [F.lit("@"), head, *([] if tags is None else [tags]), F.lit("\n"), seq, F.lit("\n+\n"), qual]
    return F.concat(*parts)


def float_text(x: float) -> str:
    """The shortest decimal text that reads back as the same 32-bit float, without an exponent."""
    import numpy as np

    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    return np.format_float_positional(np.float32(x), unique=True, trim="-")


def tag_text(tag: str, kind: str, value) -> str:
    """A SAM tag as text; all integers print as i, kind 'B:x' is an array of subtype x."""
    if kind[0] == "B":
        sub, value = kind[2], value.tolist() if hasattr(value, "tolist") else value
        return f"{tag}:B:{sub}" + "".join("," + (float_text(v) if sub == "f" else str(v)) for v in value)
    if kind in "cCsSiI":
        return f"{tag}:i:{value}"
    if kind == "f":
        return f"{tag}:f:{float_text(value)}"
    return f"{tag}:{kind}:{value}"


def mods_text(mm: str, ml: list[int] | None, mn: int) -> str:
    """The modification block: MM, ML unless it is absent, MN."""
    out = f"MM:Z:{mm}"
    if ml is not None:
        out += "\tML:B:C" + "".join(f",{v}" for v in ml)
    return f"{out}\tMN:i:{mn}"


def as_float32(x: float) -> float:
    return struct.unpack("<f", struct.pack("<f", x))[0]


def _scaled(n: float, units: tuple[str, ...], join: str) -> str:
    k = 0
    while n >= 1000 and k < len(units) - 1:
        n, k = n / 1000, k + 1
    return f"{n:.0f}{join}{units[k]}" if k == 0 or n >= 100 else f"{n:.1f}{join}{units[k]}"


def count_text(n: int) -> str:
    return _scaled(n, ("", "k", "M", "G"), "")


def bytes_text(n: int) -> str:
    return _scaled(n, ("B", "kB", "MB", "GB", "TB"), " ")


def bases_text(n: int) -> str:
    return _scaled(n, ("bp", "kbp", "Mbp", "Gbp", "Tbp"), " ")


def duration_text(seconds: float) -> str:
    if seconds < 60:
        return f"{seconds:.1f}s"
    minutes, s = divmod(int(seconds), 60)
    return f"{minutes}m {s:02d}s" if minutes < 60 else f"{minutes // 60}h {minutes % 60:02d}m {s:02d}s"


def command_text(argv: list[str]) -> str:
    return shlex.join(argv)
