"""Whole runs: scan, crop, adapters, quality operator, filters, names and tags. No stage shuffles reads."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.quality import flat, phreds
from ..functions.text import bam_segment_name, fastq_record, segment_name
from ..operators import counters, filters, tags as tag_rules, trim
from ..operators.adapters import adapter_segments
from ..sources.ubam import TAG, pieces, tag_column, tag_rows
from .model import Plan, selected_tags


def trimmed(reads: DataFrame, plan: Plan) -> DataFrame:
    return trim.segments(reads, plan.trim, adapter_segments(plan.adapters) if plan.adapters else None)


def segments(reads: DataFrame, plan: Plan) -> DataFrame:
    """A judged row per segment of FASTQ reads."""
    return filters.judged(trim.exploded(trimmed(reads, plan)), plan.filters)


def fastq_records(reads: DataFrame, plan: Plan) -> DataFrame:
    """name, seq, qual of reads to a column of FASTQ records that pass."""
    rows = segments(reads, plan).where("drop_reason is null")
    return rows.select(fastq_record(segment_name(F.col("name"), F.col("idx"), F.col("total")), F.col("seq"), F.col("qual")).alias("record"))


def rewritten(rows, update_moves: bool, selection: tuple | None) -> pa.Array:
    """The tags of segments (tags, name, seq, qualities, s, e, total), or their blocks of a FASTQ header."""
    if selection is None:
        return tag_column([tag_rules.rewrite(*r, update_moves) for r in rows])
    return pa.array([tag_rules.fastq_tags(*r, selection) for r in rows], pa.string())


def retagged(rows: DataFrame, update_moves: bool = False, selection: tuple | None = None) -> DataFrame:
    """Segments (name, tags, s, e, total, and _seq and _qual of the whole read) with their tags rewritten in `out`.

    With a selection, out is the tag block of a FASTQ header instead. The other columns stay."""
    kept = [c for c in rows.columns if c not in ("_seq", "_qual", "tags")]

    def run(batches):
        for batch in pieces(batches):
            raw, offsets = flat(batch.column("_qual"))
            quals, (name, seq, s, e, total) = phreds(raw), (batch.column(c).to_pylist() for c in ("name", "_seq", "s", "e", "total"))
            whole = zip(tag_rows(batch.column("tags")), name, seq, (quals[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), s, e, total, strict=True)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {"out": rewritten(whole, update_moves, selection)})

    kinds = rows.select(*kept).schema.add("out", T.DataType.fromDDL(f"array<{TAG}>" if selection is None else "string"))
    return rows.mapInArrow(run, kinds)


def _tagged(reads: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """name, flags, seq, qual, idx, total, out of the segments that pass.

    A read goes to Python once, with all its segments, since a row per segment would repeat its tags."""
    rows = filters.with_reasons(trimmed(reads.select("name", "flags", "seq", "qual", "tags"), plan), plan.filters)
    selection, update_moves = None if kind == "bam" else selected_tags(plan.fastq_tags), plan.update_moves

    def run(batches):
        for batch in pieces(batches):
            raw, offsets = flat(batch.column("qual"))
            quals, offsets, tags = phreds(raw), offsets.tolist(), tag_rows(batch.column("tags"))
            segs, edges = batch.column("segs"), batch.column("segs").offsets.to_pylist()
            s, e = (c.to_pylist() for c in segs.values.slice(edges[0], edges[-1] - edges[0]).flatten())
            reasons = batch.column("reasons").to_pylist()
            kept = [(r, i, edges[r + 1] - edges[r], s[at], e[at]) for r, found in enumerate(reasons) for i, at in enumerate(range(edges[r] - edges[0], edges[r + 1] - edges[0])) if found[i] is None]
            name, seq, qual = (batch.column(c).to_pylist() for c in ("name", "seq", "qual"))
            whole = ((tags[r], name[r], seq[r], quals[offsets[r] : offsets[r + 1]], a, b, total) for r, _, total, a, b in kept)
            places = pa.array([r for r, *_ in kept], pa.int32())
            yield pa.RecordBatch.from_pydict({
                "name": batch.column("name").take(places), "flags": batch.column("flags").take(places), "seq": pa.array([seq[r][a:b] for r, _, _, a, b in kept], pa.string()), "qual": pa.array([qual[r][a:b] for r, _, _, a, b in kept], pa.string()),
                "idx": pa.array([i for _, i, *_ in kept], pa.int32()), "total": pa.array([n for _, _, n, *_ in kept], pa.int32()), "out": rewritten(whole, update_moves, selection),
            })

    return rows.select("name", "flags", "seq", "qual", "tags", "segs", "reasons").mapInArrow(run, f"name string, flags int, seq string, qual string, idx int, total int, out {f'array<{TAG}>' if selection is None else 'string'}")


def counted(reads: DataFrame, plan: Plan) -> DataFrame:
    """The run's counters: one pass over the reads and one row."""
    return counters.counters(filters.with_reasons(trimmed(reads, plan), plan.filters))


def bam_records(reads: DataFrame, plan: Plan) -> DataFrame:
    """name, flags, seq, qual, tags of BAM reads that pass, for sinks.write_blocks."""
    rows = _tagged(reads, plan, "bam")
    return rows.select(bam_segment_name(F.col("name"), F.col("idx"), F.col("total")).alias("name"), "flags", "seq", "qual", F.col("out").alias("tags"))


def bam_to_fastq(reads: DataFrame, plan: Plan) -> DataFrame:
    rows = _tagged(reads, plan, "fastq")
    return rows.select(fastq_record(segment_name(F.col("name"), F.col("idx"), F.col("total")), F.col("seq"), F.col("qual"), F.col("out")).alias("record"))
