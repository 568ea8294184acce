"""Adapter inference: k-mers of read ends are counted and recounted by Spark; at most 500 k-mers
and 4000 windows per end reach the driver, which assembles consensus sequences."""

from __future__ import annotations

import math
import statistics
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.sequence import kmers, low_complexity
from ..sources.catalog import MIN_LENGTH, Adapter
from ..sources.shared import written
from .adapters import end_costs, matrix, reverse_complement

# Fixed values.
K = 16
TOP = 500
END = 100
WINDOWS = 4000
EDITS = 2
CAP = 100
PATHS = 3
PEEL = 0.25
TRIM_SHARE = 0.075
TRIM_MOST = 7
MIN_SUPPORT = 0.30
MARGINAL = 0.45
NAME_IDENTITY = 0.60
NAME_HITS = 3
ANCHOR = 32


@dataclass(frozen=True)
class Inferred:
    adapter: Adapter
    assembled: str
    support: float
    names: tuple  # (name, percent)


def end_window(seq: Column, five: bool) -> Column:
    return F.substring(seq, 1, END) if five else F.substring(seq, F.greatest(F.length(seq) - END + 1, F.lit(1)), F.lit(END))


def top_kmers(reads: DataFrame, five: bool, k: int = K, top: int = TOP) -> DataFrame:
    """kmer, n of the most frequent plain k-mers of one end; ties by sequence (the order of their codes)."""
    found = reads.where(F.length("seq") > 0).select(F.explode(kmers(F.upper(end_window(F.col("seq"), five)), k)).alias("kmer"))
    plain = found.where(F.col("kmer").rlike("^[ACGT]+$") & ~low_complexity(F.col("kmer"), k))
    return plain.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kmer").limit(top)


def stride_sample(windows: DataFrame, order: list[str], most: int = WINDOWS) -> DataFrame:
    """Every step-th row in order, at most `most`.

    Ranks come from sorted ranges of the table: rows before a range, then a row number within it."""
    held = windows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), F.spark_partition_id().alias("part"))
    held = written(held, "ranges")
    sizes = {r.part: r["count"] for r in held.groupBy("part").count().collect()}  # a row per partition
    step, before, starts = max(1, math.ceil(sum(sizes.values()) / most)), 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    number = F.row_number().over(Window.partitionBy("part").orderBy(*(F.col(f"row.{c}") for c in order))) - 1
    starts = held.sparkSession.createDataFrame(starts, "part int, before bigint")
    ranked = held.withColumn("number", number).join(F.broadcast(starts), "part")
    return ranked.where((F.col("before") + F.col("number")) % step == 0).select("row.*")


def contains(patterns: list[str], windows: list[str], edits) -> np.ndarray:
    """In how many windows each pattern occurs within its number of edits, on the forward strand."""
    text = matrix([w.encode() for w in windows])
    return np.array([int((end_costs(p.encode(), text) <= e).any(axis=1).sum()) if text.size else 0 for p, e in zip(patterns, edits, strict=True)], np.int64)


def recount(kmer_rows: DataFrame, windows: list[str], edits: int = EDITS) -> dict[str, int]:
    """Windows per k-mer within `edits`; windows (at most 4000 of 100 bases) are broadcast."""
    shipped = kmer_rows.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        for batch in batches:
            names = batch.column("kmer").to_pylist()
            yield pa.RecordBatch.from_pydict({"kmer": batch.column("kmer"), "n": pa.array(contains(names, shipped.value, [edits] * len(names)))})

    parts = kmer_rows.sparkSession.sparkContext.defaultParallelism
    return {r.kmer: r.n for r in kmer_rows.select("kmer").repartition(parts).mapInArrow(run, "kmer string, n bigint").where("n > 0").collect()}


def heaviest_path(weights: dict[str, int], cap: int = CAP) -> tuple[str, list[int], list[str]]:
    """Greedy walk both ways from the heaviest k-mer: consensus, profile per base, k-mers used."""
    start = min(weights, key=lambda s: (-weights[s], s))
    k, path, seen = len(start), [start], {start}

    def best(options):
        live = [o for o in options if o in weights and o not in seen]
        return min(live, key=lambda s: (-weights[s], s)) if live else None

    for forward in (True, False):
        while k + len(path) - 1 < cap:
            tip = path[-1] if forward else path[0]
            step = best([tip[1:] + c for c in "ACGT"] if forward else [c + tip[:-1] for c in "ACGT"])
            if step is None:
                break
            seen.add(step)
            path.insert(len(path) if forward else 0, step)
    profile = [weights[path[0]]] * k + [weights[s] for s in path[1:]]
    return path[0] + "".join(s[-1] for s in path[1:]), profile, path


def peel(weights: dict[str, int]) -> list[tuple[str, list[int]]]:
    """Up to three paths, each without the k-mers of those before; weak ones end the search."""
    left, out, first = dict(weights), [], None
    while left and len(out) < PATHS:
        seq, profile, used = heaviest_path(left)
        weight = sum(left[s] for s in used)
        first = weight if first is None else first
        if weight < PEEL * first:
            break
        out.append((seq, profile))
        for s in used:
            del left[s]
    return out


def drop_trim(seq: str, profile: list[int]) -> str:
    """Cut weak flanks of a consensus, a few bases at most on each side."""
    steps = [abs(b - a) for a, b in zip(profile, profile[1:], strict=False)]
    top = max(profile)
    bar = top - ((statistics.median(steps) if steps else 0) + TRIM_SHARE * top)
    a, b = 0, len(seq)
    while a < min(TRIM_MOST, len(seq)) and profile[a] < bar:
        a += 1
    while len(seq) - b < TRIM_MOST and b > 0 and profile[b - 1] < bar:
        b -= 1
    return seq[a:b] if a < b else seq


def within(short: str, long: str, k: int) -> int | None:
    """Least cost of short in long on either strand, if at most k."""
    text = matrix([long.encode(), reverse_complement(long.encode())])
    cost = int(end_costs(short.encode(), text).min())
    return cost if cost <= k else None


def same(a: str, b: str, rate: float) -> bool:
    short, long = sorted((a, b), key=len)
    if len(short) < MIN_LENGTH:
        return a == b
    return within(short, long, math.floor(rate * len(short))) is not None


def anchor(seq: str, end: str) -> str:
    """The part of a consensus that conservative trimming uses."""
    return seq if len(seq) <= ANCHOR else seq[-ANCHOR:] if end == "3" else seq[:ANCHOR]


def named(seq: str, known: list[Adapter], rate: float) -> tuple:
    hits = []
    for a in known:
        short, long = sorted((seq, a.seq), key=len)
        cost = within(short, long, math.ceil(rate * len(short)))
        if cost is not None and 1 - cost / len(short) >= NAME_IDENTITY:
            hits.append((cost / len(short), a.name, 100 * (1 - cost / len(short))))
    return tuple((name, p) for _, name, p in sorted(hits)[:NAME_HITS])


def candidates(reads: DataFrame, five: bool, rate: float, order: list[str]) -> list[tuple[str, float]]:
    """Consensus sequences of one end and their support."""
    windows = reads.where(F.length("seq") > 0).select(*order, F.upper(end_window(F.col("seq"), five)).alias("w"))
    picked = [r.w for r in stride_sample(windows, order).collect()]
    if len(picked) < 3:
        return []
    weights = recount(top_kmers(reads, five), picked)
    found = [drop_trim(s, p) for s, p in peel(weights)] if weights else []
    counts = contains(found, picked, [math.floor(rate * len(s)) for s in found])
    return [(s, c / len(picked)) for s, c in zip(found, counts.tolist(), strict=True)]


def infer(reads: DataFrame, known: list[Adapter] = (), rate: float = 0.2, conservative: bool = True, order: tuple = ("name",)) -> list[Inferred]:
    """Adapters found at the ends of a bounded sample of reads."""
    ends = {five: candidates(reads, five, rate, list(order)) for five in (True, False)}
    every, used, merged = ends[True] + ends[False], set(), []
    for s5, _ in ends[True]:
        twin = next((i for i, (s3, _) in enumerate(ends[False]) if i not in used and same(s5, s3, rate)), None)
        if twin is None:
            merged.append((s5, "5"))
        else:
            used.add(twin)
            s3 = ends[False][twin][0]
            merged.append((s5 if conservative or len(s5) >= len(s3) else s3, "both"))
    merged += [(s, "3") for i, (s, _) in enumerate(ends[False]) if i not in used]
    out = []
    for seq, end in merged:
        support = max(p for s, p in every if same(s, seq, rate))
        if len(seq) >= MIN_LENGTH and support >= MIN_SUPPORT:
            out.append(Inferred(Adapter("", anchor(seq, end) if conservative else seq, end), seq, support, named(seq, list(known), rate)))
    out.sort(key=lambda x: (-x.support, x.adapter.seq))
    return [replace(x, adapter=replace(x.adapter, name=f"inferred_{i}")) for i, x in enumerate(out, 1)]


def report(found: list[Inferred], conservative: bool = True) -> str:
    """FASTA text of inferred adapters."""
    lines = []
    for x in found:
        names = "".join(f" ≈ {n} ({p:.0f}%)" for n, p in x.names)
        lines.append(f">{x.adapter.name} support={x.support:.2f} boundary={'conservative' if conservative else 'full'} assembled_length={len(x.assembled)} uncertain_bases={len(x.assembled) - len(x.adapter.seq)}{names}\n{x.adapter.seq}")
    return "\n".join(lines)
