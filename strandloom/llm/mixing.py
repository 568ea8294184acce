"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put into a pseudo-random order and cut into blocks. Block k of a
source with share w is released at slot floor(k/w) and due by slot ceil((k+1)/w); the schedule
takes, slot by slot, the released block with the earliest deadline. All deadlines are met, so
after any number of slots a source is less than one block from its target share.

Sources with a target weight are scheduled one by one. All others have `default` parts each and are
scheduled as one unit, with their parts together; inside it they take turns. Blocks of equal shares have
equal deadlines, so turns are what earliest deadline first gives them, and each stays less than
one block from its share of the whole. There may be any number of such sources (domains, say):
the driver holds counts of sources by number of blocks, never a list of them.

Shares are whole parts of a common total, so the schedule repeats after that many slots: the
driver lays out where one period has the weighted sources, and an executor finds a block's slot
from its number by division. When a weighted source runs out, or a turn of the others ends in which some ran
out, the rest go on in a new phase with shares in proportion to their weights, so no document is
dropped. Phases are at most as many as target weights and different block counts of other
sources (which grow with the square root of the corpus at most), each of as many slots on the
driver as the target weights have parts.

Ranks within a source come from hash ranges (a count per range, then a row number inside it), so
a source that holds most rows is spread over all tasks.

A null source counts as the empty name. Rows
with equal or null doc_id are all placed (ties by a hash of the text); texts of any length are
only carried along; an empty table gives an empty one. Extra columns stay; the
columns added are block, slot and position (slot x block size + place in the block, unique and
increasing in mixing order), and they replace columns of the same name.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window

from .shared import written

BLOCK = 16
DEFAULT = 2

# Target parts of the registered query; other sources get DEFAULT parts.
TARGETS = {"src0": 6, "src1": 5, "src2": 4, "src3": 3, "src4": 1}


def period(parts: Mapping[str, int], rest: int = 0) -> dict[str, list[int]]:
    """Slots of each source in one period, by earliest deadline among released blocks; `rest` more parts, one unit, fill the other slots.

    Runs of the rest are laid out at once, so the work is in proportion to the parts of the sources."""
    total = sum(parts.values()) + rest
    waiting = [(0, s, 0) for s in parts]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    places: dict[str, list[int]] = {s: [] for s in parts}
    t = done = 0
    while t < total:
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // parts[s]), s, k))
        if rest:
            # how many blocks of the rest in a row are released, due first, and before the next release
            run = total - t if total == rest else -(-((t + 1) * rest - done * total) // (total - rest))
            if ready:
                run = min(run, ready[0][0] * rest // total - done)
            if waiting:
                run = min(run, waiting[0][0] - t)
            if run > 0:
                t, done = t + run, done + run
                continue
        _, s, k = heapq.heappop(ready)
        places[s].append(t)
        heapq.heappush(waiting, ((k + 1) * total // parts[s], s, k + 1))
        t += 1
    return places


def phases(blocks: Mapping[str, int], parts: Mapping[str, int], others: Mapping[int, int] | None = None, default: int = DEFAULT) -> dict[str | None, list[tuple[int, int, int, list[int]]]]:
    """Phases of each source with blocks, and under None of the `others` (how many sources have how many blocks).

    A phase is the first block in it, its first slot, its period's length, and the source's slots in a period (under None: the slots of all others)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    out: dict[str | None, list] = {s: [] for s in [*left, None]}
    used, at = dict.fromkeys(out, 0), 0
    turns = _turns(others or {})
    while left or turns:
        members, unit = turns[-1] if turns else (0, 0)
        if not left:
            unit = sum(n for _, n in turns)  # nothing to share slots with: one phase
        rest = default * members
        places = period({s: parts[s] for s in sorted(left)}, rest)
        total = rest + sum(parts[s] for s in left)
        ends = [(left[s] - 1) // len(p) * total + p[(left[s] - 1) % len(p)] + 1 for s, p in places.items()]
        taken = sorted(t for p in places.values() for t in p)
        if unit:
            free = (unit - 1) % rest
            ends.append((unit - 1) // rest * total + free + sum(t - i <= free for i, t in enumerate(taken)) + 1)
        length, spent = min(ends), 0
        for s, p in places.items():
            out[s].append((used[s], at, total, p))
            done = length // total * len(p) + sum(t < length % total for t in p)
            used[s] += done
            left[s] -= done
            spent += done
        if unit:
            out[None].append((used[None], at, total, taken))
            used[None] += length - spent
            turns[-1] = members, unit - length + spent
            if not left:
                turns = []
            elif not turns[-1][1]:
                turns.pop()
        at += length
        left = {s: n for s, n in left.items() if n}
    return {s: p for s, p in out.items() if p}


def _turns(others: Mapping[int, int]) -> list[tuple[int, int]]:
    """Members and blocks of the runs of turns that have equally many members, the first one last."""
    members, before, out = sum(others.values()), 0, []
    for n in sorted(others):
        out.append((members, members * (n - before)))
        members, before = members - others[n], n
    return out[::-1]


class _Slots:
    """Slots of blocks of one unit, by division."""

    def __init__(self, table: Sequence[tuple[int, int, int, list[int]]]):
        self.first, self.start, self.total = (np.array([p[i] for p in table], np.int64) for i in range(3))
        self.places = [np.array(p[3], np.int64) for p in table]

    def of(self, number: np.ndarray, others: bool) -> np.ndarray:
        at = np.searchsorted(self.first, number, "right") - 1
        out = np.empty(len(number), np.int64)
        for i in np.unique(at):
            here, places = at == i, self.places[i]
            size = self.total[i] - len(places) if others else len(places)
            turn, place = np.divmod(number[here] - self.first[i], size)
            # the n-th slot that is not taken comes after all taken ones with fewer than n free slots ahead
            slot = place + np.searchsorted(places - np.arange(len(places)), place, "right") if others else places[place]
            out[here] = self.start[i] + turn * self.total[i] + slot
        return out


def _scheduler(names: Sequence[str], table: dict, others: Mapping[int, int]):
    """A function from target number (null: none), block, the source's blocks and its place among equals to the slot."""
    counts = sorted(others)
    have = np.array([others[n] for n in counts], np.int64)
    counts = np.array(counts, np.int64)
    members = have[::-1].cumsum()[::-1]  # of the turns up to each count
    starts = np.concatenate([[0], counts[:-1]]).astype(np.int64)
    before = np.concatenate([[0], (members * (counts - starts)).cumsum()[:-1]]).astype(np.int64)
    slots = {names.index(s) if s is not None else -1: _Slots(p) for s, p in table.items()}

    def slot(unit: pd.Series, block: pd.Series, blocks: pd.Series, tie: pd.Series) -> pd.Series:
        u, k = unit.to_numpy(), block.to_numpy()
        out = np.empty(len(u), np.int64)
        for x in np.unique(u):
            here = u == x
            number = k[here]
            if x < 0:
                # a turn goes through the sources that still have blocks, those with most blocks first
                turn, own = np.searchsorted(counts, number, "right"), np.searchsorted(counts, blocks.to_numpy()[here])
                number = before[turn] + (number - starts[turn]) * members[turn] + members[own] - have[own] + tie.to_numpy()[here]
            out[here] = slots[int(x)].of(number, x < 0)
        return pd.Series(out)

    return slot


def mixed(docs: DataFrame, targets: Mapping[str, int] | None = None, block: int = BLOCK, default: int = DEFAULT, source: str = "source", doc_id: str = "doc_id", text: str | None = "text") -> DataFrame:
    """docs with block, slot and position."""
    spark, targets = docs.sparkSession, TARGETS if targets is None else targets
    if any(not isinstance(p, int) or p < 1 for p in [*targets.values(), default]):
        raise ValueError("target parts are whole numbers of at least 1")
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    held = [c for c in docs.columns if c not in ("block", "slot", "position")]
    key = F.xxhash64(F.col(doc_id).cast("string"))
    # rows per range and ranges per source both grow with the square root of the rows
    ranges = max(16, math.ceil(math.sqrt(docs.count())))
    keyed = docs.select(F.struct(*held).alias("_row"), name.alias("_source"), key.alias("_key"), F.pmod(F.shiftrightunsigned(key, 24), F.lit(ranges)).alias("_range"))
    counts = written(keyed.groupBy("_source", "_range").agg(F.count(F.lit(1)).alias("_n")), "mixing-ranges")
    names = sorted(targets)
    units = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "_source string, _unit int")
    # one row per target weight
    sums = counts.groupBy("_source").agg(F.ceil(F.sum("_n") / block).alias("_blocks")).join(F.broadcast(units), "_source", "left").fillna(-1, ["_unit"])
    # one row per target weight and per block count of other sources
    held_by = sums.groupBy("_unit", "_blocks").agg(F.count(F.lit(1)).alias("n")).collect()
    others = {r["_blocks"]: r.n for r in held_by if r["_unit"] < 0}
    table = phases({names[r["_unit"]]: r["_blocks"] for r in held_by if r["_unit"] >= 0}, targets, others, default)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_source", "_range", before.alias("_before")).join(_tied(sums, sum(others.values())), "_source")
    tie = F.xxhash64(F.col(f"_row.{text}").cast("string")) if text else F.lit(0)
    inside = Window.partitionBy("_source", "_range").orderBy("_key", F.col(f"_row.{doc_id}"), tie)
    ranked = keyed.withColumn("_k", F.row_number().over(inside) - 1).join(offsets, ["_source", "_range"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_k")).withColumn("block", F.floor(F.col("_rank") / block).cast("bigint"))
    slot = F.pandas_udf(_scheduler(names, table, others), "bigint")
    out = ranked.select("_row", "block", "_rank", slot("_unit", "block", "_blocks", "_tie").alias("slot"))
    return out.select("_row.*", "block", "slot", (F.col("slot") * block + F.col("_rank") % block).alias("position"))


def _tied(sums: DataFrame, n: int) -> DataFrame:
    """sums with _tie, a source's number among those of its unit and block count; ranked in hash ranges, as rows are."""
    ranges = max(1, math.ceil(math.sqrt(n)))
    parted = sums.withColumn("_part", F.pmod(F.xxhash64("_source"), F.lit(ranges)))
    key = ["_unit", "_blocks"]
    sizes = parted.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_source")) - 1
    ranked = parted.withColumn("_in", inside).join(sizes.withColumn("_ahead", ahead), [*key, "_part"])
    return ranked.select("_source", *key, (F.col("_ahead") + F.col("_in")).cast("bigint").alias("_tie"))
