"""Approximate adapter search and segmentation.

Costs come from Myers' bit-parallel recurrence, run over all reads of an Arrow batch at once
(one 64-bit word per read); patterns over 63 bases use a plain column DP over the batch. A hit
is an end position whose cost is at most k and a local minimum (the rightmost of a plateau);
its start is the farthest one with that cost. The other strand is searched in the
reverse-complemented text. Interior scans look only around exact copies of one of k + 1 parts
of the pattern, which every hit within k edits must contain."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..plans.model import AdapterPlan
from ..sources.catalog import MIN_LENGTH, Adapter
from .trim import _ARROW, SEGMENTS

Hit = tuple[int, int, int]  # start, end, cost
_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")


def reverse_complement(seq: bytes) -> bytes:
    return seq.translate(_COMPLEMENT)[::-1]


def matrix(texts: list[bytes], right: bool = False) -> np.ndarray:
    """Upper-case texts as rows, padded with zeros after (or before) them."""
    width = max(map(len, texts), default=0)
    out = np.zeros((len(texts), width), np.uint8)
    for row, t in zip(out, texts, strict=True):
        if t:
            row[len(row) - len(t) if right else 0 : len(row) if right else len(t)] = np.frombuffer(t.upper(), np.uint8)
    return out


def end_costs(pattern: bytes, text: np.ndarray) -> np.ndarray:
    """Least edit distance of the pattern to a piece that ends at each position (columns) of each text (rows)."""
    m, (rows, width) = len(pattern), text.shape
    out = np.empty((rows, width), np.int16)
    if m > 63:
        column = np.tile(np.arange(m + 1, dtype=np.int16), (rows, 1))
        steps, p = np.arange(m + 1, dtype=np.int16), np.frombuffer(pattern, np.uint8)
        for j in range(width):
            new = np.empty_like(column)
            new[:, 0] = 0
            new[:, 1:] = np.minimum(column[:, :-1] + (text[:, j : j + 1] != p), column[:, 1:] + 1)
            column = np.minimum.accumulate(new - steps, axis=1) + steps
            out[:, j] = column[:, m]
        return out
    table = np.zeros(256, np.uint64)
    for i, c in enumerate(pattern):
        table[c] |= np.uint64(1 << i)
    mask, top, one = np.uint64((1 << m) - 1), np.uint64(m - 1), np.uint64(1)
    pv, mv, score = np.full(rows, mask), np.zeros(rows, np.uint64), np.full(rows, m, np.int16)
    for j in range(width):
        eq = table[text[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        score = score + ((ph >> top) & one).astype(np.int16) - ((mh >> top) & one).astype(np.int16)
        ph, mh = (ph << one) & mask, (mh << one) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        out[:, j] = score
    return out


def minima(costs: np.ndarray, k: int) -> list[int]:
    """Positions of local minima of at most k, the rightmost of each plateau."""
    edge = np.flatnonzero(np.diff(costs)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(costs)]])
    v = costs[starts]
    left = np.concatenate([[True], v[:-1] > v[1:]])
    right = np.concatenate([v[1:] > v[:-1], [True]])
    return (ends[(v <= k) & left & right] - 1).tolist() if len(costs) else []


def start_of(pattern: bytes, text: bytes, end: int, cost: int) -> int:
    """The farthest start of a piece that ends at `end` and is `cost` edits from the pattern."""
    m, back, p = len(pattern), text[max(0, end - len(pattern) - cost) : end][::-1], pattern[::-1]
    column, best = list(range(m + 1)), 0 if m == cost else None
    for j, c in enumerate(back, 1):
        new = [j]
        for i in range(1, m + 1):
            new.append(min(column[i - 1] + (p[i - 1] != c), column[i] + 1, new[i - 1] + 1))
        column = new
        if column[m] == cost:
            best = j
    return end - (best or 0)


def search(pattern: bytes, text: bytes, k: int, both_strands: bool = True) -> list[Hit]:
    """All hits of a pattern in one text; the strand isn't told apart."""
    text, n, hits = text.upper(), len(text), []
    for flipped in (False, True)[: 2 if both_strands else 1]:
        t = reverse_complement(text) if flipped else text
        if not t:
            continue
        costs = end_costs(pattern, matrix([t]))[0]
        for at in minima(costs, k):
            cost = int(costs[at])
            s, e = start_of(pattern, t, at + 1, cost), at + 1
            hits.append((n - e, n - s, cost) if flipped else (s, e, cost))
    return hits


def batch_hits(pattern: bytes, texts: list[bytes], k: int, right: bool) -> list[list[Hit]]:
    """search() of many short texts at once."""
    out: list[list[Hit]] = [[] for _ in texts]
    upper = [t.upper() for t in texts]
    for flipped in (False, True):
        ts = [reverse_complement(t) for t in upper] if flipped else upper
        pad_left = right != flipped
        text = matrix(ts, pad_left)
        if not text.size:
            continue
        costs = end_costs(pattern, text)
        for r in np.flatnonzero((costs <= k).any(axis=1)):
            t = ts[r]
            c = costs[r, text.shape[1] - len(t) :] if pad_left else costs[r, : len(t)]
            for at in minima(c, k):
                cost, e = int(c[at]), at + 1
                s = start_of(pattern, t, e, cost)
                out[r].append((len(t) - e, len(t) - s, cost) if flipped else (s, e, cost))
    return out


def seeded(pattern: bytes, text: bytes, k: int) -> list[Hit]:
    """search() of a long text near exact copies of k + 1 parts of the pattern; it loses no hit."""
    m, n, zones = len(pattern), len(text), []
    for p in (pattern, reverse_complement(pattern)):
        for i in range(k + 1):
            part = p[i * m // (k + 1) : (i + 1) * m // (k + 1)]
            at = text.find(part)
            while at >= 0:
                zones.append((max(0, at - m - k - 2), min(n, at + m + k + 2)))
                at = text.find(part, at + 1)
    merged: list[list[int]] = []
    for a, b in sorted(zones):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a + s, a + e, c) for a, b in merged for s, e, c in search(pattern, text[a:b], k)]


def classify(start: int, end: int, n: int, adapter_end: str, end_size: int) -> str | None:
    """five, three, excise or None (interior)."""
    near5 = start <= end_size and adapter_end in ("5", "both")
    near3 = end >= n - end_size and adapter_end in ("3", "both")
    return "excise" if near5 and near3 else "five" if near5 else "three" if near3 else None


def terminal(start: int, end: int, n: int, adapter_end: str, end_size: int) -> str | None:
    """classify() for ends-only runs, which never excise."""
    kind = classify(start, end, n, adapter_end, end_size)
    return ("five" if start <= n - end else "three") if kind == "excise" else kind


def budgets(length: int, rate: float) -> tuple[int, int]:
    return math.floor(rate * length), math.floor(0.5 * rate * length)


def assemble(n: int, lo: int, hi: int, cuts: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of [lo, hi) without the cuts."""
    if lo >= hi:
        return []
    out, at = [], lo
    for s, e in sorted((max(s, lo), min(e, hi)) for s, e in cuts):
        if s >= e:
            continue
        if s > at:
            out.append((at, s))
        at = max(at, e)
    if at < hi:
        out.append((at, hi))
    return out


def interior(text: bytes, adapter: Adapter, plan: AdapterPlan) -> list[Hit]:
    """Hits within the interior budget, on either strand, that lie in no end zone of the adapter; text is upper case."""
    p = adapter.seq.upper().encode()
    most = budgets(len(p), plan.error_rate)[1]
    return [(s, e, c) for s, e, c in seeded(p, text, most) if c <= most and classify(s, e, len(text), adapter.end, plan.end_size) is None]


def interior_hits(seq: Column, plan: AdapterPlan) -> Column:
    """adapter (its number), s, e and cost of each interior hit of a read."""
    kind = pa.list_(pa.struct([("adapter", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("cost", pa.int32())]))

    @F.arrow_udf("array<struct<adapter:int,s:int,e:int,cost:int>>")
    def found(column: pa.Array) -> pa.Array:
        texts = [(x or b"").upper() for x in column.cast(pa.large_binary()).to_pylist()]
        able = [(i, a) for i, a in enumerate(plan.adapters) if len(a.seq) >= MIN_LENGTH]
        return pa.array([[{"adapter": i, "s": s, "e": e, "cost": c} for i, a in able for s, e, c in sorted(interior(t, a, plan))] for t in texts], kind)

    return found(seq)


def segment_batch(texts: list[bytes], plan: AdapterPlan) -> list[list[tuple[int, int]]]:
    """Segments of each window after adapters are removed."""
    size = len(texts)
    lo, hi, cuts = [0] * size, [len(t) for t in texts], [[] for _ in texts]
    kind_of = classify if plan.split else terminal
    texts = [t.upper() for t in texts]
    for a in plan.adapters:
        p = a.seq.upper().encode()
        if len(p) < MIN_LENGTH:
            continue
        k_end, _ = budgets(len(p), plan.error_rate)
        zone = plan.end_size + len(p) + k_end
        if a.end in ("5", "both") or plan.split:
            for r, hits in enumerate(batch_hits(p, [t[:zone] for t in texts], k_end, False)):
                for s, e, _ in hits:
                    kind = kind_of(s, e, len(texts[r]), a.end, plan.end_size)
                    if kind == "five":
                        lo[r] = max(lo[r], e)
                    elif kind == "excise":
                        cuts[r].append((s, e))
        if a.end in ("3", "both") or plan.split:
            for r, hits in enumerate(batch_hits(p, [t[max(0, len(t) - zone) :] for t in texts], k_end, True)):
                shift = max(0, len(texts[r]) - zone)
                for s, e, _ in hits:
                    kind = kind_of(s + shift, e + shift, len(texts[r]), a.end, plan.end_size)
                    if kind == "three":
                        hi[r] = min(hi[r], s + shift)
                    elif kind == "excise":
                        cuts[r].append((s + shift, e + shift))
        if plan.split:
            for r, t in enumerate(texts):
                cuts[r] += [(s, e) for s, e, _ in interior(t, a, plan)]
    return [assemble(len(t), lo[r], hi[r], cuts[r]) if t else [] for r, t in enumerate(texts)]


def adapter_segments(plan: AdapterPlan):
    """A function for operators.trim.segments: windows of a read without adapters."""

    @F.arrow_udf(SEGMENTS)
    def cut(seq: pa.Array, windows: pa.Array) -> pa.Array:
        reads, spans = seq.cast(pa.large_binary()).to_pylist(), windows.to_pylist()
        flat = [(r, w["s"], w["e"]) for r, ws in enumerate(spans) for w in ws or ()]
        out: list[list] = [[] for _ in reads]
        for begin in range(0, len(flat), 1024):
            part = flat[begin : begin + 1024]
            for (r, s, _), found in zip(part, segment_batch([reads[r][s:e] for r, s, e in part], plan), strict=True):
                out[r] += [{"s": s + a, "e": s + b} for a, b in found]
        return pa.array(out, _ARROW)

    return lambda seq, windows: cut(seq, windows) if plan.adapters else windows


def long_hits(pattern: bytes, texts: list[bytes], k: int, tile: int = 1024) -> list[list[Hit]]:
    """search() of long texts, in tiles of one batch; a tile sees enough of its neighbour for every hit."""
    if k == 0:
        return [seeded(pattern, t, 0) for t in texts]
    margin, out = len(pattern) + k + 2, [[] for _ in texts]
    for flipped in (False, True):
        ts = [reverse_complement(t) if flipped else t for t in texts]
        at = [(r, a) for r, t in enumerate(ts) for a in range(0, len(t), tile)]
        costs: list[list[np.ndarray]] = [[] for _ in texts]
        for begin in range(0, len(at), 4096):
            part = at[begin : begin + 4096]
            pieces = [ts[r][max(0, a - margin) : a + tile] for r, a in part]
            for (r, a), piece, c in zip(part, pieces, end_costs(pattern, matrix(pieces)), strict=True):
                costs[r].append(c[min(a, margin) : len(piece)])
        for r, t in enumerate(ts):
            if not costs[r]:
                continue
            c = np.concatenate(costs[r])
            for i in minima(c, k):
                cost, e = int(c[i]), i + 1
                s = start_of(pattern, t, e, cost)
                out[r].append((len(t) - e, len(t) - s, cost) if flipped else (s, e, cost))
    return out


def acting(adapter: Adapter, texts: list[bytes], plan: AdapterPlan) -> int:
    """In how many reads the adapter would change something."""
    p = adapter.seq.upper().encode()
    if len(p) < MIN_LENGTH:
        return 0
    k_end, k_mid = budgets(len(p), plan.error_rate)
    texts = [t.upper() for t in texts]
    return sum(any(classify(s, e, len(t), adapter.end, plan.end_size) or (plan.split and c <= k_mid) for s, e, c in hits) for t, hits in zip(texts, long_hits(p, texts, k_end), strict=True))


def min_end_cost(seq: Column, pattern: str, zone: int) -> Column:
    """Least cost of the pattern (this strand) in the first `zone` bases; null for an empty read."""

    @F.arrow_udf("int")
    def cost(column: pa.Array) -> pa.Array:
        texts = [(x or b"")[:zone] for x in column.cast(pa.large_binary()).to_pylist()]
        costs = end_costs(pattern.encode(), matrix(texts))
        return pa.array([int(c[: len(t)].min()) if t else None for c, t in zip(costs, texts, strict=True)], pa.int32())

    return cost(seq)
