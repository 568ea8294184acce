from fractions import Fraction

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from strandloom.llm import mixing

from .helpers import corpus, docs


def by_slots(parts: dict) -> list:
    """Brute force of a period: each slot takes the released block with the earliest deadline; None wins ties."""
    total, done, slots = sum(parts.values()), dict.fromkeys(parts, 0), []
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // p), s is not None, str(s), s) for s, p in parts.items() if done[s] * total // p <= t and done[s] < p]
        s = min(ready)[3]
        done[s] += 1
        slots.append(s)
    return slots


weights = st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 9), min_size=0, max_size=6)


@settings(max_examples=150, deadline=None)
@given(weights, st.integers(0, 40))
def test_period_is_earliest_deadline_first(parts, rest):
    slots = by_slots({**parts, **({None: rest} if rest else {})})
    assert mixing.period(parts, rest) == {s: [t for t, x in enumerate(slots) if x == s] for s in parts}


def test_period_meets_every_window():
    parts = {"a": 7, "b": 4, "c": 1, "d": 1}
    places, total = mixing.period(parts), 13
    assert sorted(t for p in places.values() for t in p) == list(range(total))
    for s, p in parts.items():
        for t in range(3 * total):
            done = t // total * p + sum(x <= t % total for x in places[s])
            assert abs(done - Fraction(p * (t + 1), total)) < 1


def schedule(blocks: dict, parts: dict, rest: dict, default: int) -> list:
    """Slots as the operator computes them, in order: the source of each one."""
    others: dict[int, int] = {}
    ties = {}
    for s, n in sorted(rest.items()):
        ties[s] = others.get(n, 0)
        others[n] = ties[s] + 1
    names = sorted(parts)
    slot = mixing._scheduler(names, mixing.phases(blocks, parts, others, default), others)
    rows = [(names.index(s), k, n, 0, s) for s, n in blocks.items() for k in range(n)] + [(-1, k, n, ties[s], s) for s, n in rest.items() for k in range(n)]
    if not rows:
        return []
    found = slot(*(pd.Series([r[i] for r in rows]) for i in range(4)))
    placed = {x: (r[4], r[1]) for x, r in zip(found, rows, strict=True)}
    assert sorted(placed) == list(range(len(rows)))
    seen: dict = {}
    for x in sorted(placed):
        s, k = placed[x]
        assert seen.get(s, 0) == k  # blocks of a source keep their order
        seen[s] = k + 1
    return [placed[x][0] for x in sorted(placed)]


def follows_shares(blocks: dict, parts: dict, rest: dict, default: int) -> None:
    """Each source is less than a block from its share, counted from when the shares last changed."""
    slots = schedule(blocks, parts, rest, default)
    left, turn = {**blocks, **rest}, 0
    sharing = lambda: {**{s: parts[s] for s in blocks if left[s]}, **{s: default for s in rest if rest[s] > turn}}
    now, since, at = sharing(), dict.fromkeys(left, 0), 0
    for s in slots:
        left[s] -= 1
        since[s] += 1
        at += 1
        for x, p in now.items():
            assert abs(since[x] - Fraction(at * p, sum(now.values()))) < 1
        while any(rest[x] > turn for x in rest) and all(rest[x] - left[x] > turn for x in rest if rest[x] > turn):
            turn += 1
        # after the last weighted source, the others only take turns
        if sharing() != now:
            now, since, at = sharing(), dict.fromkeys(left, 0), 0


def test_phases_follow_the_shares():
    follows_shares({"a": 40, "b": 3, "c": 11, "d": 0, "e": 1}, {"a": 1, "b": 5, "c": 2, "d": 9, "e": 3}, {}, 2)
    follows_shares({"a": 40, "b": 3}, {"a": 6, "b": 1}, {"x": 1, "y": 9, "z": 9, "w": 30}, 2)
    follows_shares({}, {}, {"x": 1, "y": 9, "z": 4}, 2)


numbers = st.integers(0, 25)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), numbers), st.dictionaries(st.sampled_from("uvwxyz"), st.integers(1, 25)), st.integers(1, 4))
def test_any_phases_follow_the_shares(blocks, rest, default):
    follows_shares(blocks, {"a": 7, "b": 4, "c": 1, "d": 2}, rest, default)


def test_all_rows_are_placed(spark):
    rows = [*corpus(), (None, "x", None, None, 0, 0, "", ""), (None, None, None, "", 0, 0, "", "")]
    out = mixing.mixed(docs(spark, rows), {"src0": 3, "src1": 1}, block=4)
    got = out.collect()
    assert sorted(repr(tuple(r)[:8]) for r in got) == sorted(map(repr, rows))
    assert len({r.position for r in got}) == len(rows)
    for r in got:
        assert r.slot == r.position // 4
    by = {}
    for r in sorted(got, key=lambda r: r.position):
        by.setdefault(r.source or "", []).append(r.block)
    for blocks in by.values():
        assert blocks == [i // 4 for i in range(len(blocks))]


def test_more_sources_than_a_driver_would_list(spark):
    # source i has 1 to 3 blocks; one weighted source holds a third of all rows
    rows = [(i, "t", "en", f"site{i % 6000 if i % 3 else i % 2000}", 1, 1, "b", None) for i in range(10_000)] + [(i, "t", "en", "src0", 1, 1, "b", None) for i in range(10_000, 15_000)]
    got = mixing.mixed(docs(spark, rows), {"src0": 3}, block=1).select("source", "block", "slot").collect()
    assert sorted(r.slot for r in got) == list(range(15_000))
    seen: dict[str, int] = {}
    for r in sorted(got, key=lambda r: r.slot):
        assert r.block == seen.get(r.source, 0)
        seen[r.source] = r.block + 1
    sites = sorted((r.slot, r.block) for r in got if r.source != "src0")
    assert [b for _, b in sites] == sorted(b for _, b in sites)  # turn after turn


def test_clashing_columns_empty_and_bad_weights(spark):
    extra = docs(spark).withColumnsRenamed({"n_words": "slot", "bucket": "position"})
    assert mixing.mixed(extra).columns == [*[c for c in extra.columns if c not in ("slot", "position")], "block", "slot", "position"]
    assert mixing.mixed(docs(spark, [])).count() == 0
    assert mixing.mixed(docs(spark), {}).count() == docs(spark).count()
    with pytest.raises(ValueError):
        mixing.mixed(docs(spark), {"src0": 0})
