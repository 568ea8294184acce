"""Operator vectors: quality operators, summaries, filters, tags, adapters and inference."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.functions.quality import mean_arith_q, mean_prob_q, median_q
from strandloom.operators import adapters as a, infer, mods, tags, trim
from strandloom.operators.filters import drop_reason, judged
from strandloom.plans import model
from strandloom.sources.catalog import Adapter, catalog, parse_fasta

# Texts, cutoffs and results that are part of the behaviour to be matched.
VECTORS = [
    ("&#3-G27C:(@G7B55+C4I", 20, [(4, 20)], [(10, 16)], [(4, 5), (6, 9), (10, 16), (17, 18), (19, 20)]),
    ("77%'24)FAF9@=94'%054", 7, [(0, 20)], [(0, 20)], [(0, 2), (4, 15), (17, 20)]),
    ("'8$-BF2!C;+59->H@91#", 15, [(1, 19)], [(11, 19)], [(1, 2), (4, 7), (8, 10), (11, 13), (14, 19)]),
    ("%,42$CH*#0+0C6=0,*6/", 40, [], [], []),
    ("-------------------J", 40, [(19, 20)], [(19, 20)], [(19, 20)]),
    ("I-------------------", 40, [(0, 1)], [(0, 1)], [(0, 1)]),
]


def q(text):
    return np.array([ord(c) - 33 for c in text])


@pytest.mark.parametrize("text,cutoff,ends,best,split", VECTORS)
def test_quality_operators(text, cutoff, ends, best, split):
    assert trim.end_trim(q(text), cutoff) == ends
    assert trim.best_segment(q(text), cutoff) == best
    assert trim.quality_split(q(text), cutoff, 1) == split


def test_split_window():
    x = q("III#IIII###III")
    assert trim.quality_split(x, 10, 1) == [(0, 3), (4, 8), (11, 14)]
    assert trim.quality_split(x, 10, 3) == [(0, 8), (11, 14)]
    assert trim.quality_split(x, 10, 4) == [(0, 14)]


def test_composition_and_summaries(spark):
    text = lambda *v: "".join(chr(33 + x) for x in v)
    reads = spark.createDataFrame([("a", "A" * 20, text(2, 2, *[40] * 18))], "name string, seq string, qual string")
    segs = lambda plan: [(g.s, g.e) for g in trim.segments(reads, plan).first().segs]
    assert segs(model.TrimPlan(5, 3)) == [(5, 17)]
    assert segs(model.TrimPlan(2, 0, model.QualityOp("trim", 30))) == [(2, 20)]
    assert segs(model.TrimPlan(30, 3)) == []
    rows = spark.createDataFrame([(1, text(10)), (2, text(10, 11, 12)), (3, text(10, 11, 12, 20, 30, 40, 50)), (4, text(10, 20, 30, 40)), (5, ""), (6, None)], "i int, qual string")
    got = {r.i: r for r in rows.select("i", mean_prob_q("qual").alias("p"), mean_arith_q("qual").alias("a"), median_q("qual").alias("m")).collect()}
    assert got[1].p == pytest.approx(10.0) and got[2].p == pytest.approx(10.923583702678473) and got[3].p == pytest.approx(14.408827647036087)
    assert got[4].a == 25 and got[4].m == 25 and got[2].m == 11
    assert (got[5].p, got[5].a, got[5].m, got[6].p) == (0, 0, 0, 0)


def test_filters(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["AAA", "AAAAA", "A" * 9, "AAAA", "A" * 8, ""])], "i int, seq string").withColumn("qual", F.col("seq"))
    reasons = [r.r for r in rows.select("i", drop_reason(model.FilterPlan(4, 8)).alias("r")).orderBy("i").collect()]
    assert reasons == ["too_short", None, "too_long", None, None, "too_short"]
    gc = spark.createDataFrame([(i, s) for i, s in enumerate(["ATGC", "AAAT", "GCAAA", "GGCC"])], "i int, seq string").withColumn("qual", F.col("seq"))
    assert [r.drop_reason for r in judged(gc, model.FilterPlan(min_gc=0.4, max_gc=0.6)).orderBy("i").collect()] == [None, "gc", None, "gc"]
    two = spark.createDataFrame([("AC", "+5")], "seq string, qual string")
    assert judged(two, model.FilterPlan(min_quality=15, mode="arith")).first().drop_reason is None
    assert judged(two, model.FilterPlan(min_quality=15)).first().drop_reason == "low_quality"


@pytest.mark.parametrize("bad", [dict(min_length=9, max_length=8), dict(min_quality=5, max_quality=4), dict(min_gc=0.6, max_gc=0.5), dict(min_gc=float("nan")), dict(max_gc=1.5)])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        model.FilterPlan(**bad)


def test_bad_plans():
    with pytest.raises(ValueError):
        model.TrimPlan.of(qual_trim=10, qual_split=10)
    with pytest.raises(ValueError):
        model.Plan(sample=50)
    with pytest.raises(ValueError):
        model.selected_tags("MM,X")
    assert model.compression_level(None, True) == 4 and model.compression_level(None, False) == 6


MOD_CASES = [
    ("C+m,0,1,0;", [11, 22, 33], "CACATCTTC", 3, 9, "C+m,0,0;", [22, 33]),
    ("A+a,0;C+m?;", [9], "ACAC", 0, 4, "A+a,0;C+m?;", [9]),
    ("C+m,0;", [50], "CCCC", 2, 4, "", []),
    ("C+mh,0,0;", [1, 2, 3, 4], "CC", 0, 2, "C+mh,0,0;", [1, 2, 3, 4]),
    ("G-m,0,0;", [7, 8], "ACAC", 2, 4, "G-m,0;", [8]),
    ("C+m,0,0,0;", [5], "CCC", 0, 3, "C+m,0,0,0;", [5]),
    ("C+m,0,1,0;", [10, 20, 30], "CCCCC", 1, 5, "C+m,1,0;", [20, 30]),
]


@pytest.mark.parametrize("mm,ml,seq,s,e,want,values", MOD_CASES)
def test_modification_windows(mm, ml, seq, s, e, want, values):
    assert mods.serialise(mods.window(mods.parse(mm, ml)[0], seq, s, e)) == (want, values)


def test_random_modification_windows():
    r = np.random.default_rng(1)
    for _ in range(500):
        seq = "".join(r.choice(list("ACGT"), 60))
        at = [i for i, c in enumerate(seq) if c == "C" and r.random() < 0.5]
        occ = [seq[:i].count("C") for i in at]
        mm = "C+m" + "".join(f",{b - a - 1}" for a, b in zip([-1, *occ], occ, strict=False)) + ";"
        s, e = sorted(r.integers(0, 61, 2).tolist())
        kept = mods.window(mods.parse(mm, at)[0], seq, s, e)
        assert list(kept[0].ml if kept else []) == [i for i in at if s <= i < e]
        last, found = -1, []
        for d in kept[0].deltas if kept else ():
            last += d + 1
            found.append([i for i, c in enumerate(seq[s:e]) if c == "C"][last] + s)
        assert found == [i for i in at if s <= i < e]


SIGNAL = [("mv", "B:c", [2, 1, 1, 0, 1, 1, 0, 1, 1]), ("ts", "i", 10), ("ns", "i", 26), ("st", "Z", "t"), ("du", "f", 5.0)]


def cut(given, s, e, total=1, moves=True, seq="ACGTAC"):
    return {t: v for t, _, v in tags.rewrite(given, "r1", seq, [30] * len(seq), s, e, total, moves)}


def test_signal_tags():
    got = cut(SIGNAL, 2, 6)
    assert (got["mv"], got["ts"], got["ns"], got["st"], got["du"]) == ([2, 1, 1, 0, 1, 1], 16, 26, "t", 5.0)
    got = cut(SIGNAL, 0, 4)
    assert (got["mv"], got["ts"], got["ns"]) == ([2, 1, 1, 0, 1, 1, 0], 10, 22)
    got = cut(SIGNAL, 0, 3, 2)
    assert got == {"mv": [2, 1, 1, 0, 1], "ts": 0, "ns": 8, "sp": 0, "pi": "r1", "rn": -1}
    got = cut(SIGNAL, 3, 6, 2)
    assert (got["mv"], got["ns"], got["sp"]) == ([2, 1, 0, 1, 1], 8, 8)
    assert cut(SIGNAL, 2, 6, moves=False) == {"st": "t", "du": 5.0}
    big = [("mv", "B:c", SIGNAL[0][2]), ("ts", "i", 2147483645), ("ns", "i", 0)]
    assert (cut(big, 2, 6)["ts"], cut(big, 2, 6)["ns"]) == (2147483651, 2147483661)


def test_poly_a():
    with_pa = lambda pa: [*SIGNAL, ("pa", "B:i", pa), ("pt", "i", 30)]
    assert cut(with_pa([20, 18, 24, -1, -1]), 2, 6)["pa"] == [20, 18, 24, -1, -1]
    got = cut(with_pa([20, 18, 24, -1, -1]), 3, 6, 2)
    assert got["pa"] == [2, 0, 6, -1, -1] and got["pt"] == 30
    assert not {"pa", "pt"} & set(cut(with_pa([-1] * 5), 2, 6)) and not {"pa", "pt"} & set(cut(with_pa([-2, -1, -1, -1, -1]), 3, 6, 2))
    assert not {"pa", "pt"} & set(cut([*SIGNAL, ("pa", "B:I", [20, 18, 24]), ("pt", "i", 30)], 2, 6))
    # block values other than 0 count as one base
    assert cut([("mv", "B:c", [2, 1, 2, 0, 1, -1, 0, 1, 1]), *SIGNAL[1:]], 2, 6)["mv"] == [2, 1, -1, 0, 1, 1]
    assert "pa" not in cut(with_pa([12, 10, 14, -1, -1]), 2, 6) and "pt" not in cut(with_pa([12, 10, 14, -1, -1]), 2, 6)


def test_per_base_arrays():
    given = [("ip", "B:C", list(range(10))), ("pw", "B:C", list(range(100, 110))), ("RG", "Z", "g")]
    got = cut(given, 3, 8, seq="A" * 10)
    assert got == {"ip": [3, 4, 5, 6, 7], "pw": [103, 104, 105, 106, 107], "RG": "g"}
    short = [("ip", "B:C", [1, 2, 3])]
    assert cut(short, 1, 3, seq="ACGT") == {"ip": [1, 2, 3]} and tags.malformed(short, 4)


R12, R16 = "ACGTACGTACGT", "GGGGTTTTGGGGTTTT"
ADAPTER_CASES = [
    (R12 + "A" * 12, [(R12, "5")], 0.2, 20, False, [(12, 24)]),
    ("A" * 12 + R12, [(R12, "3")], 0.2, 20, False, [(0, 12)]),
    ("A" * 24 + R16 + "C" * 24, [(R16, "both")], 0.2, 20, True, [(0, 24), (40, 64)]),
    ("A" * 24 + R16 + "C" * 24, [(R16, "both")], 0.2, 20, False, [(0, 64)]),
    (R16, [(R16, "both")], 0.2, 20, True, []),
    ("AA" + R12 + "C" * 20, [(R12, "5")], 0.2, 4, False, [(14, 34)]),
    ("ACGTACG" + "A" * 20, [("ACGTACG", "both")], 0.2, 20, True, [(0, 27)]),
    # two interior copies that overlap in six bases
    ("A" * 24 + "GGGGTTTTTGTGTGTG" + "TGTTTTGGGG" + "C" * 24, [("GGGGTTTTTGTGTGTG", "both"), ("TGTGTGTGTTTTGGGG", "both")], 0.2, 20, True, [(0, 24), (50, 74)]),
    # a terminal copy whose last six bases begin an interior one
    ("GGTGTGGTTTGTTGGT" + "TGGTGTTGGG" + "C" * 34, [("GGTGTGGTTTGTTGGT", "5"), ("GTTGGTTGGTGTTGGG", "both")], 0.2, 9, True, [(26, 60)]),
    # four substitutions inside: over the interior budget
    ("A" * 24 + "GCTTCGTAGGAT" + "C" * 24, [("GGTTGGTTGGTT", "both")], 0.5, 10, True, [(0, 60)]),
    # six bases inserted into a terminal copy
    ("AA" + "AAAACCCCGG" + "CTGACT" + "GGTTTTACGT" + "T" * 30, [("AAAACCCCGGGGTTTTACGT", "5")], 0.3, 4, True, [(28, 58)]),
    ("AA" + "AAAACCCCGG" + "CTGACT" + "GGTTTTACGT" + "T" * 30, [("AAAACCCCGGGGTTTTACGT", "5")], 0.3, 4, False, [(28, 58)]),
    ("A" * 115 + "GGTTGGTTCCGGTTGGTTCC" + "C" * 115, [("GGTTGGTTCCGGTTGGTTCC", "both")], 0.2, 150, True, [(0, 115), (135, 250)]),
]


@pytest.mark.parametrize("text,given,rate,zone,split,want", ADAPTER_CASES)
def test_adapter_segments(text, given, rate, zone, split, want):
    plan = model.AdapterPlan(tuple(Adapter(f"a{i}", s, e) for i, (s, e) in enumerate(given)), rate, zone, split)
    assert a.segment_batch([text.encode()], plan) == [want]


def plain_costs(p, t):
    col, out = list(range(len(p) + 1)), []
    for c in t:
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(col[i - 1] + (p[i - 1] != c), col[i] + 1, new[i - 1] + 1))
        col = new
        out.append(col[-1])
    return out


def test_costs_and_seeds_against_plain_search():
    r = np.random.default_rng(5)
    dna = lambda n: "".join(r.choice(list("ACGT"), n))
    for m in (12, 24, 63, 70):
        p = dna(m)
        texts = [dna(r.integers(0, 120)) for _ in range(20)] + [dna(30) + p + dna(30)]
        got = a.end_costs(p.encode(), a.matrix([t.encode() for t in texts]))
        for t, row in zip(texts, got, strict=True):
            assert row[: len(t)].tolist() == plain_costs(p, t)
    for _ in range(60):
        p, k = dna(20), int(r.integers(0, 4))
        noisy = list(p)
        for i in r.choice(20, k, replace=False):
            noisy[i] = "ACGT"[("ACGT".index(noisy[i]) + 1) % 4]
        t = (dna(200) + "".join(noisy) + dna(300)).encode()
        whole = a.search(p.encode(), t, k)
        assert sorted(a.seeded(p.encode(), t, k)) == sorted(whole)
        assert [sorted(x) for x in a.long_hits(p.encode(), [t], k, tile=64)] == [sorted(whole)]


def test_catalog_and_fasta():
    found = catalog()
    assert len(found) == 124 and sum(x.name.startswith("BC") for x in found) == 96
    assert {x.name for x in found if len(x.seq) < 11} == {"NB_rear", "PBC_front", "RBK_front_legacy", "RLB_front"}
    assert next(x for x in found if x.name == "PCR1_front").end == "both"
    kept, warned = parse_fasta(">a x\nacgtac gtacgt\n>b\nACGN\n>c\nACGT\n")
    assert [(x.name, x.seq, x.end) for x in kept] == [("a", R12, "both")] and len(warned) == 2
    with pytest.raises(ValueError):
        parse_fasta(">c\nACGT\n")


def test_inference_steps():
    assert infer.heaviest_path({"ACGT": 9, "CGTA": 8, "GTAC": 7, "TACG": 6})[0] == "ACGTACG"
    assert infer.drop_trim("A" * 12 + "CCCC", [100] * 12 + [3] * 4) == "A" * 12
    assert infer.anchor("A" * 32 + "C" * 32, "5") == "A" * 32 and infer.anchor("A" * 32 + "C" * 32, "3") == "C" * 32


def test_inference_recovers_a_noisy_adapter(spark):
    r = np.random.default_rng(8)
    dna = lambda n: "".join(r.choice(list("ACGT"), n))
    front = dna(28)
    noisy = lambda: "".join(c if r.random() > 0.1 else "ACGT"[r.integers(4)] for c in front)
    reads = spark.createDataFrame([(f"r{i:03d}", noisy() + dna(120)) for i in range(500)], "name string, seq string")
    found = infer.infer(reads)
    assert found and found[0].adapter.end == "5" and infer.same(found[0].assembled, front, 0.25)
    clean = spark.createDataFrame([(f"r{i:03d}", dna(200)) for i in range(300)], "name string, seq string")
    assert infer.infer(clean) == []
    assert infer.infer(clean.limit(2)) == []
