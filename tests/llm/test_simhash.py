import re

import numpy as np
import xxhash
from strandloom.llm import simhash
from strandloom.llm.components import roots

from .helpers import corpus, docs


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def components(prints, ids):
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    named = {r: min((i for i, x in zip(ids, root, strict=True) if x == r and i is not None), default=None) for r in root}
    return [named[r] for r in root]


def test_report_matches_brute_force(spark):
    rows = [*corpus(), (None, "of the", "", "", 0, 0, "", "")]
    prints, ids = [fingerprint(r[1]) for r in rows], [r[0] for r in rows]
    want = sorted(((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, components(prints, ids), strict=True)), key=repr)
    assert sorted(map(tuple, simhash.report(docs(spark, rows)).collect()), key=repr) == want


def test_links_of_dense_and_sparse_fingerprints(spark):
    r = np.random.default_rng(4)
    centre = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = [centre]
    for c in centre:
        for _ in range(30):
            flips = r.choice(64, r.integers(0, 6), replace=False)
            c = c ^ np.uint64(sum(1 << int(b) for b in flips))
            points.append(np.array([c]))
    points = np.unique(np.concatenate([*points, r.integers(0, 1 << 63, 2000, dtype=np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)]))
    label = np.arange(len(points))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    simhash._merge(label, i, j)
    want = {(int(points[k]), int(points[label[k]])) for k in range(len(points)) if label[k] != k}
    a, b = simhash.forest(points, leaf=20)
    assert {(int(x), int(y)) for x, y in zip(a, b, strict=True)} == want
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp bigint")
    got = roots(simhash.links(df, shard=40)).collect()
    by = {r.node: r.root for r in got}
    same = {}
    for k in range(len(points)):
        same.setdefault(label[k], set()).add(int(points[k : k + 1].view(np.int64)[0]))
    for group in same.values():
        assert {by.get(x, x) for x in group} == {min(group)}


def least_labels(n, i, j):
    """The least node of each node's component, by union-find."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_merge_cuts_no_node_from_its_root():
    i, j = np.array([(0, 5), (1, 2), (2, 3), (3, 4), (3, 7), (3, 8), (4, 5), (4, 6), (5, 6), (7, 8)]).T
    label = np.arange(9)
    simhash._merge(label, i, j)
    assert label.tolist() == [0] * 9


def test_forests_of_chains_match_union_find():
    r = np.random.default_rng(12)
    for n in [50] * 40 + [100] * 20 + [250] * 10:
        points = [r.integers(0, 1 << 64, dtype=np.uint64)]
        for _ in range(n - 1):
            points.append(points[-1] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, 3, replace=False))))
        points = np.unique(np.array(points, np.uint64))
        want = least_labels(len(points), *np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3))
        for leaf in (256, 20):
            child, parent = (np.searchsorted(points, x) for x in simhash.forest(points, leaf=leaf))
            assert len(child) == len(set(child.tolist())) and least_labels(len(points), child, parent) == want


def test_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}}
    assert roots(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_empty(spark):
    assert simhash.report(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_stage_judges_rows(spark):
    words = [f"w{i}" for i in range(60)]
    one, near, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(reversed(words))
    rows = [(1, one), (5, near), (5, other), (7, "T u v w x y"), (7, "T u v w x y"), (None, one), (None, "quite alone in this table of rows"), (8, None), (9, "")]
    df = spark.createDataFrame([(*r, k, "n", "i", "r") for k, r in enumerate(rows)], "doc_id bigint, text string, n int, node string, id string, row string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == sorted([(1, one), (5, other), (7, "T u v w x y"), (None, "quite alone in this table of rows"), (8, None)], key=repr)
    assert sorted(r.doc_id for r in simhash.keep_one(df.where("doc_id in (1, 7)").dropDuplicates(["doc_id"])).collect()) == [1, 7]
