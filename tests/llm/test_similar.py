import random
import re

import numpy as np
from strandloom.llm import similar, simhash

from . import test_simhash
from .helpers import corpus, docs


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def close(a, b):
    return bool(a) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def edited(seed=5):
    """Texts of 6 to 900 words, each with copies that have some words changed or are cut."""
    r, rows = random.Random(seed), []
    for size in (6, 12, 20, 40, 70, 76, 80, 95, 120, 200, 400, 900):
        for _ in range(6):
            words = [f"w{r.randrange(5000)}" for _ in range(size)]
            rows.append(" ".join(words))
            for _ in range(3):
                copy = words[: size - r.randrange(max(1, size // 8))]
                for _ in range(r.randrange(1 + size // 30)):
                    copy[r.randrange(len(copy))] = "changed"
                rows.append(" ".join(copy))
    return [(i, t, "en", "s", len(t), 0, "", "") for i, t in enumerate(rows)]


def joined(ids, linked):
    root = {i: i for i in ids}
    for a, b in linked:
        x, y = root[a], root[b]
        if x != y:
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def test_sets_and_entries():
    s = similar.shingle_sets([b"", b" \n", b"A b", b"a  B", b"a b c d e f", b"a b c d e"])
    assert [len(x) for x in s] == [0, 0, 1, 1, 2, 1] and s[2] == s[3] and s[5][0] in s[4]
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 72, 73, 90, 91, 5000):
        assert 1 <= len(similar.entries(np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)))) <= 51


def test_links_match_brute_force(spark):
    rows = edited()
    sets = [shingles(r[1]) for r in rows]
    want = {(i, j) for j in range(len(rows)) for i in range(j) if close(sets[i], sets[j])}
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in similar.links(docs(spark, rows)).collect()}
    assert len(want) > 100 and got <= want
    assert joined(range(len(rows)), got) == joined(range(len(rows)), want)


def star(copies, edits, size, seed):
    """A text of size words and copies of it, each with words changed at places of its own."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(size)]
    texts, seen = [words], set()
    while len(texts) <= copies:
        places = tuple(sorted(edits(r)))
        if places not in seen:
            seen.add(places)
            texts.append([f"c{len(texts)}" if i in places else w for i, w in enumerate(words)])
    r.shuffle(texts)
    return [(i, " ".join(t), "en", "s", 0, 0, "", "") for i, t in enumerate(texts)], [i for i, t in enumerate(texts) if t == words][0]


def test_stars_whose_copies_are_only_similar_to_their_source(spark):
    large = star(1000, lambda r: r.sample(range(5, 300, 5), 6), 304, 1)
    small = star(150, lambda r: (r.randrange(4, 63), *r.choice([(0, 66), (1,), (65,)])), 67, 2)
    for (rows, source), copies in ((large, 1000), (small, 150)):
        sets = [shingles(r[1]) for r in rows]
        assert len(rows) == copies + 1 and all(close(sets[source], s) for s in sets)
        assert sum(close(sets[i], sets[j]) for i in range(0, 60) for j in range(i) if source not in (i, j)) < 30
        got = [(r.a, r.b) for r in similar.links(docs(spark, rows), block=64).collect()]
        assert all(close(sets[a], sets[b]) for a, b in got)
        assert set(joined(range(len(rows)), got).values()) == {0}


def test_compare_matches_brute_force():
    r = np.random.default_rng(3)
    for blocks in (1, 2):
        sets = [np.unique(r.integers(0, 40, r.integers(1, 40))) for _ in range(150)]
        sets += [s[r.random(len(s)) > 0.1] for s in sets[:100]]
        sets = [s for s in sets if len(s)]
        n = len(sets)
        label, block, held = r.integers(0, n, n), r.integers(0, blocks, n), [set(s.tolist()) for s in sets]
        pairs = [(i, j) for j in range(n) for i in range(j) if (blocks == 1 or block[i] != block[j]) and close(held[i], held[j])]
        same = [(i, int(np.flatnonzero(label == label[i])[0])) for i in range(n)]
        a, b = similar._compare(np.arange(n), label, block, sets, 0.8)
        got = list(zip(map(int, a), b, strict=True))
        assert {(min(x), max(x)) for x in got} <= set(pairs) and len(got) < n
        assert joined(range(n), got + same) == joined(range(n), pairs + same)


def test_keep_one_of_awkward_rows(spark):
    rows = [*corpus(), (None, "of the", "", "", 0, 0, "", "")]
    rows += [(1000 + r[0], *r[1:]) for r in edited()[:80]]
    ids, sets = [r[0] for r in rows], [shingles(r[1]) for r in rows]
    first = test_simhash.components([test_simhash.fingerprint(r[1]) for r in rows], ids)
    linked = [(i, c) for i, c in zip(ids, first, strict=True) if i is not None]
    linked += [(ids[i], ids[j]) for j in range(len(rows)) for i in range(j) if close(sets[i], sets[j]) and None not in (ids[i], ids[j])]
    root = joined({i for i in ids if i is not None}, linked)
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    # of the repeated rows of a doc_id one stays
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({i for i in ids if i is not None and root[i] == i})
    assert kept.where("doc_id is null").count() == 1
    assert similar.links(docs(spark, [])).count() == 0
