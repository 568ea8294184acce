import math
import re
import zlib
from collections import Counter

import pytest
from strandloom.llm import chunks, lm

from .helpers import corpus, docs
from .test_repeats import thue_morse


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\0"]


def brute(rows, mix):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    w = [words(r[1]) for r in rows]
    train = [x for x, r in zip(w, rows, strict=True) if not held(r[0])]
    c, b = Counter(x for t in train for x in t), Counter(p for t in train for p in zip(["\0", *t], t))
    n, v = sum(c.values()), len(c)
    level = lambda k: min(int(math.log2(k)) + 1, lm.LEVELS - 1) if k else 0
    out = []
    for r, t in zip(rows, w, strict=True):
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        score = sum(math.log10(mix[level(c[u])][0] / (v + 1) + mix[level(c[u])][1] * c[x] / max(n, 1) + mix[level(c[u])][2] * b[u, x] / max(c[u], 1)) for u, x in zip(["\0", *t], t))
        out.append((r[0], held(r[0]), len(t), sum(c[x] > 0 for x in t), n, base, score))
    return out


def test_counts_and_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chunks, "chunk_bytes", lambda df: 500)
    rows = [*corpus(), (None, "a b c", "", "", 0, 0, "", "")]
    model = lm.train(docs(spark, rows))
    got = sorted(map(tuple, lm.scored(model).collect()), key=repr)
    want = sorted(brute(rows, model.mix), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-6)


def test_model_beats_its_base_on_held_out_text(spark):
    model = lm.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = lm.scored(model).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert abs(model.mix.sum(axis=1) - 1).max() < 1e-9


def test_empty(spark):
    assert lm.scored(lm.train(docs(spark, []))).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm.scored(lm.train(docs(spark, [(held, "a b", "", "", 0, 0, "", "")]))).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_words_that_polynomials_confuse(spark):
    one, two = thue_morse()
    rows = [(i, f"{one} a {one} b" if i % 2 else f"{two} a c", "", "", 0, 0, "", "") for i in range(40)]
    model = lm.train(docs(spark, rows))
    got, want = sorted(map(tuple, lm.scored(model).collect())), sorted(brute(rows, model.mix))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def expected_mix(rows, rounds=lm.ROUNDS):
    """Weights by level from expectation-maximisation over every training token, each taken out of its own counts."""
    train = [words(r[1]) for r in rows if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 != 1]
    c, b = Counter(x for t in train for x in t), Counter(p for t in train for p in zip(["\0", *t], t))
    n, v = sum(c.values()), len(c)
    parts = {}
    for t in train:
        for u, x in zip(["\0", *t], t):
            k = c[u] - 1
            level = int(math.log2(k)) + 1 if k else 0
            parts.setdefault(level, []).append((1 / (v + 1), (c[x] - 1) / (n - 1), (b[u, x] - 1) / k if k else 0.0))
    out = {}
    for level, found in parts.items():
        w = [0.1, 0.4, 0.5] if level else [0.2, 0.8, 0.0]
        for _ in range(rounds):
            mass = [0.0, 0.0, 0.0]
            for p in found:
                share = [a * q for a, q in zip(w, p, strict=True)]
                for k in range(3):
                    mass[k] += share[k] / sum(share)
            w = [m / len(found) for m in mass]
        out[level] = (w, len(found))
    return out


def test_weights_match_expectation_maximisation(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    model = lm.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = expected_mix(rows)
    assert len(want) > 5
    for level, (w, n) in want.items():
        if n > 200:
            assert model.mix[level] == pytest.approx(w, abs=0.03), level
