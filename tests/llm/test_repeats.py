import hashlib

from strandloom.llm import chunks, repeats

from .helpers import corpus, docs


def result(spark, rows):
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in repeats.removals(docs(spark, rows)).collect())


def test_cover():
    for a in range(repeats.PERIOD):
        for b in range(repeats.PERIOD):
            assert any((a + s) % 13 in repeats.COVER and (b + s) % 13 in repeats.COVER for s in range(13))


def test_matches_brute_force_over_many_chunks(spark, monkeypatch):
    rows = corpus()[:-2]
    passage = " ".join(f"shared{i}" for i in range(33))
    rows += [(200 + i, f"only{i} a b {passage} end{i} " + ("x y z " * i), "", "", 0, 0, "", "") for i in range(12)]
    rows += [(400, passage + " " + passage, "", "", 0, 0, "", "")]
    want = sorted(repeats.brute_force([r[:2] for r in rows]))
    assert result(spark, rows) == want and sum(r[2] for r in want) > 100
    monkeypatch.setattr(chunks, "chunk_bytes", lambda df: 300)
    assert result(spark, rows[::-1]) == want


def test_repeated_rows_null_ids_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(25))
    null = (None, text, "", "", 0, 0, "", "")
    got = result(spark, [(1, text, "", "", 0, 0, "", ""), (1, text, "", "", 0, 0, "", "")])
    assert sorted(r[2] for r in got) == [0, 25]
    removed = {(r.doc_id, r.n_removed) for r in repeats.removals(docs(spark, [null, (9, text, "", "", 0, 0, "", "")])).collect()}
    assert removed == {(None, 25), (9, 0)}
    assert result(spark, []) == []


def test_packing():
    import numpy as np

    r = np.random.default_rng(0)
    for top in (1, 200, 1 << 20, 1 << 40, (1 << 64) - 1):
        x = np.sort(r.integers(0, top, 1000, dtype=np.uint64, endpoint=True))
        assert (chunks.unpack(chunks.pack(x)) == x).all() and (chunks.unpack_sorted(chunks.pack_sorted(x)) == x).all()
        assert sum(j - i for _, i, j in chunks.slices(x, 64)) == 1000


def thue_morse(n=1024):
    """Two words whose polynomial hashes modulo a power of two are equal for every odd base."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_that_polynomials_confuse(spark):
    one, two = thue_morse()
    same = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{same} {one}"), (2, f"{same} {two}"), (3, f"{same} {two} end"), (4, " ".join([one, two] * 15)), (5, " ".join([two, one] * 15))]
    want = repeats.brute_force(rows)
    got = repeats.removals(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == sorted(want)
    assert [r[2] for r in want[:3]] == [0, 0, 20]


def test_hashes_of_words_and_runs():
    import numpy as np
    from strandloom.llm import textops

    r = np.random.default_rng(6)
    words = ["".join(r.choice(list("ab"), r.integers(1, 200))) for _ in range(300)] + ["é" * 90, "q" * 70000, "a", "b"]
    words += words[::-1]
    text = " ".join(words).encode()
    for seed in (1, 2):
        hashes, counts = textops.tokens([text, b"", text], textops.SPACED, lower=False, seed=seed)
        assert counts.tolist() == [len(words), 0, len(words)] and dict(zip(words, hashes.tolist(), strict=False)) == dict(zip(words, hashes[len(words) :].tolist(), strict=True))
        assert len(set(hashes.tolist())) == len(set(words))
    values = textops.splitmix(r.integers(0, 3, 4000).astype(np.uint64))
    for n in (1, 2, 3, 5, 7, 8, 20):
        runs = textops.run_hashes(values, n)
        seen = {tuple(values[i : i + n].tolist()): int(x) for i, x in enumerate(runs)}
        assert len(runs) == 4001 - n and len(set(runs.tolist())) == len(seen) and all(seen[tuple(values[i : i + n].tolist())] == x for i, x in enumerate(runs.tolist()))
    assert len(textops.run_hashes(values[:4], 5)) == 0
