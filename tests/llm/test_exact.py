import hashlib
import re

import numpy as np
from strandloom.llm import exact

from .helpers import corpus, docs


def want(rows):
    norm = [(r[0], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "").encode()).hexdigest()) for r in rows]
    ids, sizes = {}, {}
    for i, h in norm:
        sizes[h] = sizes.get(h, 0) + 1
        if i is not None:
            ids[h] = min(ids.get(h, i), i)
    return sorted(((i, ids.get(h), sizes[h], i is not None and i == ids.get(h), h) for i, h in norm), key=repr)


def test_table_matches_brute_force(spark):
    rows = [*corpus(), (None, "the of", None, None, None, None, None, None), (None, "lonely", None, None, None, None, None, None)]
    assert sorted(map(tuple, exact.dedup_table(docs(spark, rows)).collect()), key=repr) == want(rows)


def test_snapshot_and_batch(spark):
    rows = corpus()
    got = exact.dedup(docs(spark, rows[::2]), docs(spark, rows[1::2]))
    assert sorted(map(tuple, got.collect()), key=repr) == want(rows)


def test_empty(spark):
    assert exact.dedup_table(docs(spark, [])).count() == 0
    assert exact.dedup(docs(spark, []), docs(spark)).count() == len(corpus())


def test_filter_has_no_false_negative():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 500, 40_000):
        keys = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        f = exact.FuseFilter.build(keys)
        assert f.contains(keys).all()
        others = r.integers(1 << 63, (1 << 64) - 1, 50_000, dtype=np.uint64)
        assert f.contains(others).mean() < 0.001


def test_stage_judges_rows(spark):
    rows = [(1, "alpha beta gamma"), (5, "alpha  beta\ngamma"), (5, "a wholly different unique text"), (7, "T"), (7, "T"), (None, "T"), (None, "lone"), (None, "lone"), (8, None), (9, ""), (None, None)]
    df = spark.createDataFrame([(*r, k, "d", "i", "r") for k, r in enumerate(rows)], "doc_id bigint, text string, n int, digest string, id string, row string")
    got = exact.keep_first(df)
    assert got.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == sorted([(1, "alpha beta gamma"), (5, "a wholly different unique text"), (7, "T"), (None, "lone"), (8, None)], key=repr)
    assert exact.keep_first(docs(spark, [])).count() == 0
    awkward = exact.keep_first(docs(spark)).collect()
    assert sorted((r.doc_id for r in awkward)) == sorted({r[0] for r in want(corpus()) if r[3]})


def test_digests_are_grouped_once(spark):
    """The two aggregates left in the plan are those of the byte check."""
    out = exact.dedup(docs(spark), docs(spark))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
