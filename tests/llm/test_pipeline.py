import os

import corpus_pipeline as p
from strandloom.llm import quality

from . import test_similar, test_simhash
from .helpers import corpus, docs
from .test_exact import want as exact_groups
from .test_decontaminate import uncontaminated

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in documents.collect()}
    docs = p.STAGES[0][1](spark, documents, SF)
    model = quality.train(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {i: r for i, r in rows.items() if model.scores([(r.text or "").encode()])[0] >= quality.THRESHOLD}
    assert {r.doc_id for r in docs.collect()} == set(good) and docs.columns == documents.columns
    docs = p.STAGES[1][1](spark, docs, SF)
    first = {g[0]: good[g[0]] for g in exact_groups([tuple(r) for r in good.values()]) if g[3]}
    assert {r.doc_id for r in docs.collect()} == set(first) and docs.columns == documents.columns
    docs = p.STAGES[2][1](spark, docs, SF)
    ids = sorted(first)
    sets = [test_similar.shingles(first[i].text) for i in ids]
    linked = list(zip(ids, test_simhash.components([test_simhash.fingerprint(first[i].text) for i in ids], ids), strict=True))
    linked += [(ids[i], ids[j]) for j in range(len(ids)) for i in range(j) if test_similar.close(sets[i], sets[j])]
    lone = {i: first[i] for i, g in test_similar.joined(ids, linked).items() if i == g}
    assert {r.doc_id for r in docs.collect()} == set(lone) and docs.columns == documents.columns
    docs = p.STAGES[3][1](spark, docs, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = uncontaminated([(i, r.text) for i, r in lone.items()], items)
    assert 0 < len(clean) < len(lone)
    assert {r.doc_id for r in docs.collect()} == clean and docs.columns == documents.columns
    last = p.run(spark, SF).collect()
    assert {r.doc_id for r in last} == clean and len({r.position for r in last}) == len(last)
    assert os.path.exists(p.__file__)


def test_stages_take_awkward_rows(spark, tmp_path):
    rows = [*corpus(), (None, "the of", None, None, 0, 0, "", ""), (3, "an own text under the doc_id of another row", "en", "src9", 0, 0, "", "")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(rows[10][1].split()[:12])), (2, None), (3, "of")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in p.STAGES[1:4]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == before.columns, name
        kept = [tuple(r) for r in after.collect()]
        texts = {r[1] for r in kept}
        assert any("an own text" in (t or "") for t in texts) and 0 < len(kept) < len(rows) + 1
        before = after
    last = p.run(spark, str(tmp_path)).collect()
    assert len({r.position for r in last}) == len(last)
    empty = docs(spark, [])
    for _, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
