import os
import zlib

import numpy as np
from strandloom.llm import quality

from .helpers import corpus, docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(documents, quality.train(documents, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50
    assert (got.predicted == got.quality).mean() > 0.95
    assert (got[got.quality == 1].predicted == 1).mean() > 0.97
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]


def test_awkward_rows_and_labels(spark):
    kind = "doc_id bigint, quality int, toxic int, text string"
    labels = spark.createDataFrame([(i, None if i == 5 else i % 2 if i < 40 else 7, 0, "clash") for i in range(50)] + [(2, 0, 0, ""), (None, 1, 0, "")], kind)
    got = quality.scored(docs(spark), quality.train(docs(spark), labels)).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    same = {r.score for r in got if r.doc_id in (60, 61, 62)}
    assert len({r[1] for r in corpus() if r[0] in (60, 61)}) == 2 and len(same) <= 2
    one = quality.train(docs(spark), labels.where("quality = 1"))
    assert 0.5 < one.scores([b"x"])[0] < 1
    none = quality.train(docs(spark), labels.limit(0))
    assert none.scores([b"", b"a"]).tolist() == [0.5, 0.5]
    assert quality.scored(docs(spark, []), none).count() == 0
    assert quality.keep_good(docs(spark), none).columns == docs(spark).columns


def test_a_score_depends_on_its_text_alone(spark):
    model = quality.Model(np.random.default_rng(1).normal(size=quality._SIZE), 0.1, 1.0, 0.0)
    texts = [(r[1] or "").encode() for r in corpus()]
    together, alone = model.margins(texts), np.concatenate([model.margins([t]) for t in texts])
    assert np.allclose(together, alone)


def test_features_are_those_of_each_text():
    texts = [(r[1] or "").encode() for r in corpus()]
    doc, feature = quality.features(texts)
    for i, t in enumerate(texts[:80]):
        mine = feature[doc == i]
        bigrams = {t[k] * 256 + t[k + 1] for k in range(len(t) - 1)}
        # a text's last byte and the line end that closes it are no bigram of it
        assert {x for x in mine.tolist() if x < 1 << 16} == bigrams | ({t[-1] * 256 + 10} if t else set())
        assert sum(x >= 1 << 17 for x in mine.tolist()) <= len(set(t.split())) <= sum(x >= 1 << 17 for x in mine.tolist()) + 3
        assert (sum(1 << 16 <= x < 1 << 17 for x in mine.tolist()) > 0) == bool(t.split())


def test_weights_match_a_plain_solver(monkeypatch):
    """Class log-count ratios counted in dictionaries; the hinge-loss dual by projected gradient over a dense table."""
    r = np.random.default_rng(8)
    n, size = 40, 25
    rows = [np.flatnonzero(r.random(size) < 0.3) for _ in range(n)]
    y = np.where(r.random(n) < 0.4, 1.0, -1.0)
    cost = np.where(y > 0, 0.7, 0.4)
    seen = {(k, c): 1 for k in range(size) for c in (0, 1)}
    for x, label in zip(rows, y, strict=True):
        for k in x.tolist():
            seen[k, int(label > 0)] += 1
    total = [int((y <= 0).sum()) + 2, int((y > 0).sum()) + 2]
    ratio = np.array([np.log(seen[k, 1] / total[1]) - np.log(seen[k, 0] / total[0]) for k in range(size)])
    table = np.zeros((n, size))
    for i, x in enumerate(rows):
        table[i, x] = ratio[x] / np.sqrt(max(len(x), 1))
    q = (table @ table.T + 1) * y[:, None] * y[None, :]
    alpha = np.zeros(n)
    for _ in range(40_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    monkeypatch.setattr(quality, "EPOCHS", 3000)
    w, bias = quality._svm(rows, y, cost)
    assert np.allclose(w[:size], (table.T @ (alpha * y)) * ratio, atol=2e-3) and abs(bias - (alpha * y).sum()) < 2e-3
    assert not w[size:].any()


def test_logistic_curve_is_the_likeliest():
    r = np.random.default_rng(9)
    margin = r.normal(size=400)
    y = np.where(margin + r.normal(size=400) > 0.3, 1.0, -1.0)
    a, b = quality._logistic(margin, y)
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda a, b: np.sum(np.logaddexp(0, a * margin + b) - target * (a * margin + b))
    assert all(loss(a, b) <= loss(a + da, b + db) for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def test_a_task_fits_the_model(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, quality int")
    got = quality.train(docs(spark), labels)
    picked = {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}
    rows = docs(spark).where("doc_id is not null").selectExpr("doc_id", "text", "xxhash64(doc_id) as hash", "xxhash64(text) as tie").collect()
    rows = sorted((r for r in rows if r.doc_id in picked), key=lambda r: (r.hash, r.doc_id, r.tie))
    want = quality.fit([quality.features([(r.text or "").encode()])[1] for r in rows], np.array([r.doc_id % 2 for r in rows]))
    assert np.array_equal(got.weights, want.weights) and (got.bias, got.slope, got.shift) == (want.bias, want.slope, want.shift)
    monkeypatch.setattr(quality, "fit", lambda rows, labels: quality.Model(np.zeros(1), os.getpid(), 1.0, 0.0))
    assert quality.train(docs(spark), labels).bias != os.getpid()
