"""Quality classifier: Naive Bayes features under a linear SVM (NB-SVM).

Features are indicators of n-grams, hashed into a fixed table: byte bigrams, words, and 1- to
4-grams of word shapes (letter case, digits, signs at the end, repetition of the word before,
language-independent). Each indicator is scaled by the log-ratio of its smoothed frequencies
in the two classes, and dual coordinate descent fits a hinge-loss linear model to the scaled
features. Margins become probabilities by a logistic curve fitted to out-of-fold margins.

The classifier is fitted to at most `TRAIN_ROWS` labelled rows, those whose doc_id has the
least hash; rows in the held-out fold (crc32 of doc_id as text, modulo 5, is 0) are never
used. Executors turn them to features and one task fits the model; the driver gets its weights alone. Label, lang, source and doc_id are not features. All rows are scored over whole texts.

Nulls count as empty texts and are scored by the bias alone. Labels that are null or not 0/1
are ignored; of several labels of a document the largest counts. With a single class the
score is that class's share; with no label at all it is 0.5. Repeated rows get the same score
(of a repeated doc_id all rows with a label train the model); texts of any length are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .textops import SPACED, as_bytes, pieces, splitmix, word_hashes, word_spans

TRAIN_ROWS = 6000
FOLDS = 5
THRESHOLD = 0.3
BITS = 18
EPOCHS = 12
COST = 0.05
_SIZE = 1 << BITS
#: bytes of a word's last sign; others fall into one class
_LAST = np.zeros(256, np.int64)
for _rank, _sign in enumerate(b".,!?;:#$%&*|-\"')/_=", 2):
    _LAST[_sign] = _rank
_LAST[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def fold(doc_id):
    """crc32 of the doc_id as text, modulo FOLDS; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    def count(mask):
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[ends] - total[starts]

    upper, lower = count((raw >= 65) & (raw <= 90)), count(((raw >= 97) & (raw <= 122)) | (raw >= 128))
    digits, n = count((raw >= 48) & (raw <= 57)), ends - starts
    letters = upper + lower
    case = np.where(letters == 0, 0, np.where(upper == 0, 1, np.where((upper >= 2) & (2 * upper > letters), 3, 2)))
    signs = np.minimum(n - letters - digits, 4)
    again = np.concatenate([[0], ((words[1:] == words[:-1]) & (doc[1:] == doc[:-1])).astype(np.int64)]) if len(words) else np.zeros(0, np.int64)
    return (((case * 2 + (digits > 0)) * 5 + signs) * 32 + _LAST[raw[ends - 1]]) * 2 + again


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document number, feature) pairs, in order of document and feature."""
    docs, found = [], []
    for a, b in pieces(texts, 1 << 19):
        raw = np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a)
        doc_of = np.repeat(np.arange(a, b, dtype=np.int64), lengths)
        starts, ends = word_spans(raw, SPACED)
        words = word_hashes(raw, starts, ends)
        doc = doc_of[starts]
        bigrams = raw[:-1].astype(np.int64) * 256 + raw[1:]
        inside = doc_of[:-1] == doc_of[1:]
        keys = [(doc_of[:-1] << BITS)[inside] + bigrams[inside]]
        shapes = _shapes(raw, starts, ends, words, doc).astype(np.uint64)
        keys.append((doc << BITS) + (1 << 17) + (words >> np.uint64(47)).astype(np.int64))
        gram = shapes
        for n in range(1, 5):
            same = doc[n - 1 :] == doc[: len(doc) - n + 1]
            mixed = splitmix(gram + np.uint64(n)) >> np.uint64(64 - 16)
            keys.append(((doc[: len(doc) - n + 1] << BITS) + (1 << 16) + mixed.astype(np.int64))[same])
            if n < 4 and len(shapes) > n:
                gram = splitmix(gram[: len(shapes) - n]) + shapes[n:]
            else:
                break
        found.append(np.unique(np.concatenate(keys)))
    all_keys = np.concatenate(found) if found else np.zeros(0, np.int64)
    return all_keys >> BITS, all_keys & (_SIZE - 1)


class Model:
    """Weights by feature; scores are logistic in the margin."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def margins(self, texts: list[bytes]) -> np.ndarray:
        doc, feature = features(texts)
        n = np.bincount(doc, minlength=len(texts))
        total = np.bincount(doc, self.weights[feature].astype(np.float64), minlength=len(texts))
        return total / np.sqrt(np.maximum(n, 1)) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def _svm(rows: list[np.ndarray], y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Scaled-indicator hinge loss by dual coordinate descent; weights per indicator and bias."""
    seen = np.zeros((2, _SIZE))
    for x, label in zip(rows, y, strict=True):
        seen[int(label > 0), x] += 1
    share = (seen + 1) / (np.array([[np.sum(y <= 0)], [np.sum(y > 0)]]) + 2)
    ratio = np.log(share[1] / share[0])
    w, bias, alpha, rng = np.zeros(_SIZE), 0.0, np.zeros(len(rows)), np.random.default_rng(5)
    values = [ratio[x] / np.sqrt(max(len(x), 1)) for x in rows]
    norms = np.array([v @ v + 1 for v in values])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            slack = y[i] * (values[i] @ w[rows[i]] + bias) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w * ratio, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with the smoothed targets of Platt's scaling."""
    n1, n0 = np.sum(y > 0), np.sum(y <= 0)
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, v = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[np.sum(v * margin * margin) + 1e-6, np.sum(v * margin)], [np.sum(v * margin), np.sum(v) + 1e-6]])
        step = np.linalg.solve(h, [np.sum(g * margin), np.sum(g)])
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """rows: the distinct features of each document."""
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or len(set(y)) == 1:
        share = (np.sum(y > 0) + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(np.zeros(_SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    cost = np.where(y > 0, len(y) / (2 * np.sum(y > 0)), len(y) / (2 * np.sum(y <= 0))) * COST
    part = np.arange(len(y)) % 3
    margin = np.zeros(len(y))
    for k in range(3):
        use = np.flatnonzero(part != k)
        if len(set(y[use])) < 2:
            continue
        w, bias = _svm([rows[i] for i in use], y[use], cost[use])
        for i in np.flatnonzero(part == k):
            margin[i] = w[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1)) + bias
    w, bias = _svm(rows, y, cost)
    return Model(w, bias, *_logistic(margin, y))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit to at most `rows` labelled rows outside the held-out fold."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    picked = marked.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    order = F.xxhash64("doc_id").alias("hash"), F.col("doc_id"), F.xxhash64("text").alias("tie")
    ranked = sample.select(F.struct(*order).alias("place"), "label", "text")

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            doc, feature = features(texts)
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
            yield pa.RecordBatch.from_pydict({"place": batch.column("place"), "label": batch.column("label"), "features": lists})

    def fitted(batches):
        found, marks = [], []
        for batch in batches:
            lists = batch.column("features")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            found += [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            marks.append(batch.column("label").to_numpy())
        model = fit(found, np.concatenate(marks).astype(np.int64) if marks else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_pylist([{"weights": model.weights.tobytes(), "bias": float(model.bias), "slope": model.slope, "shift": model.shift}])

    kind = ranked.select("place", "label").schema.add("features", T.ArrayType(T.IntegerType()))
    # at most 2 ** BITS features a row, however long its text; one task fits the model, and the driver gets its weights alone
    got = ranked.mapInArrow(run, kind).orderBy("place").limit(rows).select("label", "features").mapInArrow(fitted, "weights binary, bias double, slope double, shift double").collect()
    if not got:  # no row at all, not even a task
        return fit([], np.zeros(0))
    return Model(np.frombuffer(got[0].weights, np.float32), got[0].bias, got[0].slope, got[0].shift)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(shipped.value.scores(as_bytes(batch.column("text"))), pa.float64())})

    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score at least threshold."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shipped.value.scores(as_bytes(batch.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
