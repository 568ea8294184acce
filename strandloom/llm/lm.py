"""Language-model scoring by deleted interpolation.

The model mixes three estimates of a word after its predecessor: uniform, unigram and bigram
maximum likelihood. The mixture weights depend on how often the predecessor occurs (buckets of
doubling frequency) and are learned by expectation-maximisation on deleted counts: each
training token is held out of the counts that predict it (its own occurrence is subtracted).
The E-step needs only the two ratios of a token's estimates, so the tokens are summed in a
histogram of fixed size (half-octave bins, each with its mean ratios), which alone goes to the driver.

Counts cover all training documents (crc32 of doc_id as text, modulo 5, is not 1). Words are
identified by 64-bit hashes and bigrams by 48-bit ones; with 10^8 bigrams one in about three
million shares its count with another.

A null text is empty and has one token, the end. A null doc_id counts as empty text for the
fold. Rows with equal doc_id are scored and counted one by one. A text longer than a chunk is a
chunk of its own, scored whole. Extra columns are ignored; an
empty table gives an empty result, and without training documents only the uniform part is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import Chunk, answered, buckets_for, chunk_table, pack, pack_sorted, slices, unpack, unpack_sorted
from .quality import fold
from .shared import written
from .textops import SPACED, splitmix, tokens

HELD_OUT_FOLD = 1
ROUNDS = 60
LEVELS = 48
_END = np.uint64(0x7F4A7C159E3779B9)
_BIGRAM_MASK = np.uint64(~((1 << 16) - 1) & (1 << 64) - 1)


class _Tokens:
    """The tokens of a chunk, their predecessors' numbers, and distinct words and bigrams."""

    def __init__(self, chunk: Chunk):
        hashes, counts = tokens(chunk.texts, SPACED, lower=True)
        ends = np.cumsum(counts)
        stream = np.insert(hashes, ends, _END)
        self.counts = counts + 1
        self.doc = np.repeat(np.arange(len(counts)), self.counts)
        before = np.roll(stream, 1)
        if len(before):
            before[0] = _END
        pairs = splitmix(splitmix(before) + stream) & _BIGRAM_MASK
        self.words, self.word = np.unique(stream, return_inverse=True)
        self.bigrams, self.bigram = np.unique(pairs, return_inverse=True)
        self.previous = np.roll(self.word, 1)
        if len(stream):
            self.previous[0] = np.searchsorted(self.words, _END)
        self.train = chunk.flags[self.doc] if len(stream) else np.zeros(0, bool)

    def sent(self):
        """kind, keys and training counts of the two statistics."""
        for kind, keys, number in ((0, self.words, self.word), (1, self.bigrams, self.bigram)):
            yield kind, keys, np.bincount(number, self.train, minlength=len(keys)).astype(np.uint64)


def _totals(table: pa.Table) -> pa.Table:
    """One bucket: for each chunk's keys the counts over all chunks; n and v are the bucket's sums."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    keys = [unpack_sorted(r["keys"]) for r in rows]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(number, np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.float64), minlength=len(distinct)).astype(np.uint64)
    ends = np.cumsum([len(k) for k in keys])
    kind, bucket = rows[0]["kind"], rows[0]["bucket"]
    first = [int(total.sum()), int(np.count_nonzero(total))]
    return pa.table({
        "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "kind": pa.array([kind] * len(rows), pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()),
        "totals": pa.array([pack(total[number[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)], pa.binary()),
        "n": pa.array([first[0]] + [0] * (len(rows) - 1), pa.int64()), "v": pa.array([first[1]] + [0] * (len(rows) - 1), pa.int64()),
    })


def _counted(row: dict) -> tuple[Chunk, _Tokens, np.ndarray, np.ndarray]:
    """A chunk with the corpus counts of its distinct words and bigrams."""
    chunk = Chunk(row)
    t = _Tokens(chunk)
    cat = lambda kind: np.concatenate([np.zeros(0, np.uint64), *(unpack(a["totals"]) for a in row["answers"] if a["kind"] == kind)]).astype(np.int64)
    return chunk, t, cat(0), cat(1)


def _level(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + log2 of its frequency, rounded down."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, LEVELS - 1), 0)


def _half_octave(x: np.ndarray) -> np.ndarray:
    """0 for 0, else 100 + twice log2, rounded down."""
    return np.where(x > 0, np.clip(np.floor(2 * np.log2(np.where(x > 0, x, 1))) + 100, 1, 199), 0).astype(np.int64)


def weights(histogram: list[tuple[int, float, float, int]], n: int, v: int) -> np.ndarray:
    """Mixture weights (uniform, unigram, bigram) by context level, from (level, mean unigram count, mean bigram ratio, tokens)."""
    out = np.tile([0.1, 0.4, 0.5], (LEVELS, 1))
    out[0] = [0.2, 0.8, 0.0]
    if n < 2 or not histogram:
        out[:] = [1.0, 0.0, 0.0]
        return out
    level, one, two, count = (np.array(x, kind) for x, kind in zip(zip(*histogram, strict=True), (np.int64, float, float, float), strict=True))
    parts = np.stack([np.full(len(level), 1 / (v + 1)), one / (n - 1), two], axis=1)
    for _ in range(ROUNDS):
        share = out[level] * parts
        share *= (count / share.sum(axis=1))[:, None]
        mass = np.stack([np.bincount(level, share[:, k], minlength=LEVELS) for k in range(3)], axis=1)
        total = mass.sum(axis=1, keepdims=True)
        out = np.where(total > 0, (mass + [1e-3, 1e-3, 0]) / (total + 2e-3), out)
    # a level without tokens takes the weights of the next lower one
    for k in range(1, LEVELS):
        if not np.any(level == k):
            out[k] = out[k - 1]
    return out


class Model:
    """Corpus counts, answered chunk by chunk, and mixture weights."""

    def __init__(self, counted: DataFrame, n: int, v: int, mix: np.ndarray):
        self.counted, self.n, self.v, self.mix = counted, n, v, mix


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Count words and bigrams over all training documents and learn the weights."""
    buckets = buckets_for(docs)
    chunks = chunk_table(docs, fold(F.col(doc_id)) != HELD_OUT_FOLD, text, doc_id)

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                for kind, keys, counts in _Tokens(chunk).sent():
                    parts = list(slices(keys, buckets))
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([chunk.chunk] * len(parts), pa.int64()), "kind": pa.array([kind] * len(parts), pa.int32()), "bucket": pa.array([b for b, _, _ in parts], pa.int32()),
                        "keys": pa.array([pack_sorted(keys[i:j]) for _, i, j in parts], pa.binary()), "counts": pa.array([pack(counts[i:j]) for _, i, j in parts], pa.binary()),
                    })

    sent = chunks.mapInArrow(send, "chunk bigint, kind int, bucket int, keys binary, counts binary")
    totals = sent.groupBy("kind", "bucket").applyInArrow(_totals, "chunk bigint, kind int, bucket int, totals binary, n bigint, v bigint")
    totals = written(totals, "totals")
    whole = totals.where("kind = 0").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = whole.n or 0, whole.v or 0
    counted = written(answered(chunks, totals, ["kind", "bucket", "totals"]), "counted")

    def tally(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, t, words, bigrams = _counted(row)
                use = t.train
                context = words[t.previous[use]] - 1
                one = words[t.word[use]] - 1
                two = np.where(context > 0, np.maximum(bigrams[t.bigram[use]] - 1, 0) / np.maximum(context, 1), 0)
                code, number, count = np.unique((_level(context) * 200 + _half_octave(one)) * 200 + _half_octave(two), return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_pydict({"code": pa.array(code, pa.int64()), "tokens": pa.array(count, pa.int64()), "one": pa.array(np.bincount(number, one), pa.float64()), "two": pa.array(np.bincount(number, two), pa.float64())})

    found = counted.mapInArrow(tally, "code bigint, tokens bigint, one double, two double").groupBy("code").agg(*(F.sum(c).alias(c) for c in ("tokens", "one", "two"))).collect()
    histogram = [(r.code // 40000, r.one / r.tokens, r.two / r.tokens, r.tokens) for r in sorted(found)]
    return Model(counted, n, v, weights(histogram, n, v))


def scored(model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document counted by the model."""
    n, v, mix = model.n, model.v, model.mix

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk, t, words, bigrams = _counted(row)
                c = words[t.word]
                context = words[t.previous]
                w = mix[_level(context)]
                p = w[:, 0] / (v + 1) + w[:, 1] * c / max(n, 1) + w[:, 2] * bigrams[t.bigram] / np.maximum(context, 1)
                base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                add = lambda x, t=t, chunk=chunk: np.bincount(t.doc, x, minlength=len(chunk.ids))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(chunk.ids, pa.int64()), "held_out": pa.array(~chunk.flags), "n_tokens": pa.array(t.counts, pa.int64()), "n_known": pa.array(add(c > 0).astype(np.int64)),
                    "train_tokens": pa.array([n] * len(chunk.ids), pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(p))),
                })

    return model.counted.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

