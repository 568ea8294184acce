"""Substring deduplication through difference-cover anchors.

A passage of `WINDOW` words that starts earlier elsewhere (smaller doc_id, or the same document
and an earlier start) is removed from where it starts later. {0, 1, 3, 9} is a difference cover
of 13: for any two positions there is a shift below 13 that brings both to a cover position.
So it is enough to hash runs of 20 - 12 = 8 words at positions that are 0, 1, 3 or 9 modulo 13
(four in thirteen): any two equal windows share such an anchor at the same offset.

1. Anchors (44 bits, more for tables above 16 GB) are counted over all documents; most occur once
   and end there. An anchor that two runs share by chance only costs an extension.
2. A window that holds a repeated anchor at a cover position is extended to its whole 20 words,
   which are told apart by 96 bits (64, and 32 from words hashed by other values). Over all documents, the first
   document in which the window occurs becomes its owner.
3. Every window that isn't its owner's first occurrence marks its words for removal.

Anchors and windows go from chunks of documents to buckets of hashes and back (see chunks.py),
distinct within the chunk, so a passage found in a third of all documents is one entry per
chunk and no pair of documents is ever formed.

A null text has no words and is reported with zero words. Of rows with equal doc_id one counts
as the earlier (by place in the table); null doc_ids come after all others. Windows never cross
documents. A text longer than a chunk is a chunk of its own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import Chunk, answered, buckets_for, chunk_table, pack, pack_sorted, slices, unpack, unpack_sorted
from .shared import estimated_bytes, written
from .textops import SPACED, run_hashes, tokens

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
_LAST = (1 << 63) - 1
#: least bits of an anchor, and bits beyond the logarithm of the table's bytes, which keep false repeats under one in a thousand
_BITS, _SPARE = 44, 10


class _Words:
    """The words of a chunk's documents in order of doc_id."""

    def __init__(self, chunk: Chunk, bits: int):
        self.mask = np.uint64((1 << 64) - (1 << (64 - bits)))
        order = sorted(range(len(chunk.ids)), key=lambda i: _LAST if chunk.ids[i] is None else chunk.ids[i])
        self.ids, self.texts = [chunk.ids[i] for i in order], [chunk.texts[i] for i in order]
        self.hashes, self.counts = tokens(self.texts, SPACED, lower=False)
        self.begin = np.cumsum(self.counts) - self.counts

    def starts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Word number and document number of each run of `length` words."""
        n = np.maximum(self.counts - length + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        return self.begin[doc] + within, doc

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, the number of each anchor's key, and where the anchors start."""
        at, doc = self.starts(ANCHOR)
        long = self.counts[doc] >= WINDOW
        on_cover = np.isin((at - self.begin[doc]) % PERIOD, COVER)
        at = at[long & on_cover]
        keys, number = np.unique(run_hashes(self.hashes, ANCHOR)[at] & self.mask, return_inverse=True)
        return keys, number, at

    def candidates(self, number: np.ndarray, at: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and document of each window that holds a repeated anchor."""
        mark = np.zeros(len(self.hashes) + 1, np.int64)
        mark[at[repeated[number] > 0] + 1] = 1
        before = np.cumsum(mark)
        start, doc = self.starts(WINDOW)
        held = before[start + PERIOD] > before[start]
        return start[held], doc[held]

    def windows(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of each window."""
        check, _ = tokens(self.texts, SPACED, lower=False, seed=2)
        return run_hashes(self.hashes, WINDOW)[start], run_hashes(check, WINDOW)[start] >> np.uint64(32)


def _distinct(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct (key, check) in sorted order, and the number of each entry."""
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _found_anchors(words: _Words, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    _, number, at = words.anchors()
    repeated = np.concatenate([np.zeros(0, np.uint64), *(unpack(a["bits"]) for a in answers if a["kind"] == 0)])
    return words.candidates(number, at, repeated)


def _repeated(table: pa.Table) -> pa.Table:
    """A bucket of anchors: for each chunk's keys whether they occur more than once."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    keys = [unpack_sorted(r["keys"]) for r in rows]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(number, np.concatenate([unpack(r["extra"]) for r in rows]).astype(np.float64), minlength=len(distinct))
    return _answers(rows, keys, (total[number] > 1).astype(np.uint64))


def _owners(table: pa.Table) -> pa.Table:
    """A bucket of windows: for each chunk's windows whether their first occurrence is in that chunk."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    keys = [unpack_sorted(r["keys"]) for r in rows]
    first, number = _distinct(np.concatenate(keys), np.concatenate([unpack(r["extra"]) for r in rows]))
    doc = np.concatenate([np.frombuffer(r["ids"], "<i8")[unpack(r["docs"]).astype(np.int64)] for r in rows])
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc)
    mine = np.flatnonzero(doc == least[number])
    owner = np.full(len(first), len(doc))
    np.minimum.at(owner, number[mine], mine)
    bits = np.zeros(len(doc), np.uint64)
    bits[owner] = 1
    return _answers(rows, keys, bits)


def _answers(rows: list[dict], keys: list[np.ndarray], bits: np.ndarray) -> pa.Table:
    ends = np.cumsum([len(k) for k in keys])
    return pa.table({
        "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "kind": pa.array([r["kind"] for r in rows], pa.int32()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
        "bits": pa.array([pack(bits[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)], pa.binary()),
    })


_ANSWER = "chunk bigint, kind int, bucket int, bits binary"


def removals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of each row."""
    buckets = buckets_for(docs)
    bits = min(64, max(_BITS, estimated_bytes(docs).bit_length() + _SPARE))
    chunks = chunk_table(docs, None, text, doc_id)

    def send_anchors(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, number, _ = _Words(Chunk(row), bits).anchors()
                counts = np.minimum(np.bincount(number, minlength=len(keys)), 2).astype(np.uint64)
                parts = list(slices(keys, buckets))
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([row["chunk"]] * len(parts), pa.int64()), "kind": pa.array([0] * len(parts), pa.int32()), "bucket": pa.array([b for b, _, _ in parts], pa.int32()),
                    "keys": pa.array([pack_sorted(keys[i:j]) for _, i, j in parts], pa.binary()), "extra": pa.array([pack(counts[i:j]) for _, i, j in parts], pa.binary()),
                })

    anchors = chunks.mapInArrow(send_anchors, "chunk bigint, kind int, bucket int, keys binary, extra binary")
    repeated = written(anchors.groupBy("bucket").applyInArrow(_repeated, _ANSWER), "repeated")

    def send_windows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = _Words(Chunk(row), bits)
                start, doc = _found_anchors(words, row["answers"] or [])
                if not len(start):
                    continue
                key, check = words.windows(start)
                first, _ = _distinct(key, check)
                key, check, doc = key[first], check[first], doc[first]
                parts = list(slices(key, buckets))
                named = [np.unique(doc[i:j], return_inverse=True) for _, i, j in parts]
                ids = np.array([_LAST if i is None else i for i in words.ids], "<i8")
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([row["chunk"]] * len(parts), pa.int64()), "kind": pa.array([1] * len(parts), pa.int32()), "bucket": pa.array([b for b, _, _ in parts], pa.int32()),
                    "keys": pa.array([pack_sorted(key[i:j]) for _, i, j in parts], pa.binary()), "extra": pa.array([pack(check[i:j]) for _, i, j in parts], pa.binary()),
                    "ids": pa.array([ids[d].tobytes() for d, _ in named], pa.binary()), "docs": pa.array([pack(k.astype(np.uint64)) for _, k in named], pa.binary()),
                })

    columns = ["kind", "bucket", "bits"]
    windows = answered(chunks, repeated, columns).mapInArrow(send_windows, "chunk bigint, kind int, bucket int, keys binary, extra binary, ids binary, docs binary")
    owned = written(windows.groupBy("bucket").applyInArrow(_owners, _ANSWER), "owned")

    def remove(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = _Words(Chunk(row), bits)
                answers = row["answers"] or []
                start, _ = _found_anchors(words, answers)
                key, check = words.windows(start)
                first, number = _distinct(key, check)
                own = np.concatenate([np.zeros(0, np.uint64), *(unpack(a["bits"]) for a in answers if a["kind"] == 1)]) > 0
                stays = np.zeros(len(start), bool)
                stays[first[own]] = True
                late = start[~stays]
                step = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(step, late, 1)
                np.add.at(step, late + WINDOW, -1)
                gone = np.cumsum(step)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[words.begin + words.counts] - total[words.begin]
                kept = []
                for t, b, n, r in zip(words.texts, words.begin, words.counts, removed, strict=True):
                    w = t.split()
                    kept.append(b" ".join(w if not r else [x for x, g in zip(w, gone[b : b + n], strict=True) if not g]))
                for a in range(0, len(kept), 1000):
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(words.ids[a : a + 1000], pa.int64()), "n_words": pa.array(words.counts[a : a + 1000], pa.int64()), "n_removed": pa.array(removed[a : a + 1000], pa.int64()),
                        "kept": pa.array(kept[a : a + 1000], pa.binary()).cast(pa.string()),
                    })

    both = answered(chunks, repeated.unionByName(owned), columns)
    return both.mapInArrow(remove, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def brute_force(docs: list[tuple]) -> list[tuple]:
    """doc_id, n_words, n_removed, sha256 of the kept words, for tests; doc_ids distinct."""
    import re

    seen, gone = {}, {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    for i in sorted(words):
        gone[i] = set()
        for k in range(len(words[i]) - WINDOW + 1):
            if seen.setdefault(tuple(words[i][k : k + WINDOW]), (i, k)) != (i, k):
                gone[i].update(range(k, k + WINDOW))
    return [(i, len(w), len(gone[i]), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone[i]).encode()).hexdigest()) for i, w in words.items()]


ORACLE = r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
runs as (select doc_id, k, array_to_string(w[k:k + 19], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 18)) as k from t)),
late as (select doc_id, k from (select doc_id, k, row_number() over (partition by win order by doc_id, k) as r from runs) where r > 1),
gone as (select distinct doc_id, unnest(range(k, k + 20)) as p from late),
each as (select doc_id, p, word from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from t)),
kept as (select e.doc_id, string_agg(word, ' ' order by e.p) as s, count(*) as n from each e anti join gone g on e.doc_id = g.doc_id and e.p = g.p group by 1)
select t.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256
from t left join kept using (doc_id)"""
