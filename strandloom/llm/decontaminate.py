"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed in shards of a few MB. A shard stores, for every training token, the
sorted list of its positions (one term-major array of composite keys, so that a posting list
is a slice); the shards are a table in the shared folder. A benchmark phrase is looked up by
taking the posting list of its rarest term in the shard, shifting it to phrase starts, and
intersecting it with the offset-adjusted lists of the other terms in order of rising document
frequency. With `slop` > 0 a term may be that many words off its place, which gives proximity
matches. Terms are told apart by 64-bit hashes.

Shards hold whole documents, so no posting is shuffled and a passage found in a third of all
documents loads no task more than any other. Benchmark phrases are broadcast in blocks of at
most `block_bytes` of text, and a task searches its shards for one block; where there are
several, what they found in a shard is put together by shard.

Nulls: a null text has no words; a null benchmark text has no phrase. Rows with equal or null
doc_id are judged one by one, repeated rows alike. A longer text than a shard is a shard of its
own. Extra columns are ignored (`decontaminate` passes them through). Empty tables give empty
results; with no benchmark nothing is contaminated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import written
from .textops import ALNUM, as_bytes, pieces, tokens

WINDOW = 8
MIN_ITEMS = 2
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 32 << 20
_CANDIDATES = 1 << 20

#: words that a term of a proximity match may be off its place
SLOP = 1

INDEX_SCHEMA = "shard bigint, doc_ids array<bigint>, n_words binary, terms binary, bounds binary, postings binary"


class Phrases:
    """Benchmark windows: a token stream, and start, length and item of each window."""

    def __init__(self, item_ids: list, texts: list[bytes], window: int):
        self.item_ids = item_ids
        self.tokens, counts = tokens(texts, ALNUM, lower=True)
        starts, lengths, items = [], [], []
        at = 0
        for item, n in enumerate(counts):
            k = max(1, n - window + 1) if n else 0
            starts.append(np.arange(at, at + k))
            lengths.append(np.full(k, min(n, window)))
            items.append(np.full(k, item))
            at += n
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.starts, self.lengths, self.items = cat(starts), cat(lengths), cat(items)


class Shard:
    """The positional index of some documents, laid end to end."""

    def __init__(self, n_words: np.ndarray, terms: np.ndarray, bounds: np.ndarray, postings: np.ndarray):
        self.n_words, self.terms, self.bounds, self.postings = n_words, terms, bounds, postings
        self.ends = np.cumsum(n_words)
        self.span = int(self.ends[-1]) + 1 if len(n_words) else 1
        ranks = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(bounds))
        self.keys = ranks * self.span + postings

    @classmethod
    def build(cls, texts: list[bytes]) -> Shard:
        hashes, n_words = tokens(texts, ALNUM, lower=True)
        order = np.argsort(hashes, kind="stable")
        terms, first = np.unique(hashes[order], return_index=True)
        return cls(n_words, terms, np.append(first, len(hashes)).astype(np.int64), order.astype(np.int64))

    def matches(self, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Window number and start position of each occurrence."""
        if not len(self.terms) or not len(phrases.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = np.searchsorted(self.terms, phrases.tokens)
        rank[rank == len(self.terms)] = 0
        known = self.terms[rank] == phrases.tokens
        missing = np.concatenate([[0], np.cumsum(~known)])
        windows = np.flatnonzero(missing[phrases.starts + phrases.lengths] == missing[phrases.starts])
        frequency = np.diff(self.bounds)
        found_w, found_p = [], []
        for length in np.unique(phrases.lengths[windows]):
            group = windows[phrases.lengths[windows] == length]
            ranks = rank[phrases.starts[group][:, None] + np.arange(length)]
            rarest_first = np.argsort(frequency[ranks], axis=1, kind="stable")
            weight = np.take_along_axis(frequency[ranks], rarest_first[:, :1], 1)[:, 0]
            cuts = np.flatnonzero(np.diff(np.cumsum(weight) // _CANDIDATES, prepend=0))
            for part in np.split(np.arange(len(group)), cuts):
                if len(part):
                    w, p = self._intersect(ranks[part], rarest_first[part], slop)
                    found_w.append(group[part[w]])
                    found_p.append(p)
        if not found_w:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_w), np.concatenate(found_p)

    def _intersect(self, ranks: np.ndarray, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(ranks))
        head = ranks[rows, order[:, 0]]
        size = self.bounds[head + 1] - self.bounds[head]
        w = np.repeat(rows, size)
        within = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        at = self.postings[self.bounds[head][w] + within]
        starts = at - order[w, 0]
        # a phrase and the words that are off their places lie in the document of its rarest term
        doc = np.searchsorted(self.ends, at, side="right")
        first, last = self.ends[doc] - self.n_words[doc], self.ends[doc] - 1
        keep = (starts >= first) & (starts + ranks.shape[1] - 1 <= last)
        w, starts, first, last = w[keep], starts[keep], first[keep], last[keep]
        for k in range(1, ranks.shape[1]):
            if not len(w):
                break
            offset = order[w, k]
            base = ranks[w, offset] * self.span
            want = starts + offset
            low = base + np.maximum(want - slop, first)
            high = base + np.minimum(want + slop, last)
            at = np.searchsorted(self.keys, low)
            hit = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= high)
            w, starts, first, last = w[hit], starts[hit], first[hit], last[hit]
        return w, starts


def _shards(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, Shard]]:
    texts = as_bytes(batch.column(text))
    for a, b in pieces(texts, SHARD_BYTES):
        yield a, b, Shard.build(texts[a:b])


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per shard: its number, doc ids, words per document, terms, and the bounds and positions of their postings."""

    def build(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, s in _shards(batch, "text"):
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([number], pa.int64()), "doc_ids": pa.array([ids.slice(a, b - a).to_pylist()], pa.list_(pa.int64())), "n_words": [s.n_words.astype("<i8").tobytes()], "terms": [s.terms.astype("<u8").tobytes()],
                    "bounds": [s.bounds.astype("<i8").tobytes()], "postings": [s.postings.astype("<i4" if s.span < 1 << 31 else "<i8").tobytes()],
                })
                number += 1

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(build, INDEX_SCHEMA)


def _stored(row: dict) -> Shard:
    read = lambda k, kind: np.frombuffer(row[k], kind).astype(np.int64)
    n_words = read("n_words", "<i8")
    return Shard(n_words, np.frombuffer(row["terms"], "<u8"), read("bounds", "<i8"), read("postings", "<i4" if n_words.sum() + 1 < 1 << 31 else "<i8"))


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The benchmark's windows in blocks whose texts are block_bytes together, or one longer text."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    ids, texts, held = [], [], 0
    for row in items.toLocalIterator():
        raw = row.text.encode()
        if held and held + len(raw) > block_bytes:
            yield Phrases(ids, texts, window)
            ids, texts, held = [], [], 0
        ids.append(row.item_id)
        texts.append(raw)
        held += len(raw)
    yield Phrases(ids, texts, window)


def phrase_matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, item_id, start (word number in the document), n_words: exact or, with slop, proximity matches."""
    found = None
    for phrases in phrase_blocks(benchmark, window):
        shipped = index.sparkSession.sparkContext.broadcast(phrases)

        def search(batches, shipped=shipped):
            q = shipped.value
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    s = _stored(row)
                    w, p = s.matches(q, slop)
                    doc = np.searchsorted(s.ends, p, side="right")
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([row["doc_ids"][d] for d in doc], pa.int64()), "item_id": pa.array([q.item_ids[i] for i in q.items[w]], pa.int64()),
                        "start": pa.array(p - (s.ends - s.n_words)[doc], pa.int64()), "n_words": pa.array(q.lengths[w], pa.int64()),
                    })

        part = index.mapInArrow(search, "doc_id bigint, item_id bigint, start bigint, n_words bigint")
        found = part if found is None else found.union(part)
    return found


def _items(s: Shard, q: Phrases, w: np.ndarray, p: np.ndarray) -> list[list]:
    """By document, the items whose windows w occur at p."""
    items: list[list] = [[] for _ in s.n_words]
    pairs = np.unique(np.stack([np.searchsorted(s.ends, p, side="right"), q.items[w]]), axis=1)
    for d, i in pairs.T:
        items[d].append(q.item_ids[i])
    return items


def _spans(p: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the spans [p, e), as sorted spans that don't overlap; those that touch, as at the end of a document, stay apart."""
    if not len(p):
        return p, e
    order = np.argsort(p, kind="stable")
    p, e = p[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], p[1:] >= e[:-1]])
    return p[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(e) - 1]])]


#: what a search yields, and a row of the report
_LISTS = "array<array<bigint>>"
_FOUND = f"shard bigint, doc_ids array<bigint>, n_words binary, starts binary, ends binary, items {_LISTS}, near {_LISTS}"
_REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<bigint>, near array<bigint>"


def _reported(rows: list[dict]) -> pa.RecordBatch:
    """A row per document of a shard, from what each block of phrases found in it."""
    n_words = np.frombuffer(rows[0]["n_words"], "<i8")
    p, e = _spans(*(np.concatenate([np.frombuffer(r[k], "<i8") for r in rows]) for k in ("starts", "ends")))
    last = np.cumsum(n_words)
    hit = np.bincount(np.searchsorted(last, p, side="right"), e - p, minlength=len(n_words)).astype(np.int64)
    joined = lambda k: [sorted({x for r in rows for x in r[k][d] if x is not None}, key=str) for d in range(len(n_words))]
    items = joined("items")
    lists = lambda x: pa.array(x, pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(rows[0]["doc_ids"], pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items": lists(items), "near": lists(joined("near"))})


def _search(batches, q: Phrases, slop: int) -> Iterator[dict]:
    """What a block of phrases finds in each shard of the index."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            s = _stored(row)
            w, p = s.matches(q)
            starts, ends = _spans(p, p + q.lengths[w])
            near = s.matches(q, slop) if slop else (w, p)
            yield {"shard": row["shard"], "doc_ids": row["doc_ids"], "n_words": row["n_words"], "starts": starts.astype("<i8").tobytes(), "ends": ends.astype("<i8").tobytes(), "items": _items(s, q, w, p), "near": _items(s, q, *near)}


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, the sorted ids of the items that occur in it, and
    in `near` of those with proximity matches (an exact match is one, too)."""
    index = stored_index(docs, text, doc_id)
    blocks = [docs.sparkSession.sparkContext.broadcast(p) for p in phrase_blocks(benchmark, window)]
    if len(blocks) == 1:
        return index.mapInArrow(lambda batches, q=blocks[0]: (_reported([found]) for found in _search(batches, q.value, slop)), _REPORT)
    kind = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("n_words", "starts", "ends")), *((k, pa.list_(pa.list_(pa.int64()))) for k in ("items", "near"))])

    def part(shipped):
        return index.mapInArrow(lambda batches: (pa.RecordBatch.from_pylist([found], kind) for found in _search(batches, shipped.value, slop)), _FOUND)

    found = reduce(DataFrame.union, map(part, blocks))
    return found.groupBy("shard").applyInArrow(lambda table: pa.Table.from_batches([_reported(table.to_pylist())]), _REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no whole window of `window` benchmark words and fewer than min_items items.

    One passage of a benchmark is enough to drop a document. An item of fewer words than a window (a
    name, say) is no passage, so it only counts towards min_items, as in op10's `contaminated`."""
    blocks = [docs.sparkSession.sparkContext.broadcast(p) for p in phrase_blocks(benchmark, window)]

    def run(batches):
        for batch in batches:
            keep = []
            for _, _, s in _shards(batch, text):
                items, whole = [set() for _ in s.n_words], np.zeros(len(s.n_words), bool)
                for shipped in blocks:
                    q = shipped.value
                    w, p = s.matches(q)
                    whole[np.searchsorted(s.ends, p[q.lengths[w] == window], side="right")] = True
                    for mine, more in zip(items, _items(s, q, w, p), strict=True):
                        mine.update(more)
                keep += [len(x) < min_items and not y for x, y in zip(items, whole, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def stored_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The index as a table in the shared folder."""
    return written(build_index(docs, text, doc_id), "index")


def digest_columns(report: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    joined = F.array_join(F.transform("items", lambda x: x.cast("string")), ",")
    return report.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined, 256).alias("items_sha256"), (F.col("n_items") >= min_items).alias("contaminated"), F.size("near").cast("bigint").alias("n_near"))


def brute_words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same report by plain scanning, for tests."""
    wanted: dict[tuple, set] = {}
    for item, t in items:
        w = brute_words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[k : k + window]), set()).add(item)
    sizes = {len(k) for k in wanted}
    out = []
    for doc, t in docs:
        w, hit, found = brute_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (got := wanted.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= MIN_ITEMS))
    return out
