"""Links between documents whose sets of word shingles are similar, for the near-dedup stage.

Fingerprints of 64 bits tell copies with a word or two changed from the rest, but at a Jaccard
similarity of 0.8 they differ in about ten bits, where no tree prunes. So candidates come from
the sets themselves, and every candidate is verified on the whole sets:

* A set of up to `SMALL` shingles is entered under its least hashes, n - ceil(t n) + 1 of them
  (prefix filtering: two sets of similarity t or more share one).
* A longer set is entered under `PARTS` signatures, each the sum of its hashes in one narrow
  range of hash values that holds `PER_PART` of them on average. A range is wider for smaller
  sets: widths go by size classes of ratio 1/t, and a set is entered under its own class and
  the next, so that sets of similar sizes meet. At similarity t a range is free of differences
  with probability of about 1/e, so all ranges differ with one of about 0.0006.

Of the sets with equal entries two, others for each entry, are pivots, and the rest are paired
with them: a group of n copies gives fewer than 102 n pairs, most of them repeats. Where the rest
of an entry is not one component after that, its sets are compared with each other, in pairs of
blocks of about `BLOCK` sets; only links between components leave a pair of blocks. So any two
similar documents that meet are linked, directly or through others. That costs up to n^2 / 2
comparisons for an entry with n loosely similar documents, shared out among pairs of blocks.
Documents with equal sets are one node.

Null doc_ids and texts without words are left out. Rows of one doc_id are one document. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import roots
from .shared import written
from .textops import SPACED, as_bytes, run_hashes, splitmix, tokens

SHINGLE = 5
SIMILARITY = 0.8
SMALL = 72
PARTS = 16
PER_PART = 4.5
BLOCK = 256
_OTHER = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of k words (fewer words: the whole sequence)."""
    hashes, counts = tokens(texts, SPACED, lower=True)
    out, at = [], 0
    for n in counts.tolist():
        words, at = hashes[at : at + n], at + n
        out.append(np.unique(run_hashes(words, min(k, n)) if n else words))
    return out


def _parts(s: np.ndarray, size_class: int, t: float) -> np.ndarray:
    width = min(int(PER_PART * t**size_class * 2.0**64), ((1 << 64) - 1) // PARTS)
    bounds = np.concatenate([[0], np.searchsorted(s, np.array([width * i for i in range(1, PARTS + 1)], np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(s[: bounds[-1]]), dtype=np.uint64)])
    names = splitmix(np.arange(PARTS, dtype=np.uint64) + np.uint64(PARTS * (size_class + 1)))
    return splitmix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ names)[np.diff(bounds) > 0]


def entries(s: np.ndarray, t: float = SIMILARITY) -> np.ndarray:
    """What a set is entered under."""
    n, found = len(s), []
    if n * t <= SMALL:
        found.append(splitmix(s[: n - math.ceil(t * n - 1e-9) + 1]))
    if n > SMALL:
        own = math.floor(math.log(n) / -math.log(t))
        found += [_parts(s, own, t), _parts(s, own + 1, t)]
    return np.unique(np.concatenate(found))


def _key(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return np.array([splitmix(s).sum(dtype=np.uint64), splitmix(s ^ _OTHER).sum(dtype=np.uint64)]).tobytes()


def _index(rows: DataFrame, k: int, t: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            kept = [(i, s) for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(as_bytes(batch.column("text")), k), strict=True) if len(s)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([i for i, _ in kept], pa.int64()), "key": pa.array([_key(s) for _, s in kept], pa.binary()),
                "entries": pa.array([entries(s, t).view(np.int64) for _, s in kept], pa.list_(pa.int64())),
            })

    return rows.mapInArrow(run, "doc_id bigint, key binary, entries array<bigint>")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(as_bytes(batch.column("text")), k)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return rows.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def _compare(nodes: np.ndarray, label: np.ndarray, block: np.ndarray, sets: list[np.ndarray], t: float) -> tuple[list, list]:
    """Links of pairs of similarity t or more that join different labels: of two blocks pairs across them, of one all pairs.

    A set can only be similar to another if at least t of its shingles are in others, so the rest is left out first."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    across = len(np.unique(block)) > 1
    while len(order):
        owner = np.repeat(np.arange(len(order)), size[order])
        _, token, times = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
        shared = times[token] > 1
        held = np.bincount(owner[shared], minlength=len(order))
        able = held >= (t - 1e-9) * size[order]
        if able.all():
            break
        order = order[able]
    if len(order) < 2:
        return [], []
    nodes, label, block, size, token = nodes[order], label[order].copy(), block[order], size[order], token[shared]
    ends = np.concatenate([[0], np.cumsum(held)])
    mark = np.zeros(len(times), bool)
    a, b = [], []
    for i, upto in enumerate(np.searchsorted(size, size / (t - 1e-9), side="right").tolist()):
        apart = label[i + 1 : upto] != label[i]
        if across:
            apart &= block[i + 1 : upto] != block[i]
        if not apart.any():
            continue
        own = token[ends[i] : ends[i + 1]]
        mark[own] = True
        at = ends[i + 1 : upto + 1] - ends[i + 1]
        common = np.diff(np.concatenate([[0], np.cumsum(mark[token[ends[i + 1] : ends[upto]]])])[at])
        mark[own] = False
        hits = i + 1 + np.flatnonzero(apart & (common >= (t - 1e-9) * (size[i] + size[i + 1 : upto] - common)))
        found, first = np.unique(label[hits], return_index=True)
        a += [nodes[i]] * len(found)
        b += nodes[hits[first]].tolist()
        label[np.isin(label, found)] = label[i]
    return a, b


def _rest(entered: DataFrame, pivots: DataFrame, sets: DataFrame, linked: DataFrame, t: float, size: int) -> DataFrame:
    """a, b: links between the components (linked) of what is no pivot of its entry."""

    def within(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        found = [np.asarray(x) for x in table.column("shingles").to_pandas()]
        a, b = _compare(column("node"), column("root"), column("block"), found, t)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    members = entered.join(pivots.hint("merge"), "entry").where("node <> first and node <> last").select("entry", "node")
    members = members.join(linked.hint("merge"), "node", "left").select("entry", "node", F.coalesce("root", "node").alias("root"))
    members = written(members, "shingle_rest")
    apart = members.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    apart = apart.select("entry", F.ceil(F.col("n") / size).alias("blocks"))
    dealt = members.join(apart.hint("merge"), "entry").withColumn("block", F.pmod(F.xxhash64("node", "entry"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("entry", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "root", "block")
    dealt = dealt.join(sets.withColumnRenamed("doc_id", "node").hint("merge"), "node")
    return dealt.groupBy("entry", "low", "high").applyInArrow(within, "a bigint, b bigint").distinct()


def links(docs: DataFrame, k: int = SHINGLE, t: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """a, b: links of doc_ids that connect documents of similarity t or more; see above."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    index = written(_index(rows, k, t), "shingle_index")
    nodes = written(index.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("entries").alias("entries")), "shingle_nodes")
    same = index.select("key", "doc_id").join(nodes.select("key", "node").hint("merge"), "key").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    entered = nodes.select("node", F.explode("entries").alias("entry"))
    # the exclusive or with the entry puts the nodes of each entry in an order of its own; both ends of it are pivots
    order = F.col("node").bitwiseXOR(F.col("entry"))
    ends = entered.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("least"), F.max(order).alias("most")).where("n > 1")
    pivots = written(ends.select("entry", F.col("least").bitwiseXOR(F.col("entry")).alias("first"), F.col("most").bitwiseXOR(F.col("entry")).alias("last")), "shingle_pivots")
    met = entered.join(pivots.hint("merge"), "entry").select("node", F.explode(F.array("first", "last")).alias("pivot")).where("node <> pivot")
    pairs = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    pairs = written(pairs.distinct(), "shingle_pairs")
    members = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = written(_sets(rows.join(members.hint("merge"), "doc_id", "left_semi"), k), "shingle_sets")
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"{name}_set")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
    similar = both.where(F.col("common") >= (t - 1e-9) * (F.size("a_set") + F.size("b_set") - F.col("common"))).select("a", "b")
    first = written(same.union(similar), "shingle_links")
    return first.union(_rest(entered, pivots, sets, roots(first), t, block))
