"""SimHash near-duplicates through vantage-point trees.

A document's fingerprint has a bit set where over half of its shingles' XXH64 values have it.
Distinct fingerprints are dealt to shards by a vantage-point tree: a node sends a fingerprint
inside or outside by its Hamming distance to the vantage point, and one on the inner side
within the search radius of the boundary goes to the outer side too. By the triangle
inequality each pair within the radius then meets in some shard. A shard grows its own
vantage-point tree down to small leaves in the same way and compares the pairs of a leaf.
Only the links of a spanning forest leave a shard, so a group of n copies gives under n links
per shard, not n^2, and components of distinct fingerprints are found by star contraction.

The tree above the shards is fitted to a sample, the distinct fingerprints with the least hash:
`SAMPLE`, or 16 for each shard if that is more. Shards and the points in them grow with the
square root of the fingerprints. Every fingerprint is indexed, and the search is exact for any
tree. Distances of unrelated fingerprints lie close together, so at radius 3 a split sends about a
quarter of its points to both sides: of random fingerprints each is in about six shards up to
some millions, and the number of shards a point is in then grows with that of shards to a power
of about 0.4.

Nulls and empty texts have fingerprint zero, linked like any other. Rows with equal doc_id are
fingerprinted one by one; texts of any length are read whole. component_id ignores null doc_ids and is null if no other is
reachable. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import similar
from .components import roots
from .shared import written
from .textops import as_bytes

SHINGLE = 3
RADIUS = 3
SEED = 42
SAMPLE = 16384
#: least points of a shard, and points of a shard for each root of their number
SHARD = 16384
PER_ROOT = 32
LEAF = 1024
_TRIES = 12
#: points of a node to which a split is fitted
_SEEN = 1024


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit integer) of each row."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, k) for t in as_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(prints.view(np.int64))})

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def choose(points: np.ndarray, radius: int, rng) -> tuple | None:
    """The vantage point and boundary, of some tries, whose larger child is smallest; None if no split helps."""
    seen = points if len(points) <= _SEEN else points[rng.integers(0, len(points), _SEEN)]
    tries = np.unique(seen[rng.integers(0, len(seen), _TRIES)])
    at = np.bitwise_count(tries[:, None] ^ seen[None, :]).astype(np.int64) + 65 * np.arange(len(tries))[:, None]
    upto = np.bincount(at.ravel(), minlength=65 * len(tries)).reshape(-1, 65).cumsum(axis=1)
    outside = np.full((len(tries), 64), len(seen))
    outside[:, radius:] -= upto[:, : 64 - radius]
    larger = np.where(upto[:, :64] < len(seen), np.maximum(upto[:, :64], outside), len(seen))
    k, mu = divmod(int(larger.argmin()), 64)
    return (larger[k, mu], tries[k], mu) if larger[k, mu] < 0.9 * len(seen) else None


def divide(points: np.ndarray, v, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of what goes inside and outside; what goes to both lies inside, within radius of the boundary."""
    d = _distance(points, v)
    return d <= mu, d > mu - radius


class Tree:
    """Vantage points above the shards."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int):
        self.radius, self.nodes, self.shards = radius, [], 0
        rng = np.random.default_rng(7)
        # the children of a split hold more than their parent, so there are about twice as many shards
        self._grow(sample, max(8, 4 * len(sample) // max(shards, 1)), rng)

    def _grow(self, sample: np.ndarray, cap: int, rng) -> int:
        here = len(self.nodes)
        self.nodes.append(None)
        picked = choose(sample, self.radius, rng) if len(sample) > cap else None
        if picked is None:
            self.nodes[here] = (self.shards,)
            self.shards += 1
        else:
            _, v, mu = picked
            inside, outside = divide(sample, v, mu, self.radius)
            self.nodes[here] = (v, mu, self._grow(sample[inside], cap, rng), self._grow(sample[outside], cap, rng))
        return here

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and point, once for each shard that a point belongs to."""
        shard, point, todo = [], [], [(0, points)]
        while todo:
            at, p = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                shard.append(np.full(len(p), node[0]))
                point.append(p)
            elif len(p):
                v, mu, left, right = node
                inside, outside = divide(p, v, mu, self.radius)
                todo += [(left, p[inside]), (right, p[outside])]
        return np.concatenate(shard), np.concatenate(point)


def _find(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Roots of x, to which x points from then on."""
    root = label[x]
    while not np.array_equal(up := label[root], root):
        root = up
    label[x] = root
    return root


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the ends of each pair the least label of their components, in place.

    Only roots are hooked, so no node is ever cut from its old root."""
    ends = np.concatenate([i, j])
    while len(i):
        a, b = _find(label, i), _find(label, j)
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    _find(label, ends)


def _compare(points: np.ndarray, at: np.ndarray, label: np.ndarray, radius: int, block: int = 128) -> None:
    """Merge the labels of all linked pairs of some points, whose numbers are `at`.

    Points that are one component already aren't compared with each other, so points too close
    together for a split, whose first block links nearly all of them, take few comparisons each."""
    for a in range(0, len(points), block):
        mine = _find(label, at[a : a + block])
        rest = np.arange(a, len(points))
        if (mine == mine[0]).all():
            rest = rest[_find(label, at[rest]) != mine[0]]
        for b in range(0, len(rest), 1 << 16):
            part = rest[b : b + (1 << 16)]
            i, j = np.nonzero(np.bitwise_count(points[a : a + block, None] ^ points[None, part]) <= radius)
            other = part[j] != a + i
            if other.any():
                _merge(label, at[a + i[other]], at[part[j[other]]])


def forest(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over distinct points, pairs within radius being linked."""
    points = np.unique(points)
    label, rng, todo = np.arange(len(points)), np.random.default_rng(11), [np.arange(len(points))]
    while todo:
        at = todo.pop()
        p = points[at]
        picked = choose(p, radius, rng) if len(p) > leaf else None
        if picked is not None:
            inside, outside = divide(p, picked[1], picked[2], radius)
            todo += [at[inside], at[outside]]
            continue
        _compare(p, at, label, radius)
    _find(label, np.arange(len(points)))
    child = np.flatnonzero(label != np.arange(len(points)))
    return points[child], points[label[child]]


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect all within radius."""
    spark = prints.sparkSession
    prints = prints.distinct()
    n = prints.count()
    shards = max(64, math.ceil(n / max(shard, PER_ROOT * math.sqrt(n))))
    sample = np.array([r.fp for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, 16 * shards)).collect()], np.int64).view(np.uint64)
    shipped = spark.sparkContext.broadcast(Tree(sample, shards, radius))

    def route(batches):
        for batch in batches:
            where, p = shipped.value.route(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(where, pa.int64()), "fp": pa.array(p.view(np.int64))})

    def within(table: pa.Table) -> pa.Table:
        a, b = forest(table.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return prints.mapInArrow(route, "shard bigint, fp bigint").groupBy("shard").applyInArrow(within, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) of each row."""
    prints = written(fingerprints(docs, k, text, doc_id), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    linked = roots(links(classes.select("fp"), radius))
    rooted = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, all columns, with one row of each group of near-duplicates: that of the smallest doc_id.

    Documents are linked by their fingerprints, as in near_duplicates, and by sets of five-word
    shingles with a similarity of 0.8 or more (see similar.py), which fingerprints don't reach.
    Rows are judged one by one, also those that share a doc_id. Rows without a doc_id come after all
    others, and of rows with equal doc_id in a group any one stays."""
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    # doc_ids name rows if they are distinct; else the rows are numbered, in a table that holds the numbers fixed
    if docs.groupBy(F.col(doc_id).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty():
        rows, named = rows.withColumn("node", F.col("id")), True
    else:
        rows, named = written(rows.withColumn("node", F.monotonically_increasing_id()), "numbered"), False
    texts = rows.select("node", "text")
    close = near_duplicates(texts, doc_id="node").where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    linked = roots(close.union(similar.links(texts, doc_id="node")))
    if not named:
        members = linked.union(linked.select("root", "root").distinct()).join(rows.select("node", "id").hint("merge"), "node")
        first = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("first"))
        linked = members.join(first, "root").where("node <> first.node")
    return rows.join(linked.select("node").hint("merge"), "node", "left_anti").select("row.*")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
