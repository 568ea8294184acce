"""Exact deduplication against immutable snapshots screened by binary-fuse filters.

Texts are equal when identical after every run of space and \\t..\\r is replaced by one space.
A snapshot's distinct digests are dealt into buckets of bounded size, and each bucket gets a
static three-wise binary-fuse filter with 16-bit fingerprints. An incoming batch is grouped by
digest on its own first (so a text that fills a third of it is one row from then on); its
distinct digests are screened by their bucket's filter. Negatives are new. Positives join the
snapshot's exact buckets, and the bytes of the two normalised texts are compared before they
count as one. Of equal texts the smallest doc_id stays.

Nulls: a null text counts as empty; null doc_ids belong to a group but never keep it unless
the group has no other (then keep_id is null and no row is kept). Repeated rows with the same
doc_id count once each in group_size, and all rows of the kept doc_id are kept. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import written
from .textops import splitmix

BUCKET_KEYS = 100_000
_SEEDS = 100


class FuseFilter:
    """A static filter of distinct 64-bit keys; no false negatives, 2**-16 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, slots: np.ndarray):
        self.seed, self.segment, self.segments, self.slots = seed, segment, segments, slots

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = splitmix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64), (splitmix(h) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peel in rounds: every slot that one key alone uses frees that key; assign in reverse."""
        n = len(keys)
        segment = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        segments = max(1, math.ceil(n * factor / segment) - 2)
        length = (segments + 2) * segment
        for seed in range(1, _SEEDS):
            places, prints = cls._places(keys, seed, segment, segments)
            used = np.bincount(places.ravel(), minlength=length)
            owners = np.zeros(length, np.int64)
            number = np.arange(n)
            for row in places:
                np.bitwise_xor.at(owners, row, number)
            order, left = [], n
            while left:
                single = np.flatnonzero(used == 1)
                if not len(single):
                    break
                freed, which = np.unique(owners[single], return_index=True)
                order.append((freed, single[which]))
                for row in places[:, freed]:
                    np.subtract.at(used, row, 1)
                    np.bitwise_xor.at(owners, row, freed)
                left -= len(freed)
            if not left:
                slots = np.zeros(length, np.uint16)
                for freed, slot in reversed(order):
                    slots[slot] = 0
                    a, b, c = places[:, freed]
                    slots[slot] = prints[freed] ^ slots[a] ^ slots[b] ^ slots[c]
                return cls(seed, segment, segments, slots)
        raise ValueError("no binary-fuse filter was found: keys are not distinct")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self._places(keys, self.seed, self.segment, self.segments)
        return (self.slots[a] ^ self.slots[b] ^ self.slots[c]) == prints


def normalised(text):
    """Each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("digest"))


def _keyed(groups: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("digest")
    return groups.withColumn("key", key).withColumn("bucket", F.pmod(F.shiftrightunsigned(key, 40), F.lit(buckets)))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """bucket, seed, segment, segments, slots: a filter for each bucket of a snapshot's digests."""

    def build(table: pa.Table) -> pa.Table:
        f = FuseFilter.build(np.unique(table.column("key").to_numpy().view(np.uint64)))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "slots": [f.slots.astype("<u2").tobytes()]})

    return _keyed(groups, buckets).select("bucket", "key").groupBy("bucket").applyInArrow(build, "bucket bigint, seed bigint, segment bigint, segments bigint, slots binary")


def screened(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """digest of those rows of groups that a snapshot's filter lets through."""

    def screen(key, rows: pa.Table, filters: pa.Table) -> pa.Table:
        if not rows.num_rows or not filters.num_rows:
            return rows.select(["digest"]).slice(0, 0)
        x = filters.to_pylist()[0]
        f = FuseFilter(x["seed"], x["segment"], x["segments"], np.frombuffer(x["slots"], "<u2"))
        return rows.select(["digest"]).filter(pa.array(f.contains(rows.column("key").to_numpy().view(np.uint64))))

    left = _keyed(groups, buckets).select("bucket", "key", "digest")
    return left.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(screen, "digest string")


def dedup(snapshot: DataFrame, batch: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of either: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = lambda df: df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    snapshot, batch = texts(snapshot), texts(batch)
    seen = written(digests(snapshot).withColumn("old", F.lit(True)).unionByName(digests(batch).withColumn("old", F.lit(False))), "digests")
    # read five times below: without the table each time would group anew, and each of a plan's stages costs the driver a buffer of spark.broadcast.blockSize
    sides = written(seen.groupBy("old", "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "groups")
    old, new = (sides.where(F.col("old") == x).drop("old") for x in (True, False))
    buckets = max(64, math.ceil(seen.count() / BUCKET_KEYS))
    hits = screened(new, snapshot_filters(old, buckets), buckets).join(new, "digest").join(old.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n")), "digest")
    hits = written(hits, "hits")
    # the bytes of the two representatives of each positive, side by side
    ends = hits.select("digest", F.col("keep_id").alias("doc_id"), F.lit(False).alias("old")).unionByName(hits.select("digest", F.col("old_id").alias("doc_id"), F.lit(True).alias("old")))
    both = snapshot.withColumn("old", F.lit(True)).unionByName(batch.withColumn("old", F.lit(False))).where(F.col("doc_id").isNotNull())
    bytes_of = both.join(ends.hint("merge"), ["doc_id", "old"]).select("digest", "old", normalised(F.col("text")).alias("bytes")).where(F.sha2("bytes", 256) == F.col("digest"))
    same = bytes_of.groupBy("digest").agg((F.min("bytes") == F.max("bytes")).alias("same")).where("same").select("digest")
    unnamed = hits.where(F.col("keep_id").isNull() | F.col("old_id").isNull()).select("digest")
    merged = hits.join(same.union(unnamed).distinct(), "digest").select("digest", F.least("keep_id", "old_id").alias("both_id"), (F.col("n") + F.col("old_n")).alias("both_n"))
    groups = sides.join(merged, "digest", "left")
    groups = groups.select("digest", "old", F.coalesce("both_id", "keep_id").alias("keep_id"), F.coalesce("both_n", "n").alias("group_size"))
    out = seen.join(groups, ["digest", "old"])
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))


def dedup_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """dedup() of one table: the lower half of its doc_id range is the snapshot, the rest the batch."""
    ends = docs.agg(F.min(doc_id).alias("a"), F.max(doc_id).alias("b")).first()
    cut = None if ends.a is None else (ends.a + ends.b) // 2
    old = F.coalesce(F.col(doc_id) <= F.lit(cut).cast("bigint"), F.lit(False))
    return dedup(docs.where(old), docs.where(~old), text, doc_id)


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, all columns, with one row of each text: that of the smallest doc_id, or any of several with that doc_id.

    Verdicts are by row (doc_id and digest), so rows of one doc_id with other texts are judged apart.
    Rows without a doc_id come after all others: one of them stays if its text has no other row."""
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("bigint").alias("id"), F.sha2(normalised(F.col(text)), 256).alias("digest"))
    pairs = dedup_table(docs, text, doc_id).groupBy("doc_id", "text_sha256").agg(F.first("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # a row that loses, or that stands for several of one doc_id and text
    pairs = written(pairs.where("not (doc_id <=> keep_id) or n > 1"), "pairs")
    own = lambda df: (rows["id"].eqNullSafe(df["doc_id"])) & (rows["digest"] == df["text_sha256"])
    kept = rows.join(pairs.hint("merge"), own(pairs), "left_anti")
    again = pairs.where("doc_id <=> keep_id")
    if not again.isEmpty():
        kept = kept.union(rows.join(again.hint("merge"), own(again), "left_semi").dropDuplicates(["id", "digest"]))
    return kept.select("row.*")


ORACLE = r"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, coalesce(doc_id = min(doc_id) over w, false) as kept, text_sha256
from n window w as (partition by text_sha256)"""
