"""Sharding by a minimax contiguous partition, in DataFrame operations only.

Atomic groups (documents with equal texts) are ordered by their size class, then by digest, and cut
into contiguous shards. The smallest feasible shard capacity is found by binary search; a capacity is
feasible if a greedy walk from the left fits everything into the shards. Ordered by size, the sequence
of groups is a run for each size class (the size itself below 2^16, above it sizes that agree in 13 bits), so the
walk works on (groups, bytes) of classes. There are under 300,000 of these however much data there is; only they
come to the driver. The capacity is the smallest one exactly where a cut falls between classes or in a class of
one size, and within one group's size in 4,096 otherwise.

A group of at least an equal share of what is left gets a shard of its own first (the largest first),
and the capacity is searched for the rest: else one large group would set the capacity of every
shard. Within the capacity each cut is put as near to the equal share as the groups allow.

Ranks (a group in its run, a document in its shard) are sums over 4,096 buckets by leading digits of a digest plus a
rank in the bucket. The join of rows to groups is a plain equi-join, which adaptive execution splits where one text
holds a large part of the rows.

Defined results. A null text counts as empty (size 8, CRC of no bytes) and equals an empty one. Rows that
repeat an id are rows of their own, with slots of their own. With fewer groups than shards some shards
stay empty. A very long text is one row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, text_or_empty

#: What a document weighs besides its text.
ROW_BYTES = 8


@dataclass(frozen=True)
class Cut:
    """The shard begins at the ``rank``-th group (from 0) of the groups of this size class."""

    cls: int
    rank: int


class Runs:
    """Groups ordered by size class as runs; positions are numbers of groups, weights are bytes.

    A run has its class, the number of its groups and their bytes; within it groups count as equal.
    """

    def __init__(self, classes: list[int], counts: list[int], totals: list[int]):
        self.cls, self.count = np.array(classes, np.int64), np.array(counts, np.int64)
        self.total = np.array(totals, dtype=object if sum(totals) >> 62 else np.int64)
        self.bytes = np.r_[0, np.cumsum(self.total)]
        self.groups = np.r_[0, np.cumsum(self.count)]

    def weight(self, position: int) -> int:
        """Bytes of the groups before a position."""
        j = int(np.searchsorted(self.groups, position, "right")) - 1
        if j >= len(self.cls):
            return int(self.bytes[-1])
        return int(self.bytes[j]) + (position - int(self.groups[j])) * int(self.total[j]) // int(self.count[j])

    def reach(self, limit: int) -> int:
        """The last position that has at most ``limit`` bytes before it."""
        j = int(np.searchsorted(self.bytes, limit, "right")) - 1
        if j >= len(self.cls):
            return int(self.groups[-1])
        # The last position of the run whose weight, rounded down, is within the limit.
        return int(self.groups[j]) + ((limit - int(self.bytes[j]) + 1) * int(self.count[j]) - 1) // int(self.total[j])

    def reach_back(self, limit: int) -> int:
        """The first position that has at least ``limit`` bytes before it."""
        p = self.reach(limit)
        return p if self.weight(p) >= limit else p + 1

    def fits(self, capacity: int, end: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = min(end, self.reach(self.weight(at) + capacity))
            if at == end:
                return True
        return False

    def cut(self, shards: int) -> list[int]:
        """Where shards 1, 2, ... begin; fewer positions than shards where there are too few groups."""
        end, alone = int(self.groups[-1]), []
        while shards > 1 and end > 0:
            largest = self.weight(end) - self.weight(end - 1)
            if largest * shards < self.weight(end):
                break
            end, shards = end - 1, shards - 1
            alone.append(end)
        total = self.weight(end)
        low, high = -(-total // shards), total
        if end:
            low = max(low, self.weight(end) - self.weight(end - 1))
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fits(mid, end, shards) else (mid + 1, high)
        cuts, at = [], 0
        for k in range(1, shards):
            ideal = total * k // shards
            below = self.reach(ideal)
            near = below if below >= end or ideal - self.weight(below) <= self.weight(below + 1) - ideal else below + 1
            # What is left must fit the shards that are left, each cut greedily from the right.
            least = end
            for _ in range(shards - k):
                least = max(0, self.reach_back(max(0, self.weight(least) - low)))
            at = min(end, self.reach(self.weight(at) + low), max(at, least, near))
            cuts.append(at)
        return cuts + alone[::-1]

    def named(self, position: int) -> Cut:
        j = int(np.searchsorted(self.groups, position, "right")) - 1
        return Cut(int(self.cls[j]), position - int(self.groups[j])) if j < len(self.cls) else Cut(int(self.cls[-1]) + 1, 0)


def size_class(weight: Column) -> Column:
    """A class of sizes: the size itself below 2^16, else its length in bits and its first 13 bits. There are under
    300,000 classes, however large groups are; sizes of a class differ by less than one in 4,096."""
    bits = F.length(F.bin(weight))
    high = F.call_function("shiftright", weight, F.greatest(bits - 13, F.lit(0)))
    return F.when(weight < 1 << 16, weight).otherwise(bits.cast("long") * (1 << 13) + high)


def leading(digits: Column) -> Column:
    """One of 4,096 buckets: the first three hexadecimal digits, so that order by bucket, then digest is order by digest."""
    return F.conv(F.substring(digits, 1, 3), 16, 10).cast("int")


def ranked(df: DataFrame, by: str, order: list[str], bucket: Column, name: str) -> DataFrame:
    """Gapless ranks from 0 within ``by``, without a task that sees all rows of a value."""
    rows = df.withColumn("__bucket", bucket)
    ahead = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(by, "__bucket").agg(F.count("*").alias("__n"))
    counts = counts.select(by, "__bucket", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(by, "__bucket").orderBy(*order)) - 1
    return rows.withColumn("__within", within).join(counts, [by, "__bucket"]).withColumn(name, F.col("__before") + F.col("__within")).drop("__bucket", "__before", "__within")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``key, size, text_crc32, shard, slot``."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("key"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    stage = Staged(docs.sparkSession)
    rows = stage.write(rows, "shard-rows")
    groups = rows.groupBy("digest").agg((F.count("*") * F.first("size")).alias("weight"))
    groups = stage.write(groups, "shard-groups")
    classes = groups.withColumn("cls", size_class(F.col("weight")))
    runs = sorted(map(tuple, classes.groupBy("cls").agg(F.count("*").alias("n"), F.sum("weight").alias("bytes")).collect()))
    if not runs:
        return rows.select("key", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    table = Runs(*map(list, zip(*runs)))
    cuts = [table.named(p) for p in table.cut(shards)]
    split = sorted({c.cls for c in cuts if c.rank})
    bucket = leading(F.hex("digest"))
    placed = classes.where(~F.col("cls").isin(split)).withColumn("rank", F.lit(0).cast("long"))
    if split:
        placed = placed.unionByName(ranked(classes.where(F.col("cls").isin(split)), "cls", ["digest"], bucket, "rank"))
    after = [((F.col("cls") > c.cls) | ((F.col("cls") == c.cls) & (F.col("rank") >= c.rank))).cast("int") for c in cuts]
    placed = placed.select("digest", sum(after, F.lit(0)).alias("shard"))
    joined = stage.write(rows.join(placed, "digest"), "shard-placed")
    spread = leading(F.md5(F.concat_ws("/", F.col("key").cast("string"), F.hex("digest"))))
    return ranked(joined, "shard", ["key", "digest"], spread, "slot").select("key", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
