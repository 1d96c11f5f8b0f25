"""Sharding by the minimax contiguous partition of atomic groups."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftledger.llm.common import running, stored

#: Ranges that one look at the boundaries is summed up in. Bounds what the driver holds, not the data.
CELLS = 4096
#: Steps between the ends of a capacity bracket whose passes a look settles.
BETWEEN = 6


class Boundaries:
    """What is known of the sorted positions at which a group starts: ranges that do not overlap, each with the first and last
    position in it."""

    def __init__(self, cells: list[tuple[int, int]], total: int):
        self.cells = [*sorted(cells), (total, total)]
        self.firsts = [first for first, _ in self.cells]

    def path(self, capacity: int, shards: int, side: int) -> tuple[list[int], set[tuple[int, int]]]:
        """Where a greedy pass with this capacity cuts, taking the lower (0) or the upper (1) bound at each cut, and the
        ranges in which a cut falls between the first and the last position."""
        cuts, doubtful, at, total = [], set(), 0, self.cells[-1][0]
        for _ in range(shards):
            x = min(at + capacity, total)
            first, last = self.cells[bisect_right(self.firsts, x) - 1]
            if last <= x:
                at = last
            else:
                at = x if side else first
                doubtful.add((first, last))
            cuts.append(at)
        return cuts, doubtful

    def least(self, low: int, high: int, shards: int, side: int) -> int:
        """The smallest capacity in [low, high] whose greedy pass reaches the end, by binary search."""
        while low < high:
            middle = (low + high) // 2
            if self.path(middle, shards, side)[0][-1] >= self.cells[-1][0]:
                high = middle
            else:
                low = middle + 1
        return low


def minimax_cuts(groups: DataFrame, shards: int, cells: int = CELLS) -> list[int]:
    """Cuts of the smallest feasible capacity; ``groups(start, bytes)`` are contiguous and each goes to one shard whole.

    The greedy check needs, for a capacity, the last boundary at or before a position. The first look sums all boundaries up
    in at most ``cells`` ranges, which brackets the capacity. Each later look divides, again into ``cells`` at most, only the
    ranges that leave a cut in doubt for the ends of the bracket or capacities between them. The first such range of a pass
    holds one cut, so it ends in single boundaries, and then the next: every look gets further, also where a very large
    group makes passes of nearly equal capacities go apart. A few passes over a narrow table do, and the driver holds
    ``cells`` ranges a look, however many groups there are and however large one is.
    """
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    if not total:
        return [0] * (shards - 1)
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    doubtful, known, cells = {(0, total)}, set(), max(cells, 16 * shards)
    while True:
        pieces, cell = max(2, cells // len(doubtful)), F
        for a, b in sorted(doubtful):
            width = -(-(b - a + 1) // pieces)
            cell = cell.when(F.col("start").between(a, b), F.lit(a) + F.floor((F.col("start") - a) / F.lit(width)) * F.lit(width))
        found = groups.select("start", cell.alias("cell")).where("cell is not null").groupBy("cell").agg(F.min("start"), F.max("start")).collect()
        known = (known - doubtful) | {(r[1], r[2]) for r in found}
        boundaries = Boundaries(list(known), total)
        low, high = boundaries.least(low, high, shards, 1), boundaries.least(low, high, shards, 0)
        capacities = {low + (high - low) * i // BETWEEN for i in range(BETWEEN + 1)}
        doubtful = set().union(*(boundaries.path(c, shards, side)[1] for c in capacities for side in (0, 1)))
        if not doubtful:
            return boundaries.path(low, shards, 0)[0][:-1]


def shard(docs: DataFrame, shards: int = 8, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, size, text_crc32, shard, slot): documents with equal texts go together, and the largest shard is as small as
    cutting the groups in the order of their hashes allows.

    The size is the UTF-8 length plus 1. A null text has size 1, no CRC, and shares a group with other null texts only. A
    group may be larger than an even share; then it has a shard to itself, or nearly so. Slots count up in a shard by group
    and doc_id, nulls first; equal doc_ids come in any order. With few groups, or none, some shards stay empty.
    """
    narrow = stored(
        docs.select(
            "doc_id",
            F.struct(F.lit(1).alias("none"), *carried).alias("carried"),
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"")).alias("group"),
        ).select("*", F.lit(1).alias("one"), F.monotonically_increasing_id().alias("row_id"))
    )
    placed = stored(running(narrow, ["group", "doc_id", "row_id"], {"start": "size", "number": "one"}))
    groups = stored(placed.groupBy("group").agg(F.min("start").alias("start"), F.sum("size").alias("bytes")).select("start", "bytes"))
    cuts = minimax_cuts(groups, shards)
    # A cut is where a group starts, so every document of a group lies on the same side of it.
    of = F.array(*[F.lit(c).cast("long") for c in cuts])
    placed = placed.withColumn("shard", F.size(F.filter(of, lambda c: c <= F.col("start"))).cast("int") if cuts else F.lit(0))
    firsts = placed.groupBy("shard").agg(F.min("number").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id", *[F.col("carried")[c].alias(c) for c in carried], "size", "text_crc32", "shard", (F.col("number") - F.col("first")).alias("slot")
    )
