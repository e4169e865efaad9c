"""Sharding by bytes: a minimax contiguous partition of ordered atomic groups.

A group is all documents of one text, so copies never part. Groups are ordered by the SHA-256 of their text, and a shard
is a range of that order. The smallest capacity that ``k`` shards can have is found by binary search: a capacity is
checked greedily, by filling shard after shard as far as it goes, and the shards are then cut under that capacity.

Nothing is sorted for it and no list of groups reaches the driver. Text digests are spread evenly, so sums of sizes by
the digest's leading hex digits are an ordered profile of the whole order: 4096 segments at first, each with its size, its number of
groups and its largest group. A greedy check over segments gives a lower and an upper bound for where each shard ends, so two searches
bound the capacity from both sides. Segments in which an end may lie are refined by two more digits, over their own groups
only, until both searches agree: that capacity is exact. Groups of one segment alone are atomic, whatever their size.

Under the capacity there is freedom left, since greedy cuts fill the first shards to the brim and may leave the last ones empty. So each
cut goes to the group boundary nearest to an even share of what remains, as long as that keeps within the capacity and leaves
no more than the other shards can hold. Boundaries near these cuts are refined in the same way.

Slots number a shard's documents by digest and id: rows are range-partitioned and sorted once, narrow, without texts, and every
range's share of each shard (one row a range and shard that meet) is summed up and broadcast.

Defined cases: a null text counts as the empty one, of no bytes. Rows equal in id and text are told apart at random, which
no column shows but the slot. Null ids come first among equal texts. With fewer groups than shards some shards are empty. Columns beyond id
and text don't matter, whatever their names. An empty table gives an empty result and a capacity of 0.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Hex digits of the first segments, and by how many more a segment is refined.
FIRST, MORE = 3, 2
#: Segments refined in one pass at most, the earliest first; the rest wait for the next pass. Bounds what a pass brings to the driver.
AT_ONCE = 512
#: Greater than every hex digit.
END = "G"


class Profile:
    """Segments in order: prefix, size, number of groups, largest group; and where each starts."""

    def __init__(self, rows: Iterable[tuple[str, int, int, int]]):
        self.rows = {r[0]: r for r in rows}
        self._order()

    def _order(self) -> None:
        self.prefix = sorted(self.rows)
        self.start, at = [], 0
        for p in self.prefix:
            self.start.append(at)
            at += self.rows[p][1]
        self.total = at

    def refine(self, old: Iterable[str], new: Iterable[tuple[str, int, int, int]]) -> None:
        for p in old:
            del self.rows[p]
        self.rows |= {r[0]: r for r in new}
        self._order()

    def at(self, p: int) -> tuple[int, int, int, bool, int]:
        """Of the segment with position p: index, start, end, whether it is one group, its largest group."""
        i = bisect_right(self.start, p) - 1
        _, size, n, largest = self.rows[self.prefix[i]]
        return i, self.start[i], self.start[i] + size, n == 1, largest

    def ends(self, capacity: int, k: int, low: bool) -> list[int]:
        """Bounds for where greedily filled shards end; the last is the total if they hold all."""
        x, out = 0, []
        for _ in range(k):
            p = x + capacity
            if p >= self.total:
                return [*out, self.total]
            _, a, _, one, largest = self.at(p)
            x = p if p == a else a if one else max(a, p - largest + 1) if low else p
            out.append(x)
        return out

    def smallest(self, k: int, low: bool) -> int:
        least, most = max(-(-self.total // k), max(r[3] for r in self.rows.values())), self.total
        while least < most:
            mid = (least + most) // 2
            if self.ends(mid, k, low)[-1] == self.total:
                most = mid
            else:
                least = mid + 1
        return least

    def open_between(self, a: int, b: int) -> set[str]:
        first, last = self.at(max(a, 0))[0], self.at(min(b, self.total - 1))[0]
        return {p for p in self.prefix[first : last + 1] if self.rows[p][2] > 1}

    def cuts(self, capacity: int, k: int) -> tuple[list[int], set[str]]:
        """k - 1 cut positions, and the segments to refine before they are exact."""
        asked: set[str] = set()

        def around(p: int) -> tuple[int, int]:
            i, a, b, one, _ = self.at(p)
            if p == a:
                return p, p
            if not one:
                asked.update(self.open_between(self.start[max(i - 1, 0)], b))
                return p, p
            return a, b

        least = [self.total] * (k + 1)  # from least[s] on, k - s shards are enough
        for s in range(k - 1, 0, -1):
            p = least[s + 1] - capacity
            least[s] = around(p)[1] if p > 0 else 0
        x, out = 0, []
        for s in range(1, k):
            target = x + (self.total - x) // (k - s + 1)
            a, b = around(target) if target < self.total else (target, target)
            pick = b if a == x else a if b - x > capacity or target - a <= b - target else b
            x = max(pick, least[s])
            out.append(x)
        return out, asked

    def named(self, p: int) -> str:
        """The prefix that the first group from position p on is not below."""
        return END if p >= self.total else self.prefix[self.at(p)[0]]


def minimax(profile: Profile, k: int, refine: Callable[[list[str]], Iterable[tuple[str, int, int, int]]]) -> tuple[int, list[str]]:
    """The smallest capacity, and the prefixes at which the shards after the first begin."""

    def finer(asked: set[str]) -> None:
        these = sorted(asked)[:AT_ONCE]
        profile.refine(these, refine(these))

    while True:
        least, most = profile.smallest(k, low=False), profile.smallest(k, low=True)
        if least == most:
            break
        spans = zip(profile.ends(least, k, True), profile.ends(most, k, False), strict=False)
        finer(set().union(*(profile.open_between(a, b) for a, b in spans)))
    while True:
        at, asked = profile.cuts(most, k)
        if not asked:
            return most, [profile.named(p) for p in at]
        finer(asked)


def sizes(docs: DataFrame, extra: int, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(extra)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("row")
    )


def shard(docs: DataFrame, k: int = 40, *, extra: int = 16, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Per row: id, size (UTF-8 bytes and ``extra``), text_crc32, digest, shard, slot; and the capacity, which no shard exceeds."""
    scratch = Scratch(docs.sparkSession, "shard-cuts")
    rows = scratch.save(sizes(docs, extra, id_col, text_col), "sizes")
    groups = scratch.save(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups").select(F.hex("digest").alias("digest"), "size")

    def profile(df: DataFrame) -> list[tuple[str, int, int, int]]:
        return [tuple(r) for r in df.groupBy("prefix").agg(F.sum("size"), F.count("*"), F.max("size")).collect()]

    def refine(prefixes: list[str]) -> list[tuple[str, int, int, int]]:
        lengths = sorted({len(p) for p in prefixes})
        deeper = [F.when(F.substring("digest", 1, n).isin([p for p in prefixes if len(p) == n]), F.substring("digest", 1, n + MORE)) for n in lengths]
        return profile(groups.select(F.coalesce(*deeper).alias("prefix"), "size").where("prefix is not null"))

    whole = Profile(profile(groups.select(F.substring("digest", 1, FIRST).alias("prefix"), "size")))
    capacity, begins = minimax(whole, k, refine) if whole.total else (0, [])
    name = F.hex("digest")
    number = F.size(F.filter(F.array(*(F.lit(b) for b in begins)), lambda b: b <= name)) if begins else F.lit(0)
    placed = rows.withColumn("shard", number).repartitionByRange("digest", "id", "row").sortWithinPartitions("digest", "id", "row")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = scratch.save(placed.withColumn("range", F.spark_partition_id()).withColumn("place", place).drop("row"), "placed")
    runs = placed.groupBy("range", "shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("range", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    out = placed.join(F.broadcast(runs), ["range", "shard"])  # at most ranges + shards rows
    return out.select("id", "size", "text_crc32", "digest", "shard", (F.col("place") + F.col("shift")).alias("slot")), capacity
