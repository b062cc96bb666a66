"""Minimax contiguous sharding with DataFrame operations only.

Rows with equal texts form an atomic group; groups are ordered by the hash of
their text. The smallest capacity is sought at which a greedy pass over the
groups, which starts a shard whenever the next group would not fit, needs no
more than the given number of shards. The groups themselves never come to the
driver: it holds sums over ranges of hashes (at most `2 ** FIRST_BITS` at first)
and splits only those ranges in which a cut may fall, until the capacity found
by a pass that cuts at range ends equals the one of a pass that may cut
anywhere within a range that holds several groups. Within that capacity each cut is
then placed next to the mean of what is left for the remaining shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import cut

FIRST_BITS, MORE_BITS = 14, 6
#: A cut this share of a shard away from the even place is not sought more finely.
EVEN = 1e-4
#: Row numbers are given within cells of a shard, by hash of doc_id, so that no shard or group of copies is one task.
CELLS = 512


class Ranges:
    """Sums of group sizes over consecutive hash ranges, in order."""

    def __init__(self, items: list[tuple[int, int, int, int]]):
        #: (first hash, bits, size, groups), ordered; hashes are shifted to be unsigned.
        self.items = sorted(items)
        self.ends = []
        total = 0
        for _, _, size, _ in self.items:
            total += size
            self.ends.append(total)
        self.total = total

    def cuts(self, capacity: int, anywhere: bool) -> list[int]:
        """Where a greedy pass cuts, as sizes before the cut; one that cuts anywhere only bounds what finer ranges allow."""
        out, at = [], 0
        while at < self.total:
            goal = at + capacity
            k = bisect_right(self.ends, goal)
            here = self.ends[k - 1] if k else 0
            if k < len(self.ends) and anywhere and self.items[k][3] > 1:
                here = goal
            if here <= at:
                return []
            out.append(min(here, self.total))
            at = here
        return out

    def least(self, shards: int, anywhere: bool) -> int:
        """The smallest capacity at which no more than `shards` are needed."""
        low, high = max(1, -(-self.total // shards)), max(1, self.total)
        while low < high:
            mid = (low + high) // 2
            found = self.cuts(mid, anywhere)
            if found and len(found) <= shards:
                high = mid
            else:
                low = mid + 1
        return low

    def at(self, position: int) -> int:
        """Index of the range that holds the position, from its start on and before its end."""
        return min(bisect_right(self.ends, position), len(self.items) - 1)

    def even(self, shards: int, capacity: int) -> list[tuple[int, float]]:
        """For each shard but the last, how many ranges come before its end, and the size aimed at there.

        Each end is the one next to the mean of what is left, of those that keep this shard and leave the
        others within the capacity, with a range at least for each of them.
        """
        n, sums = len(self.items), [0, *self.ends]
        # last[j]: the first range from which on j shards can hold the rest, each with a range at least
        last = [n]
        for _ in range(min(shards, n)):
            last.append(max(0, min(last[-1] - 1, bisect_left(sums, sums[last[-1]] - capacity))))
        out, at = [], 0
        for left in range(min(shards, n), 1, -1):
            goal = sums[at] + (self.total - sums[at]) / left
            low = max(at + 1, last[left - 1])
            high = max(low, min(bisect_right(sums, sums[at] + capacity) - 1, n - left + 1))
            k = min(max(bisect_left(sums, goal), low), high)
            if k > low and goal - sums[k - 1] <= sums[k] - goal:
                k -= 1
            out.append((k, goal))
            at = k
        return out


def _summary(groups: DataFrame, bits: int, within: list[int] | None = None, parent_bits: int = 0) -> list[tuple[int, int, int, int]]:
    """Sizes and counts of groups over hash ranges of the given bits."""
    prefix = F.shiftrightunsigned("h", 64 - bits)
    if within is not None:
        groups = groups.where(F.shiftrightunsigned("h", 64 - parent_bits).isin(within))
    rows = groups.groupBy(prefix.alias("p")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return [(r["p"] << (64 - bits), bits, r["size"], r["n"]) for r in rows]


def _split(groups: DataFrame, ranges: Ranges, split: set[int]) -> Ranges:
    """The ranges, those given by index in finer ones."""
    by_bits: dict[int, list[int]] = {}
    for k in split:
        by_bits.setdefault(ranges.items[k][1], []).append(ranges.items[k][0])
    finer = [x for k, x in enumerate(ranges.items) if k not in split]
    for bits, starts in by_bits.items():
        finer += _summary(groups, min(63, bits + MORE_BITS), [s >> (64 - bits) for s in starts], bits)
    return Ranges([(h, b, s, 1 if b == 63 else n) for h, b, s, n in finer])


def plan(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The minimax capacity over groups (h, size), and the first hash (unsigned) of each shard but the first.

    The capacity is sought first; then each cut is placed as evenly as it allows.
    """
    ranges = Ranges(_summary(groups, FIRST_BITS))
    if not ranges.items:
        return 0, []
    while (low := ranges.least(shards, True)) != (high := ranges.least(shards, False)):
        split = set()
        for first, last in zip(ranges.cuts(low, True), ranges.cuts(high, True), strict=False):
            split |= {k for k in range(ranges.at(min(first, last)), ranges.at(max(first, last)) + 1)}
        split = {k for k in split if ranges.items[k][3] > 1}
        if not split or len(split) > 4096:
            split = {k for c in (low, high) for x in ranges.cuts(c, True) if ranges.items[k := ranges.at(x)][3] > 1}
        ranges = _split(groups, ranges, split)
    while True:
        cuts = ranges.even(shards, high)
        # a range that hides ends nearer to the size aimed at is split, unless its own end is near enough
        near = ranges.total / shards * EVEN
        split = {k for at, goal in cuts if abs(ranges.ends[at - 1] - goal) > near and ranges.items[k := ranges.at(goal)][3] > 1}
        if len(ranges.items) < shards:
            split |= {k for k, x in enumerate(ranges.items) if x[3] > 1}
        if not split:
            return high, [ranges.items[at][0] for at, _ in cuts]
        ranges = _split(groups, ranges, split)


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of `docs` (doc_id, text; other columns are ignored).

    size is the text's length in UTF-8 plus 16; a null text counts as an empty
    one and is grouped with it. Rows of equal texts go to one shard; under that
    condition the largest shard is as small as contiguous cuts allow, the others are as
    even as that leaves them, and none is empty unless there are fewer texts than shards. slot
    numbers a shard's rows from 0 without gaps. The law is `bytes`, so
    grown_shard is null. Rows that repeat, null or tie get slots of their own;
    an empty table gives none. Texts whose 64-bit hashes (less the lowest bit)
    are equal count as one group.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.xxhash64(text).alias("h"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    rows = cut(rows)
    groups = cut(rows.groupBy("h").agg(F.sum("size").alias("size")))
    _, firsts = plan(groups, shards)
    # Long order with the sign bit flipped is unsigned order.
    flipped = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    steps = [(flipped >= F.lit(x - (1 << 63))).cast("int") for x in firsts]
    placed = rows.select("doc_id", "size", "text_crc32", reduce(lambda a, b: a + b, steps, F.lit(0)).alias("shard"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(CELLS)).cast("int").alias("cell"))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    # At most shards * CELLS rows: their running sums are small work.
    offsets = F.expr("sum(n) OVER (PARTITION BY shard ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    offsets = counts.select("shard", "cell", F.coalesce(offsets, F.lit(0)).alias("before"))
    numbered = placed.withColumn("within", F.expr("row_number() OVER (PARTITION BY shard, cell ORDER BY doc_id, text_crc32)"))
    return numbered.join(F.broadcast(offsets), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
