"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group.  Groups stand in the order of
their smallest doc_id; the shards are contiguous runs of groups.  The smallest
feasible capacity (no shard above it, no group cut) is found by binary search
with a greedy check, and the cuts are placed there: each cut goes to the group
end nearest to an equal share of what is left, within what the capacity allows
before and after it, so a group larger than a fair share costs only itself.

Sizes are summed by a distributed running sum.  The driver holds a summary of
at most ``BLOCKS`` blocks of group ends; a greedy step that falls inside a block
reads that block alone (or, where it has more than ``FETCH_ROWS`` ends, a summary
of it in its turn), and the coarse summary first narrows the capacity.

Defined results: null text has no bytes (size 8, crc 0) and all null texts are
one group; null doc_id sorts first; repeated rows are rows of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatekit.llm.common import Scratch, running, table

SHARDS = 24
ROW_BYTES = 8
BLOCKS = 65_536          # rows of the driver's summary, at most
FETCH_ROWS = 2_000_000   # group ends read ahead in one step, at most


class GroupEnds:
    """Ends (running byte sums) of ordered atomic groups: exact look-ups over a
    distributed table, through a bounded summary on the driver."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        rows = (ends.groupBy("block").agg(F.min("end").alias("lo"), F.max("end").alias("hi"),
                                          F.count(F.lit(1)).alias("n")).orderBy("block").collect())
        self.block = [r["block"] for r in rows]
        self.lo = [r["lo"] for r in rows]
        self.hi = [r["hi"] for r in rows]
        self.n = [r["n"] for r in rows]
        self.cache: dict[int, list[int]] = {}
        self.parts: dict[int, GroupEnds] = {}

    def fetch(self, at: list[int]) -> None:
        """Read the ends of the summary rows ``at``."""
        want = [i for i in at if i not in self.cache]
        if sum(len(v) for v in self.cache.values()) + sum(self.n[i] for i in want) > FETCH_ROWS:
            self.cache.clear()
        if want:
            got = (self.ends.where(F.col("block").isin([self.block[i] for i in want]))
                   .select("block", "end").orderBy("end").collect())
            by = {self.block[i]: self.cache.setdefault(i, []) for i in want}
            for r in got:
                by[r["block"]].append(r["end"])

    def inside(self, i: int) -> list[int]:
        if self.lo[i] == self.hi[i]:
            return [self.lo[i]]
        if i not in self.cache:
            self.fetch([i])
        return self.cache[i]

    def part(self, i: int) -> "GroupEnds | None":
        """The summary of a block too long to be read, else None."""
        if self.n[i] <= FETCH_ROWS or self.lo[i] == self.hi[i]:
            return None
        if i not in self.parts:
            width = -(-(self.hi[i] - self.lo[i] + 1) // BLOCKS)
            own = self.ends.where(F.col("block") == self.block[i]).withColumn(
                "block", F.expr(f"(end - {self.lo[i]}) div {width}"))
            self.parts[i] = GroupEnds(own, self.total)
        return self.parts[i]

    def at_most(self, x: int) -> int:
        """Largest group end <= x, or 0."""
        i = bisect_right(self.lo, x) - 1
        if i < 0:
            return 0
        if self.hi[i] <= x:
            return self.hi[i]
        if part := self.part(i):
            return part.at_most(x)
        v = self.inside(i)
        return v[bisect_right(v, x) - 1]

    def at_least(self, x: int) -> int:
        """Smallest group end >= x; 0 for x <= 0."""
        if x <= 0:
            return 0
        i = bisect_left(self.hi, x)
        if self.lo[i] >= x:
            return self.lo[i]
        if part := self.part(i):
            return part.at_least(x)
        v = self.inside(i)
        return v[bisect_left(v, x)]

    def coarse(self, x: int, over: bool) -> int:
        """As at_most, from the summary alone: at a block's end, too far
        (``over``) or not far enough."""
        i = bisect_right(self.lo if over else self.hi, x) - 1
        return 0 if i < 0 else self.hi[i]


def _fits(step, capacity: int, total: int, shards: int) -> bool:
    pos = 0
    for _ in range(shards):
        pos = step(pos + capacity)
        if pos >= total:
            return True
    return False


def _search(lo: int, hi: int, ok) -> int:
    """Smallest value in [lo, hi] for which ``ok`` holds (it holds at hi)."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
    return lo


def minimax_cuts(g: GroupEnds, largest: int, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity and the ``shards - 1`` cut positions."""
    total = g.total
    low = max(-(-total // shards), largest)
    lo = _search(low, total, lambda c: _fits(lambda x: g.coarse(x, True), c, total, shards))
    hi = _search(lo, total, lambda c: _fits(lambda x: g.coarse(x, False), c, total, shards))
    # read ahead the blocks that cuts between these capacities can touch
    at, a, b = set(), 0, 0
    for _ in range(shards):
        first = max(0, bisect_right(g.hi, a + lo) - 1)
        a = g.coarse(a + lo, False)
        last = max(0, bisect_right(g.lo, b + hi) - 1)
        b = g.coarse(b + hi, True)
        at.update(range(first, min(last + 1, first + 512)))
    if sum(g.n[i] for i in at) <= FETCH_ROWS:
        g.fetch(sorted(i for i in at if g.lo[i] < g.hi[i]))
    cap = _search(lo, hi, lambda c: _fits(g.at_most, c, total, shards))
    back = [total]                       # back[k]: earliest start that k shards can finish from
    for _ in range(shards):
        back.append(g.at_least(back[-1] - cap))
    cuts, pos = [], 0
    for i in range(shards - 1):
        left = shards - i
        want = pos + (total - pos) // left
        below, above = g.at_most(want), g.at_least(want)
        near = below if want - below <= above - want else above
        pos = max(pos, back[left - 1], min(near, g.at_most(pos + cap)))
        cuts.append(pos)
    return cap, cuts


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot,
    grown_shard."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    sized = scratch.write(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null")).alias("same")), "sized")
    # written, so that the join can split a group of copies over tasks
    first = scratch.write(sized.groupBy("same").agg(F.min("doc_id").alias("first")), "first")
    placed = running(sized.join(first, "same"), [],
                     [F.col("first").asc_nulls_first(), "same", F.col("doc_id").asc_nulls_first()],
                     {"end": F.col("size"), "pos": F.lit(1)}, scratch, "ranged")
    placed = scratch.write(placed, "placed")
    scratch.drop("ranged", "sized", "first")
    groups = placed.groupBy("first", "same").agg(
        F.max("end").alias("end"), F.max("pos").alias("pos"), F.sum("size").alias("size"))
    groups = scratch.write(groups, "groups")
    top = groups.agg(F.max("end").alias("t"), F.max("size").alias("m")).first()
    total, largest = int(top["t"] or 0), int(top["m"] or 0)
    width = max(1, -(-total // BLOCKS))
    ends = scratch.write(groups.select("end", "pos", F.floor((F.col("end") - 1) / width).alias("block"))
                         .repartitionByRange("block").sortWithinPartitions("end"), "ends")
    cuts: list[int] = []
    starts: list[int] = []
    if total:
        _, cuts = minimax_cuts(GroupEnds(ends, total), largest, shards)
        pos = {r["end"]: r["pos"] for r in ends.where(F.col("end").isin(cuts)).collect()}
        starts = [0] + [pos.get(c, 0) for c in cuts]
    cut_arr = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    n_before = F.size(F.filter(cut_arr, lambda c: c < F.col("end")))
    start_arr = F.array(*[F.lit(s).cast("long") for s in starts or [0]])
    return placed.withColumn("shard", n_before.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("pos") - 1 - F.get(start_arr, F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
