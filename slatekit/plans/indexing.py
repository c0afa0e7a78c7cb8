"""Exact positions and running sums (or maxima, or any associative operation)
inside groups that may be huge.

``Window.partitionBy(g).orderBy(o)`` sends a whole group to one task, and a
window with no partition sends the whole table to one task.  Here:

* groups of at most ``split_rows`` rows (cold) keep one window each; the limit
  is fixed and does not move with the data;
* rows of larger (hot) groups -- and of the whole table whenever there is no
  group, however small it is, then into the session's shuffle partitions -- are
  range-partitioned on (group, order).  Spark samples balanced range bounds
  whatever the key distribution, so a hot group is spread over many tasks.  Inside a task the rows are sorted; a row's position in its
  task is its row id (``monotonically_increasing_id`` minus the task
  offset, computed in the same task, no second shuffle).  Exact offsets come
  from a per-(range, group) count table, prefix-summed: it has at most
  (ranges + hot groups) rows and is broadcast only while that bound stays
  below ``MAX_BROADCAST_ROWS``; beyond it the join is left to the planner.

The result is exact and deterministic for any partitioning, including
recomputation after a lost executor; the order must be total within a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatekit.sources.files import stage

DEFAULT_SPLIT_ROWS = 1 << 21
# Upper bound on rows of any table this module broadcasts.
MAX_BROADCAST_ROWS = 200_000
# Most tasks of one range pass; beyond it the ranges (sorted with spilling) grow.
MAX_RANGES = 100_000


# Aggregate and pairwise combination of each associative operation.
_OPERATIONS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "and": (F.bool_and, lambda a, b: a & b),
    "or": (F.bool_or, lambda a, b: a | b),
}


@dataclass(frozen=True)
class Prefix:
    """A running value: an associative operation over ``expr`` from the group's
    first row to the current one (to the one before, unless ``inclusive``; null
    where there is none)."""

    expr: str | Column
    op: str = "sum"
    inclusive: bool = True

    def over(self, w) -> Column:
        frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow if self.inclusive else -1)
        return _OPERATIONS[self.op][0](_expr(self.expr)).over(frame)

    def total(self) -> Column:
        return _OPERATIONS[self.op][0](_expr(self.expr))

    def totals_before(self, col: str, w) -> Column:
        """The totals ``col`` of the pieces before the current one, combined."""
        return _OPERATIONS[self.op][0](col).over(w)

    def combine(self, before: Column, here: Column) -> Column:
        """Both parts; a null one is nothing."""
        both = _OPERATIONS[self.op][1](before, here)
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(both)


def _prefixes(sums: dict[str, str | Column | Prefix] | None) -> dict[str, Prefix]:
    return {n: e if isinstance(e, Prefix) else Prefix(e) for n, e in (sums or {}).items()}


def split_rows(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("spark.slatekit.splitRows", None)
    return int(conf) if conf else DEFAULT_SPLIT_ROWS


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _expr(e: str | Column) -> Column:
    return F.col(e) if isinstance(e, str) else e


def ordered_scan(df: DataFrame, order_cols: Sequence[str | Column],
                 group_cols: Sequence[str] = (), idx_col: str | None = "idx",
                 sums: dict[str, str | Column | Prefix] | None = None,
                 rows_per_range: int | None = None,
                 bound_cols: Sequence[str | Column] | None = None) -> DataFrame:
    """Add ``idx_col`` (0-based position within the group in ``order_cols``
    order) and, for every ``name -> expr`` in ``sums``, the inclusive running
    sum of ``expr`` within the group in the same order; a ``Prefix`` names
    another operation or leaves the current row out.

    ``bound_cols`` are short values that order rows as ``order_cols`` do, ties left
    (a key and the start of a long text): ranges are cut between them, so the
    sampled bounds hold no long values."""
    sums = _prefixes(sums)
    g = list(group_cols)
    order = _cols(order_cols)
    t = int(rows_per_range or split_rows(df))

    if not g:
        # the session's partitions: no count of the rows, and no copy to count
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return _range_scan(df, order, [], idx_col, sums, n, 0, bound_cols)
    stats = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_sk_n"))   # partial aggregate
    # one scalar job: rows and number of the groups over the limit
    big = F.when(F.col("_sk_n") > t, F.col("_sk_n"))
    tot = stats.agg(F.sum(big).alias("n"), F.count(big).alias("hot")).first()
    hot_total, n_hot = int(tot["n"] or 0), int(tot["hot"])
    if n_hot == 0:
        return _window_scan(df, order, g, idx_col, sums)

    hot = stats.where(F.col("_sk_n") > t).select(*g, F.lit(True).alias("_sk_hot"))
    tagged = df.join(small(hot, n_hot), g, "left")
    cold = _window_scan(tagged.where(F.col("_sk_hot").isNull()), order, g, idx_col, sums)
    hot_rows = tagged.where(F.col("_sk_hot").isNotNull())
    n_ranges = min(MAX_RANGES, math.ceil(hot_total * 4 / t))
    warm = _range_scan(hot_rows, order, g, idx_col, sums, n_ranges, n_hot, bound_cols)
    return cold.drop("_sk_hot").unionByName(warm.drop("_sk_hot"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint while its counted rows are within the bound."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def _window_scan(df: DataFrame, order: list[Column], g: list[str], idx_col, sums) -> DataFrame:
    """One window per group (every group is small)."""
    w = Window.partitionBy(*g).orderBy(*order)
    out = df
    if idx_col:
        out = out.withColumn(idx_col, (F.row_number().over(w) - 1).cast("bigint"))
    for name, prefix in sums.items():
        out = out.withColumn(name, prefix.over(w))
    return out


def _range_scan(df: DataFrame, order: list[Column], g: list[str], idx_col, sums,
                n_ranges: int, n_groups: int, bound_cols=None) -> DataFrame:
    n_ranges = max(2, n_ranges)
    keys = [F.col(c) for c in g] + order
    bounds = keys if bound_cols is None else [F.col(c) for c in g] + _cols(bound_cols)
    # Range bounds are sampled from the input, whose row order after a
    # shuffle is not deterministic: two plans reading the same input could
    # cut different ranges.  The range id and row id are therefore written
    # once with the rows, and offsets and positions both read that table.
    ranged = stage(df.repartitionByRange(n_ranges, *bounds).sortWithinPartitions(*keys)
                   .withColumn("_sk_pid", F.spark_partition_id().cast("bigint"))
                   .withColumn("_sk_i", F.monotonically_increasing_id()
                               - F.shiftleft(F.col("_sk_pid"), 33)), "ordered-scan")
    aggs = [F.count(F.lit(1)).alias("_sk_c"), F.min("_sk_i").alias("_sk_start")]
    aggs += [p.total().alias(f"_sk_t_{n}") for n, p in sums.items()]
    counts = ranged.groupBy("_sk_pid", *g).agg(*aggs)   # <= ranges + hot groups rows
    prev = (Window.partitionBy(*g).orderBy("_sk_pid")
            .rowsBetween(Window.unboundedPreceding, -1))
    offs = counts.select(
        "_sk_pid", *g, "_sk_start",
        F.coalesce(F.sum("_sk_c").over(prev), F.lit(0)).alias("_sk_oc"),
        *[p.totals_before(f"_sk_t_{n}", prev).alias(f"_sk_o_{n}") for n, p in sums.items()])
    out = ranged.join(small(offs, n_ranges + n_groups), ["_sk_pid", *g], "left")
    pos = F.col("_sk_i") - F.col("_sk_start")          # position of the row in its piece
    if idx_col:
        out = out.withColumn(idx_col, pos + F.col("_sk_oc"))
    if sums:
        # running values inside a piece (one task per range piece; ranges are balanced)
        w = Window.partitionBy("_sk_pid", *g).orderBy("_sk_i")
        for name, p in sums.items():
            out = out.withColumn(name, p.combine(F.col(f"_sk_o_{name}"), p.over(w)))
    return out.drop(*[c for c in out.columns if c.startswith("_sk_") and c != "_sk_hot"])


def dense_index(df: DataFrame, order_cols: Sequence[str | Column],
                group_cols: Sequence[str] = (), idx_col: str = "idx",
                rows_per_range: int | None = None,
                bound_cols: Sequence[str | Column] | None = None) -> DataFrame:
    """0-based dense position of every row within its group (global when no
    group), exact and without funnelling a large group through one task."""
    return ordered_scan(df, order_cols, group_cols, idx_col, None, rows_per_range, bound_cols)
