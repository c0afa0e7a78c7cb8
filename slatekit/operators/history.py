"""History operators: as-of assembly from the impression stream, parsing of
zero-padded history strings, truncation/padding, per-category split, union
history with cloud lag, masks.

Histories are ``array<array<T>>``: steps (oldest first) of fixed-width
feature vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatekit.config import CLOUD_LAG, HIST_CATE_MAX_LEN, HIST_FIELDS, HIST_MAX_LEN
from slatekit.functions.exprs import categories, col, let, pad_right, tail, zero_step
from slatekit.plans.indexing import dense_index, split_rows


def history_asof(df: DataFrame, user_col: str = "user_id",
                 order_cols: Sequence[str] = ("ts", "imp_id"), label_col: str = "label",
                 step_cols: Sequence[str] = HIST_FIELDS, max_len: int = HIST_MAX_LEN,
                 out_col: str = "hist", len_col: str | None = None) -> DataFrame:
    """For every row, the positive rows among the same user's previous
    ``max_len`` rows (oldest first), each as an array of ``step_cols``.

    A bounded ROWS frame, so the work per row is O(max_len).  A user with
    more than ``spark.slatekit.splitRows`` rows is cut into chunks of that
    many consecutive rows; each chunk also receives the ``max_len`` rows
    before its first row as read-only halo rows, so every chunk is an
    independent window task and the result is exact.

    ``len_col`` adds the number of steps as a count over the same frame:
    plans that only need the length (e.g. eligibility counts) then skip
    collecting the arrays.
    """
    step = F.array(*[F.col(c) for c in step_cols])
    picked = F.when(F.col(label_col) == 1, step)
    order = [F.col(c) for c in order_cols]
    chunk_rows = split_rows(df)
    largest = df.groupBy(user_col).count().agg(F.max("count")).first()[0] or 0
    if largest <= chunk_rows:
        w = Window.partitionBy(user_col).orderBy(*order).rowsBetween(-max_len, -1)
        out = df.withColumn(out_col, F.collect_list(picked).over(w))
        return out.withColumn(len_col, F.count(picked).over(w)) if len_col else out

    idx = dense_index(df, order, [user_col], "_h_idx")
    c = F.lit(chunk_rows)
    home = F.floor(F.col("_h_idx") / c)
    # a row is read by every later chunk whose first row lies within
    # max_len rows after it (one extra copy when chunks are long)
    last = F.floor((F.col("_h_idx") + max_len) / c)
    copies = F.transform(F.sequence(home, last),
                         lambda ch: F.struct(ch.alias("ch"), (ch != home).alias("halo")))
    x = idx.withColumn("_h_c", F.explode(copies)).select("*", "_h_c.ch", "_h_c.halo").drop("_h_c")
    w = Window.partitionBy(user_col, "ch").orderBy("_h_idx").rowsBetween(-max_len, -1)
    x = x.withColumn(out_col, F.collect_list(picked).over(w))
    if len_col:
        x = x.withColumn(len_col, F.count(picked).over(w))
    return x.where(~F.col("halo")).drop("ch", "halo", "_h_idx")


def parse_history(df: DataFrame, seq_cols: Sequence[str], as_int: bool = False,
                  out_col: str = "hist") -> DataFrame:
    """P4 + M8: parse parallel comma-joined feature sequences into steps.

    Steps are counted when their feature sum is non-zero; the scan stops at
    the first two consecutive zero steps; a lone zero step is skipped but
    not counted.  The result is the *prefix* of ``count`` steps (so a gap is
    kept and the tail lost).  Adds ``hist`` (array<array<string|int>>) and
    ``hist_len``.  Non-numeric features count as 0.

    Split arrays, per-step sums and the fold state are separate projections,
    so each is evaluated once per row (the fold is O(steps)).
    """
    k = len(seq_cols)
    parts = [f"_hp_s{i}" for i in range(k)]
    ints = [f"_hp_i{i}" for i in range(k)]
    x = df.select("*", *[F.split(col(c), ",").alias(p) for c, p in zip(seq_cols, parts)])
    x = x.select("*", *[F.transform(p, lambda v: F.coalesce(v.try_cast("int"), F.lit(0))).alias(i)
                        for p, i in zip(parts, ints)])
    zipped = F.arrays_zip(*[F.col(i) for i in ints])
    x = x.withColumn("_hp_sum", F.transform(
        zipped, lambda z: sum((z[i] for i in ints[1:]), z[ints[0]])))
    n_steps = F.size("_hp_sum")

    def fold(acc, i):
        s = F.col("_hp_sum")
        zero = F.element_at(s, i) == 0
        next_zero = (i < n_steps) & (F.element_at(s, F.least(i + 1, n_steps)) == 0)
        return (F.when(acc["stop"], acc)
                .when(zero & next_zero, F.struct(acc["n"].alias("n"), F.lit(True).alias("stop")))
                .when(zero, acc)
                .otherwise(F.struct((acc["n"] + 1).alias("n"), acc["stop"].alias("stop"))))

    x = x.withColumn("_hp_n", F.aggregate(
        F.sequence(F.lit(1), F.greatest(n_steps, F.lit(1))),
        F.struct(F.lit(0).alias("n"), F.lit(False).alias("stop")), fold)["n"].cast("int"))
    src = ints if as_int else parts
    kind = "int" if as_int else "string"
    # the kept prefix, field-wise into steps
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_hp_n"), F.lit(1))),
                        lambda i: F.array(*[F.element_at(F.col(c), i) for c in src]))
    x = x.withColumn(out_col, F.when(F.col("_hp_n") > 0, steps)
                     .otherwise(F.array().cast(f"array<array<{kind}>>")))
    x = x.withColumnRenamed("_hp_n", f"{out_col}_len")
    return x.drop(*parts, *ints, "_hp_sum")


def pad_history(hist: str | Column, max_len: int = HIST_MAX_LEN, width: int = len(HIST_FIELDS),
                kind: str = "int", out_col: str = "hist") -> list[Column]:
    """Keep the first ``max_len`` steps, right-pad with zero steps;
    the true (capped) length is kept alongside."""
    h = col(hist)
    return [pad_right(h, max_len, zero_step(width, kind)).alias(out_col),
            F.least(F.size(h), F.lit(max_len)).cast("int").alias(f"{out_col}_len")]


def cate_split_history(hist: str | Column, hist_len: str | Column, cate_of_step,
                       n_cate: int | str | Column, max_n: int = HIST_CATE_MAX_LEN,
                       width: int = len(HIST_FIELDS), reverse: bool = False,
                       kind: str = "int") -> list[Column]:
    """X4 (+X6): per category, the steps of that category in history order,
    keeping the *last* ``max_n`` (the first ``max_n`` of the reversed
    history when ``reverse``), right-padded.  ``cate_of_step`` maps a step
    column to its 0-based category index.  Returns ``cate_hist``
    (array of n_cate arrays) and ``cate_hist_len`` (array<int>)."""
    seq = F.slice(col(hist), 1, col(hist_len))
    if reverse:
        seq = F.reverse(seq)
    tagged = F.transform(seq, lambda s: F.struct(s.alias("s"), cate_of_step(s).alias("k")))
    pad = zero_step(width, kind)
    # the steps' categories are looked up once, not once a category and output
    per = let(tagged, lambda t: F.transform(categories(n_cate), lambda c: let(
        F.filter(t, lambda e: e["k"] == c).getField("s"), lambda p: F.struct(
            pad_right(F.slice(p, 1, max_n) if reverse else tail(p, max_n), max_n, pad).alias("s"),
            F.least(F.size(p), F.lit(max_n)).cast("int").alias("n")))))
    return [per.getField("s").alias("cate_hist"), per.getField("n").alias("cate_hist_len")]


def union_history(hist: str | Column, hist_len: str | Column, max_n: int = HIST_MAX_LEN,
                  cloud: bool = True, reverse: bool = False, width: int = len(HIST_FIELDS),
                  kind: str = "int", lag: int = CLOUD_LAG) -> list[Column]:
    """X5 (+X6): the history without its ``lag`` newest steps when ``cloud``
    (steps not yet synced to the server), the last ``max_n`` of it (first
    ``max_n`` when reversed), right-padded; length capped at ``max_n``."""
    n = col(hist_len)
    seq = F.slice(col(hist), 1, n)
    if cloud:
        n = F.greatest(n - lag, F.lit(0))
        seq = F.slice(seq, 1, F.greatest(F.size(seq) - lag, F.lit(0)))
    if reverse:
        seq = F.reverse(seq)
    kept = let(seq, lambda s: F.slice(s, 1, max_n) if reverse else tail(s, max_n))
    return [pad_right(kept, max_n, zero_step(width, kind)).alias("union_hist"),
            F.least(n, F.lit(max_n)).cast("int").alias("union_hist_len")]
