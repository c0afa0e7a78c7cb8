"""Batch-level training objectives as table jobs.

A batch is a set of lists (W8).  Per batch: mean log loss over its slots,
the category share of the k-hot exposure picks, a smoothed JS divergence of
that share against the target ratio, and the combined objective.  All are
aggregates over (batch, category); the per-list pick is a short window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatekit.config import (EXPOSURE_SCOPE, JS_LAMBDA, KL_EPS, LOGLOSS_EPS,
                             TARGET_EXPOSURE)
from slatekit.operators.metrics import mapped_category, smoothed_kl_term
from slatekit.operators.ranking import khot_pick


def log_loss_term(label_col: str = "label", pred_col: str = "pred",
                  eps: float = LOGLOSS_EPS) -> Column:
    y, p = F.col(label_col).cast("double"), F.col(pred_col).cast("double")
    return y * F.log(p + eps) + (1 - y) * F.log(1 - p + eps)


def batch_log_loss(slots: DataFrame, eps: float = LOGLOSS_EPS, label_col: str = "label",
                   pred_col: str = "pred") -> DataFrame:
    """Per-batch mean log loss over all slots of the batch's lists."""
    return slots.groupBy("batch").agg(
        (-F.avg(log_loss_term(label_col, pred_col, eps))).alias("log_loss"))


def batch_loss(slots: DataFrame, **kw) -> DataFrame:
    """Mean of the per-batch losses (two-level average)."""
    return batch_log_loss(slots, **kw).agg(F.count(F.lit(1)).alias("n_batches"),
                                           F.avg("log_loss").alias("loss"))


def batch_objectives(slots: DataFrame, scope: int = EXPOSURE_SCOPE,
                     target: Sequence[float] = TARGET_EXPOSURE, eps: float = KL_EPS,
                     cate_col: str = "cate") -> DataFrame:
    """``(batch, log_loss, js)``: mean log loss of the batch's slots, and M4
    (with M3): k-hot top-``scope`` picks of every list -> category share of the
    batch's picks -> 0.5 KL(share, m) + 0.5 KL(target, m) with
    m = (share + target) / 2 and KL(p, q) = sum p ln(p / (q + eps))
    (0 ln 0 = 0).  The categories are those of the data and of the target; a
    null category is an error.

    Every list is ranked once; slots collapse to (batch, category), and those
    to one map per batch."""
    picked = khot_pick(slots, scope)
    per = picked.groupBy("batch", mapped_category(cate_col).alias("cate")).agg(
        F.sum("pick").alias("n"), F.sum(log_loss_term()).alias("s"),
        F.count(log_loss_term()).alias("c"))
    b = per.groupBy("batch").agg(
        F.map_from_entries(F.collect_list(F.struct("cate", "n"))).alias("n_of"),
        F.sum("n").alias("n"), (-F.sum("s") / F.sum("c")).alias("log_loss"))
    goal = F.array(*[F.lit(float(t)) for t in target])

    def term(c):
        share = F.coalesce(F.element_at("n_of", c), F.lit(0)) / F.col("n")
        want = F.coalesce(F.get(goal, c), F.lit(0.0))
        m = (share + want) / 2
        return 0.5 * smoothed_kl_term(share, m, eps) + 0.5 * smoothed_kl_term(want, m, eps)

    cates = F.array_union(F.map_keys("n_of"), F.sequence(F.lit(0), F.lit(len(target) - 1)))
    return b.select("batch", "log_loss", F.aggregate(
        F.transform(cates, term), F.lit(0.0), lambda acc, x: acc + x).alias("js"))


def batch_js_loss(slots: DataFrame, **kw) -> DataFrame:
    """M4: the exposure divergence of every batch."""
    return batch_objectives(slots, **kw).select("batch", "js")


def combined_loss(slots: DataFrame, js_lambda: float = JS_LAMBDA, **kw) -> DataFrame:
    """M6: per batch 2 lambda logloss + 2 (1 - lambda) JS."""
    return batch_objectives(slots, **kw).withColumn(
        "loss", 2 * js_lambda * F.col("log_loss") + 2 * (1 - js_lambda) * F.col("js"))
