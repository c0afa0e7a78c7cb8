"""Exposure, divergences, losses, AUC and list checks.

Divergences work on *long* distributions: one row per (group..., category)
with probability columns, so they are plain aggregations and need no arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatekit.config import EXPOSURE_SCOPE, KL_EPS, LOGLOSS_EPS, TARGET_EXPOSURE
from slatekit.operators.ranking import ListKey, key_columns, rank_window
from slatekit.plans.indexing import ordered_scan

AUC_BINS = 4096


def target_frame(spark: SparkSession, ratios: Sequence[float] = TARGET_EXPOSURE,
                 col: str = "cate", value: str = "target") -> DataFrame:
    return spark.createDataFrame([(i, float(r)) for i, r in enumerate(ratios)],
                                 f"{col} int, {value} double")


def mapped_category(cate: str = "cate", n_cate: int | None = None) -> Column:
    """The category index, an error where it is null (or not one of ``n_cate``):
    an exposure without a category would silently raise the other shares."""
    c = F.col(cate).cast("int")
    known = c if n_cate is None else F.when(c.between(0, n_cate - 1), c)
    return F.coalesce(known, F.raise_error(F.lit("exposure without a category")).cast("int"))


def exposure_counts(df: DataFrame, scope: int = EXPOSURE_SCOPE, n_cate: int | None = None,
                    is_rank: bool = True, list_col: ListKey = "list_id", score_col: str = "pred",
                    slot_col: str = "slot", cate_col: str = "cate") -> DataFrame:
    """Exposures per category among the top ``scope`` slots of every
    list, and their share.  The categories are those of the data, or 0 to
    ``n_cate - 1`` (the size of the category index) where given: one that is
    never shown is present with 0, a null or unknown one is an error."""
    shown = F.col(slot_col) < scope
    if is_rank:
        shown = F.row_number().over(rank_window(list_col, score_col, slot_col)) <= scope
    out = (df.select(mapped_category(cate_col, n_cate).alias("cate"), shown.alias("_s"))
           .groupBy("cate").agg(F.count_if("_s").cast("bigint").alias("exposure")))
    if n_cate is not None:
        known = df.sparkSession.range(n_cate).select(F.col("id").cast("int").alias("cate"))
        out = known.join(F.broadcast(out), "cate", "left").fillna(0, ["exposure"])
    total = F.sum("exposure").over(Window.partitionBy())  # one row per category
    return out.select("cate", "exposure", (F.col("exposure") / total).alias("ratio"))


def with_target(expo: DataFrame, target: Sequence[float] = TARGET_EXPOSURE) -> DataFrame:
    """Exposure shares beside their targets; a category on one side only has 0
    on the other."""
    t = F.broadcast(target_frame(expo.sparkSession, target))
    known = F.broadcast(expo.select("cate"))                # one row per category
    return (expo.join(t, "cate", "left")
            .unionByName(t.join(known, "cate", "left_anti"), allowMissingColumns=True)
            .fillna(0, ["exposure", "ratio", "target"]))


def _kl_term(p: str, q: str) -> Column:
    return (F.when(F.col(p) <= 0, F.lit(0.0)).when(F.col(q) <= 0, F.lit(float("inf")))
            .otherwise(F.col(p) * F.log(F.col(p) / F.col(q))))


def kl_divergence(dist: DataFrame, p_col: str, q_col: str, group_cols: Sequence[str] = (),
                  out_col: str = "kl") -> DataFrame:
    """M1: KL(p || q) with both inputs normalised to sum 1, natural log;
    terms with p = 0 contribute 0; p > 0 with q = 0 gives +infinity."""
    g = list(group_cols)
    w = Window.partitionBy(*g)
    pn = F.col(p_col) / F.sum(p_col).over(w)
    qn = F.col(q_col) / F.sum(q_col).over(w)
    t = dist.select(*g, pn.alias("_p"), qn.alias("_q"))
    return t.groupBy(*g).agg(F.sum(_kl_term("_p", "_q")).alias(out_col))


def js_divergence(dist: DataFrame, p_col: str, q_col: str, group_cols: Sequence[str] = (),
                  out_col: str = "js") -> DataFrame:
    """M2: JS(p, q) = 0.5 KL(p, m) + 0.5 KL(q, m) with m = (p + q) / 2 taken
    before normalisation; natural log, no square root.  One pass: both terms
    share the window totals and the aggregate."""
    g = list(group_cols)
    w = Window.partitionBy(*g)
    m = (F.col(p_col) + F.col(q_col)) / 2
    t = dist.select(*g, (F.col(p_col) / F.sum(p_col).over(w)).alias("_p"),
                    (F.col(q_col) / F.sum(q_col).over(w)).alias("_q"),
                    (m / F.sum(m).over(w)).alias("_m"))
    return t.groupBy(*g).agg((0.5 * F.sum(_kl_term("_p", "_m")) + 0.5 * F.sum(_kl_term("_q", "_m")))
                             .alias(out_col))


def smoothed_kl_term(p: Column, q: Column, eps: float = KL_EPS) -> Column:
    """M3: one term of sum p * ln(p / (q + eps)), unnormalised; 0 * ln 0 counts as 0."""
    return F.when(p <= 0, F.lit(0.0)).otherwise(p * F.log(p / (q + eps)))


def exposure_js(df: DataFrame, target: Sequence[float] = TARGET_EXPOSURE,
                scope: int = EXPOSURE_SCOPE, is_rank: bool = True, **cols) -> DataFrame:
    """JS divergence between the target exposure ratio and the realised one."""
    dist = with_target(exposure_counts(df, scope, is_rank=is_rank, **cols), target)
    return js_divergence(dist, "target", "ratio", (), "js")


def log_loss(df: DataFrame, label_col: str = "label", pred_col: str = "pred",
             mask_col: str | None = None, eps: float = LOGLOSS_EPS,
             group_cols: Sequence[str] = ()) -> DataFrame:
    """M5: -mean(y ln(p + eps) + (1 - y) ln(1 - p + eps)).  With ``mask_col``
    only rows whose mask is 1 count (padding excluded)."""
    y, p = F.col(label_col).cast("double"), F.col(pred_col).cast("double")
    term = y * F.log(p + eps) + (1 - y) * F.log(1 - p + eps)
    src = df.where(F.col(mask_col) == 1) if mask_col else df
    return src.groupBy(*group_cols).agg((-F.avg(term)).alias("log_loss"))


def auc_binned(df: DataFrame, n_bins: int = AUC_BINS, label_col: str = "label",
               pred_col: str = "pred", mask_col: str | None = None) -> DataFrame:
    """A16 for scores too many to sort: positives and negatives counted in
    ``n_bins`` equal bins of scores in [0, 1] (one partial aggregate; sketches of
    parts of the data merge by adding counts), and the AUC with its bounds.

    Only pairs inside a bin are undecided, so the exact value lies between
    ``auc_low`` (all of them wrong) and ``auc_high`` (all right); ``auc`` counts
    them half and is at most ``error`` away.  Scores outside [0, 1] are counted in
    the first or last bin, where the bound holds all the same."""
    src = df.where(F.col(mask_col) == 1) if mask_col else df
    at = F.least(F.greatest(F.floor(F.col(pred_col).cast("double") * n_bins), F.lit(0)),
                 F.lit(n_bins - 1))
    pos = F.col(label_col) >= 1
    bins = src.groupBy(at.alias("bin")).agg(F.count_if(pos).alias("npos"),
                                            F.count_if(~pos).alias("nneg"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)    # <= n_bins rows
    x = bins.withColumn("below", F.coalesce(F.sum("nneg").over(below), F.lit(0)))
    pairs = F.sum("npos") * F.sum("nneg")
    won, open_ = F.sum(F.col("npos") * F.col("below")), F.sum(F.col("npos") * F.col("nneg"))
    return x.agg(F.try_divide(won, pairs).alias("auc_low"),
                 F.try_divide(won + 0.5 * open_, pairs).alias("auc"),
                 F.try_divide(won + open_, pairs).alias("auc_high"),
                 F.try_divide(0.5 * open_, pairs).alias("error"))


def auc(df: DataFrame, label_col: str = "label", pred_col: str = "pred",
        mask_col: str | None = None) -> DataFrame:
    """Pooled ROC-AUC, exact Mann-Whitney with average rank for ties.

    Rows collapse to one row per distinct score (partial aggregate); the
    running count of negatives below each score is an ordered scan that
    splits the score range across tasks, so no step runs in one partition.
    """
    src = df.where(F.col(mask_col) == 1) if mask_col else df
    per = src.groupBy(F.col(pred_col).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(label_col) >= 1, 1).otherwise(0)).cast("bigint").alias("npos"),
        F.sum(F.when(F.col(label_col) >= 1, 0).otherwise(1)).cast("bigint").alias("nneg"))
    scanned = ordered_scan(per, ["s"], idx_col=None, sums={"neg_le": "nneg"})
    contrib = F.col("npos") * (F.col("neg_le") - F.col("nneg") + 0.5 * F.col("nneg"))
    return scanned.agg(
        (F.sum(contrib) / (F.sum("npos") * F.sum("nneg"))).alias("auc"))


def lists_without_positive(df: DataFrame, list_col: ListKey = "list_id",
                           label_col: str = "label") -> DataFrame:
    """Lists whose labels sum to 0."""
    return (df.groupBy(*key_columns(list_col)).agg(F.sum(label_col).cast("bigint").alias("n_pos"),
                                      F.count(F.lit(1)).alias("n_slots"))
            .where(F.col("n_pos") == 0))


def score_heads(df: DataFrame, logit_col: str, list_col: ListKey = "list_id") -> DataFrame:
    """M7: sigmoid head and list-softmax head (max-shifted) of a logit."""
    w = Window.partitionBy(*key_columns(list_col))
    shifted = F.exp(F.col(logit_col) - F.max(logit_col).over(w))
    return df.withColumn("sigmoid", 1 / (1 + F.exp(-F.col(logit_col)))) \
             .withColumn("_e", shifted) \
             .withColumn("softmax", F.col("_e") / F.sum("_e").over(w)).drop("_e")
