"""Ranking windows, cutoff metrics and top-k picks over served lists.

Long list layout: one row per (list, slot) with a score and a label.  A list
is one column or several (ids that start anew in every split need ``split``
beside them).  Lists are slates (bounded by category count x list length), so
per-list windows are short; the metrics shuffle whole lists once, plain top-k
picks are cut by a partial ``WindowGroupLimit`` before their shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatekit.config import METRIC_SCOPES


ListKey = str | Sequence[str]


def key_columns(list_col: ListKey) -> list[str]:
    return [list_col] if isinstance(list_col, str) else list(list_col)


def rank_window(list_col: ListKey = "list_id", score_col: str = "pred", slot_col: str = "slot"):
    """Stable descending order: ties keep slot order (Python's stable sort)."""
    return Window.partitionBy(*key_columns(list_col)).orderBy(F.col(score_col).desc(), F.col(slot_col).asc())


def rerank(df: DataFrame, list_col: ListKey = "list_id", score_col: str = "pred",
           slot_col: str = "slot", rank_col: str = "rank") -> DataFrame:
    """1-based rank of every slot by score desc, ties by slot."""
    return df.withColumn(rank_col, F.row_number().over(
        rank_window(list_col, score_col, slot_col)).cast("bigint"))


def initial_rank(df: DataFrame, slot_col: str = "slot", rank_col: str = "rank") -> DataFrame:
    """Identity ranking (the initial ranker keeps slot order); no shuffle."""
    return df.withColumn(rank_col, (F.col(slot_col) + 1).cast("bigint"))


def ideal_rank(df: DataFrame, list_col: ListKey = "list_id", label_col: str = "label",
               slot_col: str = "slot", rank_col: str = "ideal_rank") -> DataFrame:
    """Ideal ranking by label desc, ties by slot."""
    return df.withColumn(rank_col, F.row_number().over(
        rank_window(list_col, label_col, slot_col)).cast("bigint"))


def top_k(df: DataFrame, k: int, list_col: ListKey = "list_id", score_col: str = "pred",
          slot_col: str = "slot", rank_col: str = "rank") -> DataFrame:
    """Rows ranked <= k per list (planned as partial + final WindowGroupLimit)."""
    r = F.row_number().over(rank_window(list_col, score_col, slot_col))
    return df.withColumn(rank_col, r.cast("bigint")).where(F.col(rank_col) <= k)


def _idcg_binary(npos, k):
    """Ideal DCG of a binary-label list: sum_{i=1..min(k,npos)} 1/log2(i+1)."""
    m = F.least(npos.cast("int"), k.cast("int"))
    return F.when(m >= 1, F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0),
                                      lambda acc, i: acc + 1.0 / F.log2(i + 1))).otherwise(0.0)


def list_metrics(df: DataFrame, scopes: Sequence[int] = METRIC_SCOPES, is_rank: bool = True,
                 list_col: ListKey = "list_id", score_col: str = "pred", slot_col: str = "slot",
                 label_col: str = "label", graded: bool = True) -> DataFrame:
    """Per (list, k): ndcg, map, utility at cutoff ``min(k, list length)``.

    NDCG gain 2^label - 1 with discount log2(i + 1), 0 when the ideal DCG is 0.
    MAP sums precision at each hit within k and divides by the hits within k.
    Utility is the sum of labels within k.  With ``is_rank`` False the
    identity (initial) order is evaluated.  The ideal DCG ranks the labels;
    ``graded=False`` takes the closed form that only holds for 0/1 labels.

    One shuffle by list: ranks and running hits are windows over the list, and
    one aggregate per list holds a conditional sum per cutoff.
    """
    keys = ["list_id"] if isinstance(list_col, str) else list(list_col)
    x = df.select(*[F.col(c).alias(k) for c, k in zip(key_columns(list_col), keys)],
                  F.col(slot_col).alias("slot"), F.col(score_col).alias("score"),
                  F.col(label_col).alias("label"))
    w = rank_window(keys, "score", "slot") if is_rank else \
        Window.partitionBy(*keys).orderBy("slot")
    hit = F.col("label") >= 1
    x = x.select("*", (F.row_number().over(w) if is_rank else F.col("slot") + 1).alias("r"),
                 F.count_if(hit).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    if graded:
        x = ideal_rank(x, keys, "label", "slot", "ir")
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    r = F.col("r")

    def at(k):
        top = r <= k
        if graded:
            ideal = F.sum(F.when(F.col("ir") <= k, gain / F.log2(F.col("ir") + 1)))
        else:
            ideal = _idcg_binary(F.count_if(hit), F.lit(k))
        return F.struct(
            F.lit(k).alias("k"), F.sum(F.when(top, gain / F.log2(r + 1))).alias("dcg"),
            F.sum(F.when(top & hit, F.col("hits") / r)).alias("ap_value"),
            F.count_if(top & hit).alias("ap_count"),
            F.sum(F.when(top, F.col("label"))).alias("utility"), ideal.alias("idcg"))

    per = x.groupBy(*keys).agg(F.array(*[at(int(k)) for k in scopes]).alias("_k"))
    per = per.select(*keys, F.inline("_k"))
    return per.select(
        *keys, "k",
        F.when(F.col("idcg") != 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
        F.when(F.col("ap_count") != 0, F.col("ap_value") / F.col("ap_count"))
         .otherwise(0.0).alias("map"),
        F.col("utility").cast("double").alias("utility"))


def rank_metrics(df: DataFrame, scopes: Sequence[int] = METRIC_SCOPES, is_rank: bool = True,
                 **cols) -> DataFrame:
    """Mean of the per-list metrics for every cutoff."""
    return (list_metrics(df, scopes, is_rank, **cols).groupBy("k")
            .agg(F.count(F.lit(1)).alias("n_lists"), F.avg("ndcg").alias("ndcg"),
                 F.avg("map").alias("map"), F.avg("utility").alias("utility")))


def khot_pick(df: DataFrame, k: int, list_col: ListKey = "list_id", score_col: str = "pred",
              slot_col: str = "slot", pick_col: str = "pick") -> DataFrame:
    """0/1 pick of the top-k slots per list (forward value of the
    straight-through pick)."""
    r = F.row_number().over(rank_window(list_col, score_col, slot_col))
    return df.withColumn(pick_col, F.when(r <= k, 1).otherwise(0))


def join_predictions(preds: DataFrame, labels: DataFrame,
                     keys: Sequence[str] = ("split", "list_id", "slot")) -> DataFrame:
    """Predictions joined to labels on (split, list, slot) (inner equi-join;
    both sides are keyed by list, so the join is co-partitioned by list)."""
    return preds.join(labels, list(keys), "inner")
