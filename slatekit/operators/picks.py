"""Top-k picks with noise and their relaxed form.

Noise is a hash-derived uniform per (list, slot), so picks are reproducible
and partition-independent.  Lists are slates (bounded), so a list's scores
fit one array; the relaxed rounds run as array expressions after a single
group-by-list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatekit.config import DEFAULT_SEED, GUMBEL_EPS, GUMBEL_TAU
from slatekit.functions.exprs import uniform01
from slatekit.operators.ranking import rank_window

LOG_FLOOR = 1e-20


def gumbel_noise(*keys: str | Column, seed: str = DEFAULT_SEED, eps: float = GUMBEL_EPS) -> Column:
    """-ln(-ln(U + eps) + eps) with U uniform in [0, 1) from the keys' hash."""
    u = uniform01(*keys, seed=seed)
    return -F.log(-F.log(u + eps) + eps)


def gumbel_topk(df: DataFrame, k: int, list_col: str = "list_id", score_col: str = "pred",
                slot_col: str = "slot", pick_col: str = "pick",
                seed: str = DEFAULT_SEED) -> DataFrame:
    """Perturb scores with Gumbel noise and pick the top k per list
    (with a log-weight score this is weighted sampling without
    replacement)."""
    x = df.withColumn("_g", F.col(score_col) + gumbel_noise(list_col, slot_col, seed=seed))
    r = F.row_number().over(rank_window(list_col, "_g", slot_col))
    return x.withColumn(pick_col, F.when(r <= k, 1).otherwise(0)).drop("_g")


def relaxed_topk(df: DataFrame, k: int, tau: float = GUMBEL_TAU, noise: bool = True,
                 list_col: str = "list_id", score_col: str = "pred", slot_col: str = "slot",
                 seed: str = DEFAULT_SEED) -> DataFrame:
    """K rounds of softmax(score / tau); after each round the scores
    are masked with ln(1 - p) (floored at 1e-20) and the round's softmax is
    accumulated into ``khot``; ``pick`` is the top-k of ``khot`` (the
    forward value of the straight-through pick).  Output: one row per slot
    with ``khot`` and ``pick``."""
    s = F.col(score_col)
    if noise:
        s = s + gumbel_noise(list_col, slot_col, seed=seed)
    per = df.groupBy(list_col).agg(F.array_sort(F.collect_list(
        F.struct(F.col(slot_col).alias("slot"), s.alias("s")))).alias("_e"))
    x = per.select(list_col, F.transform("_e", lambda e: e["slot"]).alias("_slots"),
                   F.transform("_e", lambda e: e["s"].cast("double")).alias("_s"))
    x = x.withColumn("_khot", F.transform("_s", lambda v: F.lit(0.0)))
    x = x.withColumn("_oh", F.col("_khot"))
    for _ in range(k):
        x = x.withColumn("_s", F.zip_with("_s", "_oh", lambda v, p: v + F.log(
            F.greatest(1 - p, F.lit(LOG_FLOOR)))))
        x = x.withColumn("_mx", F.array_max(F.transform("_s", lambda v: v / tau)))
        x = x.withColumn("_ex", F.transform("_s", lambda v: F.exp(v / tau - F.col("_mx"))))
        x = x.withColumn("_tot", F.aggregate("_ex", F.lit(0.0), lambda a, v: a + v))
        x = x.withColumn("_oh", F.transform("_ex", lambda v: v / F.col("_tot")))
        x = x.withColumn("_khot", F.zip_with("_khot", "_oh", lambda a, b: a + b))
    out = x.select(list_col, F.posexplode(F.arrays_zip(
        F.col("_slots").alias("slot"), F.col("_khot").alias("khot"))).alias("_i", "_z"))
    out = out.select(list_col, F.col("_z.slot").alias(slot_col), F.col("_z.khot").alias("khot"))
    r = F.row_number().over(rank_window(list_col, "khot", slot_col))
    return out.withColumn("pick", F.when(r <= k, 1).otherwise(0))
