import math

import pytest
from pyspark.sql import functions as F

from slatekit.functions.exprs import score_bucket
from slatekit.operators import metrics as M
from slatekit.operators import ranking as R

SCHEMA = "list_id bigint, slot bigint, pred double, label int, cate int"


def test_rerank_ties_keep_slot_order(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 0, 0), (1, 1, 0.5, 1, 0), (1, 2, 0.9, 0, 0)], SCHEMA)
    ranks = {r["slot"]: r["rank"] for r in R.rerank(df).collect()}
    assert ranks == {2: 1, 0: 2, 1: 3}


def test_map_and_ndcg_edge_cases(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 0, 0), (1, 1, 0.1, 1, 0),   # hit only at rank 2
                                (2, 0, 0.9, 0, 0), (2, 1, 0.1, 0, 0),   # no positive
                                (3, 0, 0.9, 1, 0), (3, 1, 0.1, 0, 0)],  # perfect
                               SCHEMA)
    m = {(r["list_id"], r["k"]): r for r in R.list_metrics(df, [1, 2]).collect()}
    assert m[(1, 1)]["map"] == 0.0 and m[(1, 1)]["ndcg"] == 0.0
    assert m[(1, 2)]["map"] == pytest.approx(0.5)
    assert m[(1, 2)]["ndcg"] == pytest.approx(1 / math.log2(3))
    assert m[(2, 2)]["ndcg"] == 0.0 and m[(2, 2)]["map"] == 0.0
    assert m[(3, 1)]["ndcg"] == 1.0 and m[(3, 2)]["utility"] == 1.0


def test_exposure_absent_category_and_js(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 1, 0), (1, 1, 0.8, 0, 1)], SCHEMA)
    e = {r["cate"]: r for r in M.exposure_counts(df, 5, 3).collect()}
    assert e[2]["exposure"] == 0 and e[2]["ratio"] == 0.0
    same = spark.createDataFrame([(0, 0.5, 0.5), (1, 0.5, 0.5)], "c int, p double, q double")
    assert M.js_divergence(same, "p", "q").first()["js"] == pytest.approx(0.0)
    disj = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0)], "c int, p double, q double")
    assert M.js_divergence(disj, "p", "q").first()["js"] == pytest.approx(math.log(2))


def test_auc_symmetry_and_half_even_bucket(spark):
    df = spark.createDataFrame([(1, i, p, l, 0) for i, (p, l) in enumerate(
        [(0.1, 0), (0.4, 1), (0.35, 0), (0.8, 1), (0.4, 0)])], SCHEMA)
    a = M.auc(df).first()["auc"]
    b = M.auc(df.withColumn("pred", -F.col("pred"))).first()["auc"]
    assert a + b == pytest.approx(1.0)
    r = spark.createDataFrame([(0.25,), (0.35,)], "s double").select(score_bucket("s").alias("b"))
    assert [x["b"] for x in r.collect()] == [2, 4]
