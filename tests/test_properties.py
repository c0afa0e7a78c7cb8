"""Properties from the test strategy: bijections, conservation, bounds."""

import math

import pytest
from pyspark.sql import functions as F

from slatekit.operators import lists as L
from slatekit.operators import metrics as M
from slatekit.operators import ranking as R
from slatekit.operators import vocab as VO
from slatekit.plans import views as V
from tests.conftest import SF_SMALL


def test_vocab_is_a_bijection_onto_1_n(spark):
    from slatekit.queries import _log_and_vocab
    _, _, vocab = _log_and_vocab(spark, SF_SMALL)
    rows = vocab.collect()
    ids = sorted(r["id"] for r in rows)
    assert ids == list(range(1, len(rows) + 1))
    assert len({(r["ns"], r["value"]) for r in rows}) == len(rows)


def test_category_split_keeps_every_candidate(spark):
    from slatekit.queries import _dataset
    ds, vocab = _dataset(spark, SF_SMALL)
    wide = L.with_categories(ds, VO.cate_index(vocab)).select(
        "list_id", "candi", *L.cate_split_candidates())
    lay = L.slot_layout(wide).where("mask = 1").groupBy("list_id").agg(
        F.sort_array(F.collect_list(F.array_join("item", ","))).alias("a"))
    orig = ds.select("list_id", F.sort_array(F.transform("candi", lambda c: F.array_join(c, ",")))
                     .alias("b"))
    assert lay.join(orig, "list_id").where("a != b").count() == 0


def test_ndcg_is_one_when_preds_equal_labels(spark):
    s = V.served(spark, SF_SMALL).withColumn("pred", F.col("label").cast("double"))
    lm = R.list_metrics(s, [1, 5, 7])
    with_pos = s.groupBy("list_id").agg(F.sum("label").alias("p")).where("p > 0")
    bad = lm.join(with_pos, "list_id").where(F.abs(F.col("ndcg") - 1) > 1e-12)
    assert bad.count() == 0


def test_js_symmetric_and_bounded(spark):
    d = spark.createDataFrame([(0, 0.7, 0.1), (1, 0.2, 0.3), (2, 0.1, 0.6)],
                              "c int, p double, q double")
    a = M.js_divergence(d, "p", "q").first()["js"]
    b = M.js_divergence(d, "q", "p").first()["js"]
    assert a == pytest.approx(b) and 0 <= a <= math.log(2)
