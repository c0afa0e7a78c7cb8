"""Hot-key and fallback paths, on data derived from the given tables."""

import os
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatekit.operators import embeddings as EM
from slatekit.operators import history as H
from slatekit.operators import impressions as I
from slatekit.operators import sampling as S
from slatekit.operators import vocab as VO
from slatekit.plans import views as V
from tests.conftest import SF_MID, SF_SMALL


def _hot_user_imps(spark):
    """View A with a third of all events moved to user 0 (a hot key)."""
    base = V.impressions_base(spark, SF_MID)
    return base.withColumn("user_id", F.when(F.col("imp_id") % 3 == 0, F.lit(0))
                           .otherwise(F.col("user_id")))


def test_hot_user_history_and_sampling_split_equals_plain(spark):
    base = _hot_user_imps(spark)
    spark.conf.set("spark.slatekit.splitRows", "500")      # user 0 holds ~3,400 rows
    try:
        split_h = {r["imp_id"]: r["hist"] for r in H.history_asof(base).collect()}
        log = I.prepare_log(I.with_hist_len(H.history_asof(base)))
        split_n = sorted(tuple(r) for r in S.neg_sample(log).select(
            "list_id", "neg_id", "src", "t").collect())
    finally:
        spark.conf.unset("spark.slatekit.splitRows")
    plain_h = {r["imp_id"]: r["hist"] for r in H.history_asof(base).collect()}
    log = I.prepare_log(I.with_hist_len(H.history_asof(base)))
    plain_n = sorted(tuple(r) for r in S.neg_sample(log).select(
        "list_id", "neg_id", "src", "t").collect())
    assert split_h == plain_h
    assert split_n == plain_n and len(plain_n) > 0


def test_attention_pool_matches_row_by_row_maths(spark):
    from slatekit.queries import _dataset
    ds, vocab = _dataset(spark, SF_SMALL)
    vecs = V.item_vectors(spark, SF_SMALL, vocab)
    v = {r["item_id"]: np.asarray(r["vec"], dtype=float) for r in vecs.collect()} | {0: np.zeros(64)}
    got = {(r["list_id"], r["slot"]): r["pooled"] for r in EM.attention_pool(ds, vecs).collect()}
    lists = ds.collect()
    assert len(got) == sum(len(r["candi"]) for r in lists) > 0
    for r in lists:
        k = [sum(v[i] for i in h[:6]) for h in r["hist"][:r["hist_len"]]]
        k = np.asarray([x for x in k if x.sum() != 0]).reshape(-1, 64)
        for slot, c in enumerate(r["candi"]):
            s = k @ sum(v[i] for i in c[:6]) / 8
            w = np.exp(s - s.max(initial=-np.inf)) if len(k) else s
            want = (w / w.sum()) @ k if len(k) else np.zeros(64)
            assert np.allclose(got[(r["list_id"], slot)], want)


def test_feature_id_without_a_vector_is_an_error(spark):
    rows = spark.createDataFrame([(1, [0, 7])], "k int, ids array<bigint>")
    vecs = spark.createDataFrame([(5, [1.0])], "item_id bigint, vec array<double>")
    with pytest.raises(Exception, match="without a vector"):
        EM.lookup_vectors(rows, ["k"], F.col("ids"), vecs).collect()


def test_paced_replay_runs_several_batches(spark):
    from slatekit.queries import _requests
    from slatekit.sources import kafka as K
    from slatekit.streaming import scoring as SC
    base = tempfile.mkdtemp(prefix="slatekit-replay-")
    _requests(spark, SF_SMALL).repartition(3).write.parquet(f"{base}/src")
    src = K.read_request_files(spark, f"{base}/src", max_files_per_trigger=1)
    SC.run_stream_scoring(spark, src, f"{base}/out", f"{base}/ckpt")
    batches = [d for d in os.listdir(f"{base}/out") if d.startswith("batch_id=")]
    assert len(batches) >= 3


def test_encoding_joins_nulls_unseen_and_repeats(spark):
    vocab = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("a", "y", 3)],
                                  "ns string, value string, id bigint")
    df = spark.createDataFrame([(1, "x", [["x", "x"], ["y", "z"]]), (2, None, []), (3, "q", None),
                                (4, "x", [[None, "x"]])], "k int, v string, hist array<array<string>>")
    enc = VO.encode_steps(VO.encode_fields(df, vocab, {"v": "a"}), vocab, ["k"], namespaces=["a", "b"])
    assert sorted((r["k"], r["v_id"], r["hist_ids"]) for r in enc.collect()) == [
        (1, 1, [[1, 2], [3, 0]]), (2, 0, []), (3, 0, []), (4, 1, [[0, 2]])]


def test_plan_of_a_large_vocabulary_is_built_at_once(spark):
    vocab = spark.range(100_000).select(F.lit("a").alias("ns"), F.col("id").cast("string")
                                        .alias("value"), (F.col("id") + 1).alias("id"))
    t = time.time()
    enc = VO.encode_fields(spark.range(10).withColumnRenamed("id", "v"), vocab, {"v": "a"})
    plan = enc._jdf.queryExecution().executedPlan().toString()
    assert time.time() - t < 2 and "Join" in plan
    assert [r["v_id"] for r in enc.orderBy("v").collect()] == list(range(1, 11))


def _five_categories(spark):
    return V.impressions_base(spark, SF_SMALL).withColumn(
        "bc_type", F.least(F.floor(F.rand(3) * 5), F.lit(4)).cast("string"))


def test_five_categories_keep_every_candidate_and_exposure(spark):
    from slatekit.operators import lists as L
    from slatekit.operators import losses as LO
    from slatekit.operators import metrics as M
    from slatekit.sources.files import stage
    base = stage(_five_categories(spark), "five")
    log = stage(I.prepare_log(I.with_hist_len(H.history_asof(base))), "five-log")
    vocab = stage(VO.build_vocab(base, log), "five-vocab")
    ds = L.with_categories(L.build_dataset(base, log, vocab), VO.cate_index(vocab))
    wide = ds.select("list_id", "n_cate", F.size("candi").alias("n"), *L.cate_split_candidates())
    r = wide.agg(F.min("n_cate"), F.sum("n"), F.sum(F.aggregate(
        "candi_len_c", F.lit(0), lambda a, x: a + x))).first()
    assert r[0] == 5 and r[1] == r[2] > 0
    slots = V.served(spark, SF_SMALL).withColumn("cate", (F.col("slot") % 5).cast("int"))
    expo = {x["cate"]: x["exposure"] for x in M.exposure_counts(slots).collect()}
    lists = slots.groupBy("list_id").count().select(F.sum(F.least("count", F.lit(5)))).first()[0]
    assert set(expo) == set(range(5)) and sum(expo.values()) == lists
    per = {x["cate"]: x for x in M.with_target(M.exposure_counts(slots)).collect()}
    assert per[4]["target"] == 0 and abs(sum(x["ratio"] for x in per.values()) - 1) < 1e-9
    js = LO.batch_js_loss(slots.withColumn("batch", F.lit(0))).first()["js"]
    assert abs(js - M.exposure_js(slots).first()["js"]) < 1e-6
    with pytest.raises(Exception, match="without a category"):
        M.exposure_counts(slots.withColumn("cate", F.lit(None).cast("int"))).collect()
    with pytest.raises(Exception, match="without an index"):
        ds.withColumn("cmap", F.map_filter("cmap", lambda k, v: v < 4)).select(
            *L.cate_split_candidates()).collect()
