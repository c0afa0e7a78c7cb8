import json
import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import functions as F

from slatekit.sources import kafka as K
from slatekit.streaming import requests as RQ
from slatekit.streaming import scoring as SC

BATCHED = {"inputs/usr_ph": [[1, 2, 3, 4, 5, 6]], "inputs/candi_itm_ft": [[[[1] * 7, [2] * 7]]],
           "inputs/candi_list_len": [[1]], "inputs/lb": [[[1, 0]]],
           "inputs/cate_hist_ft": [[[[1] * 6]]], "inputs/cate_hist_len": [[1]],
           "inputs/union_hist_ft": [[[1] * 6]], "inputs/union_hist_len": [1],
           "inputs/keep_prob": 1.0, "inputs/is_train": False}


def _records(spark, payloads):
    rows = [(str(i).encode(), p.encode(), "t", 0, i) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, "
                                       "offset bigint").withColumn("timestamp", F.current_timestamp())


def test_parse_both_nestings_and_quarantine(spark):
    unbatched = {k: (v[0] if isinstance(v, list) else v) for k, v in BATCHED.items()}
    good, bad = RQ.parse_requests(_records(spark, [json.dumps(BATCHED), json.dumps(unbatched),
                                                   json.dumps(BATCHED)[:30], "not json"]))
    rows = {r["key"]: r for r in good.collect()}
    assert set(rows) == {"0", "1"}
    assert rows["0"]["usr_ph"] == rows["1"]["usr_ph"] == [1, 2, 3, 4, 5, 6]
    assert rows["1"]["union_hist_len"] == 1 and rows["0"]["keep_prob"] == 1.0
    assert {r["key"] for r in bad.collect()} == {"2", "3"}


def test_stream_matches_batch_and_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="slatekit-stream-")
    recs = _records(spark, [json.dumps(BATCHED)] * 3)
    recs.repartition(3).write.parquet(f"{base}/src")
    src = K.read_request_files(spark, f"{base}/src", max_files_per_trigger=1)
    SC.run_stream_scoring(spark, src, f"{base}/out", f"{base}/ckpt")
    first = spark.read.parquet(f"{base}/out").count()
    # restart from the same checkpoint: nothing new, nothing written twice
    src = K.read_request_files(spark, f"{base}/src", max_files_per_trigger=1)
    SC.run_stream_scoring(spark, src, f"{base}/out", f"{base}/ckpt")
    assert spark.read.parquet(f"{base}/out").count() == first == 3 * 2
    parsed, _ = RQ.parse_requests(recs)
    batch = {(r["key"], r["slot"]): r["pred"] for r in SC.score_requests(parsed).collect()}
    streamed = {(r["key"], r["slot"]): r["pred"]
                for r in spark.read.parquet(f"{base}/out").collect()}
    assert batch == streamed
    assert [d for d in os.listdir(f"{base}/out") if d.startswith("batch_id=")]


def test_empty_batch_skipped(spark):
    base = tempfile.mkdtemp(prefix="slatekit-empty-")
    SC.scoring_batch(f"{base}/out")(_records(spark, ["x"]).limit(0), 0)
    assert not os.path.exists(f"{base}/out")


def test_batches_are_not_kept_in_memory(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="slatekit-kept-")
    levels, kind = [], type(spark.range(1))
    real = kind.persist

    def kept(self, *level):
        levels.append(level)
        return real(self, *level)
    monkeypatch.setattr(kind, "persist", kept)
    recs = _records(spark, [json.dumps(BATCHED), "{"])
    SC.scoring_batch(f"{base}/out")(recs, 0)                       # the parse has one reader
    assert not levels
    SC.scoring_batch(f"{base}/out2", f"{base}/bad")(recs, 0)
    assert levels == [(StorageLevel.DISK_ONLY,)]
    one, two = (sorted(map(tuple, spark.read.parquet(f"{base}/{p}").select("key", "slot", "pred").collect())) for p in ("out", "out2"))
    assert one == two and spark.read.parquet(f"{base}/bad").count() == 1


def test_stream_quarantines_broken_records(spark):
    base = tempfile.mkdtemp(prefix="slatekit-q-")
    recs = _records(spark, [json.dumps(BATCHED), "{\"inputs/usr_ph\": [[1,"])
    recs.coalesce(1).write.parquet(f"{base}/src")
    src = K.read_request_files(spark, f"{base}/src")
    SC.run_stream_scoring(spark, src, f"{base}/out", f"{base}/ckpt", f"{base}/bad")
    assert spark.read.parquet(f"{base}/out").select("key").distinct().count() == 1
    bad = spark.read.parquet(f"{base}/bad").collect()
    assert [r["key"] for r in bad] == ["1"] and bad[0]["raw"].startswith("{")


def test_signature_aliases_and_history_flags(spark):
    aliased = dict(BATCHED)
    aliased["inputs/labels"] = aliased.pop("inputs/lb")
    aliased["inputs/user_features"] = aliased.pop("inputs/usr_ph")
    good, bad = RQ.parse_requests(_records(spark, [json.dumps(aliased)]))
    r = good.first()
    assert r["lb"] == [[1, 0]] and r["usr_ph"] == [1, 2, 3, 4, 5, 6] and bad.count() == 0
    mr = spark.createDataFrame([(1, [1] * 6, [[[1] * 7]], [1], [[1]], [[[1] * 6]], [1], [[1] * 6], 1)],
                               "list_id bigint, usr array<bigint>, candi_c array<array<array<bigint>>>, "
                               "candi_len_c array<int>, labels_c array<array<int>>, "
                               "cate_hist array<array<array<bigint>>>, cate_hist_len array<int>, "
                               "union_hist array<array<bigint>>, union_hist_len int")
    payload = json.loads(RQ.request_payload(mr, split_hist=False).first()["value"])
    assert "inputs/cate_hist_ft" not in payload and "inputs/union_hist_ft" in payload


def test_paced_processing_time_run_can_be_stopped(spark):
    base = tempfile.mkdtemp(prefix="slatekit-paced-")
    _records(spark, [json.dumps(BATCHED)] * 4).repartition(2).write.parquet(f"{base}/src")
    src = K.read_request_files(spark, f"{base}/src", max_files_per_trigger=1)
    q = SC.run_stream_scoring(spark, src, f"{base}/out", f"{base}/ckpt",
                              available_now=False, processing_time="1 second")
    try:
        q.processAllAvailable()          # paced: one file per trigger every second
    finally:
        q.stop()
    batches = [d for d in os.listdir(f"{base}/out") if d.startswith("batch_id=")]
    assert len(batches) >= 2
    assert spark.read.parquet(f"{base}/out").select("key").distinct().count() == 4


def test_two_scorers_in_one_worker(spark):
    parsed, _ = RQ.parse_requests(_records(spark, [json.dumps(BATCHED)]).coalesce(1))
    low = SC.score_requests(parsed).agg(F.max("pred")).first()[0]
    high = SC.score_requests(parsed, lambda: SC.LinearScorer(bias=5.0)).agg(F.max("pred")).first()[0]
    assert high > 0.9 > low


def test_incomplete_requests_are_quarantined(spark):
    bad = [{"inputs/usr_ph": [[1, 2]]}, BATCHED | {"inputs/candi_list_len": [[1, 2]]},
           BATCHED | {"inputs/candi_itm_ft": [[[[1] * 7, [2] * 6]]]},
           BATCHED | {"inputs/candi_itm_ft": [[[[1] * 7, None]]]}, BATCHED | {"inputs/candi_itm_ft": []}]
    good, out = RQ.parse_requests(_records(spark, [json.dumps(x) for x in [*bad, BATCHED]]))
    assert [r["key"] for r in good.collect()] == ["5"] and out.count() == 5
    assert SC.score_requests(good).count() == 2


def test_records_without_a_key_keep_their_place(spark):
    recs = _records(spark, [json.dumps(BATCHED)] * 3).withColumn("key", F.lit(None).cast("binary"))
    parsed, _ = RQ.parse_requests(recs)
    rows = SC.score_requests(parsed).collect()
    assert {(r["topic"], r["partition"], r["offset"], r["slot"]) for r in rows} == {
        ("t", 0, i, s) for i in range(3) for s in range(2)}
    assert all(r["key"] is None for r in rows)
    assert all((r["pred"] == 0) == (r["slot"] == 1) for r in rows)      # one real slot, one padding


def test_what_a_batch_keeps_on_disk_is_what_its_outputs_read(spark):
    x = SC._scorer_inputs(RQ.parse_records(_records(spark, [json.dumps(BATCHED), "not json"])))
    rows = {r["key"]: r for r in x.collect()}
    assert rows["0"]["_req"].asDict(True) == {"candi_itm_ft": [[[1] * 7, [2] * 7]], "candi_itm_dens": None,
                                              "candi_list_len": [1]}
    assert rows["0"]["_raw"] is None and (rows["1"]["_req"], rows["1"]["_raw"]) == (None, "not json")
    good, bad = RQ.split_parsed(x)
    assert SC.score_requests(good).count() == 2 and [r["raw"] for r in bad.collect()] == ["not json"]


def test_scores_pass_as_arrays_and_are_laid_out_after_it(spark):
    class Odd:
        n_dense = 0

        def score(self, items):
            import numpy as np
            return np.where(items[:, 0] == 2, np.nan, items[:, 0].astype(float))

    two = json.dumps({**BATCHED, "inputs/candi_list_len": [[2]]})
    one = json.dumps({**BATCHED, "inputs/candi_itm_ft": [[[]]], "inputs/lb": [[[]]]})             # no slots
    parsed, _ = RQ.parse_requests(_records(spark, [two, one, json.dumps(BATCHED)]))
    got = SC.score_requests(parsed, Odd)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    rows = sorted((r["key"], r["slot"], r["pred"]) for r in got.collect() if r["pred"] is not None)
    assert rows == [("0", 0, 1.0), ("2", 0, 1.0), ("2", 1, 0.0)]
    assert [(r["key"], r["slot"]) for r in got.where("pred IS NULL").collect()] == [("0", 1)]
    packed = {r["key"]: r["preds"] for r in SC.score_requests(parsed, Odd, packed=True).collect()}
    assert packed == {"0": [1.0, None], "1": [], "2": [1.0, 0.0]}
