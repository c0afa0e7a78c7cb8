"""Steps whose work must not meet in one task, or be repeated row by row."""

import math
import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from slatekit.operators import embeddings as EM
from slatekit.operators import lists as L
from slatekit.sources import files as FS
from slatekit.sources import kafka as K
from slatekit.streaming import requests as RQ
from slatekit.streaming import scoring as SC


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_of_one_partition_are_sorted_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(K, "SORTED_RECORDS", 40, raising=False)
    rows = [(f"k{i % 150:03d}", f"v{i * 7 % 200:03d}") for i in range(200)]        # 50 keys come twice
    out = K.to_kafka_records(spark.createDataFrame(rows, "key string, value string"), "key", "value")
    got = sorted((r["offset"], r["key"].decode(), r["value"].decode()) for r in out.collect())
    assert got == [(i, *r) for i, r in enumerate(sorted(rows))]
    ranges = spark.read.parquet(FS._STAGED[spark.sparkContext.applicationId][-1]).groupBy("_sk_pid").count()
    sizes = [r["count"] for r in ranges.collect()]
    assert len(sizes) > 5 and max(sizes) <= 40


def test_requests_are_parsed_once(spark):
    rec = spark.createDataFrame([(b"k", b"{}", "t", 0, 0, None)], K.KAFKA_SCHEMA)
    parsed, _ = RQ.parse_requests(rec)
    assert not [x for x in _plan(parsed).splitlines() if re.search(r"Filter .*from_json", x)]


def test_vectors_are_looked_up_once_a_block(spark):
    ids = [(1, [0, 7, 5]), (2, [5, 5]), (3, [7]), (1, [7]), (4, []), (5, [0, 0])]
    vecs = {5: [1.0, 2.0], 7: [-3.0, 0.5], 0: [0.0, 0.0]}
    rows = spark.createDataFrame(ids, "k int, ids array<bigint>")
    table = spark.createDataFrame([(i, v) for i, v in vecs.items() if i], "item_id bigint, vec array<double>")
    long = EM.lookup_vectors(rows, ["k"], F.col("ids"), table, concat=True)
    assert "FlatMapCoGroupsInArrow" in _plan(long)             # rows do not carry vectors through a shuffle
    got = {r["k"]: r["vec"] for r in long.collect()}
    want = {}
    for k in (1, 2, 3, 5):                                     # rows of one key, by field, then value
        e = sorted((f, vecs[i]) for key, own in ids if key == k for f, i in enumerate(own))
        want[k] = [x for _, v in e for x in v]
    assert got == want
    summed = {r["k"]: r["vec"] for r in EM.lookup_vectors(rows, ["k"], F.col("ids"), table).collect()}
    assert summed == {1: [-5.0, 3.0], 2: [2.0, 4.0], 3: [-3.0, 0.5], 5: [0.0, 0.0]}
    stats = {r["k"]: r for r in EM.lookup_vectors(rows, ["k"], F.col("ids"), table, concat=True, stats=True).collect()}
    for r in long.select("k", *EM.vec_stats("vec")).collect():
        s = stats[r["k"]]
        assert s["dim"] == r["dim"] and math.isclose(s["norm"], r["norm"]) and math.isclose(s["vsum"], r["vsum"])
    # an id with several vectors brings all of them
    twice = EM.lookup_vectors(rows.where("k = 3"), ["k"], F.col("ids"), table.union(table), concat=True)
    assert twice.first()["vec"] == [-3.0, 0.5] * 2


def test_categories_of_candidates_are_looked_up_once(spark):
    ds = spark.createDataFrame([("train", 1, [[1] * 5 + [9, 1]], [1], {9: 0}, 1)],
                               "split string, list_id bigint, candi array<array<bigint>>, labels array<int>, "
                               "cmap map<bigint,int>, n_cate int")
    out = ds.select(*L.cate_split_candidates())
    assert "filter(transform(arrays_zip" not in _plan(out)
    assert out.first()["candi_len_c"] == [1]


def test_predictions_join_by_list(spark):
    from slatekit.queries import _requests, _reshaped, _scored_slots
    x = _scored_slots(spark, SF_SMALL)
    assert not [p for p in _plan(x).splitlines() if " Join " in p and "slot#" in p]
    ds = _reshaped(spark, SF_SMALL)
    parsed, _ = RQ.parse_requests(_requests(spark, SF_SMALL))
    preds = SC.score_requests(parsed).select(*RQ.list_of_key(), "slot", "pred")
    labels = L.slot_layout(ds.select("split", "list_id", *L.cate_split_candidates())).drop("item")
    cols = ["split", "list_id", "slot", "pred", "cate", "label", "mask"]
    want = preds.join(labels, ["split", "list_id", "slot"]).select(*cols)
    assert sorted(map(tuple, x.select(*cols).collect())) == sorted(map(tuple, want.collect()))


def test_let_and_padding_copy_nothing(spark):
    from slatekit.functions.exprs import let, pad_right, zero_step

    x = spark.createDataFrame([([[1, 2], [3, 4]],), ([],), (None,)], "a array<array<bigint>>")
    out = x.select(let(F.reverse("a"), lambda v: F.concat(v, v)).alias("b"),
                   pad_right("a", 1, zero_step(2, "bigint")).alias("c"), pad_right("a", 3, zero_step(2, "bigint")).alias("d"))
    assert "transform(" not in _plan(out)
    assert [tuple(r) for r in out.collect()] == [
        ([[3, 4], [1, 2]] * 2, [[1, 2]], [[1, 2], [3, 4], [0, 0]]), ([], [[0, 0]], [[0, 0]] * 3), (None, None, None)]
