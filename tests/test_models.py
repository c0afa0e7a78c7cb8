"""The model store, the exported model, and what the scorer does with them."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatekit.operators import learning as LR
from slatekit.streaming import models as MS
from slatekit.streaming import requests as RQ
from slatekit.streaming import scoring as SC
from tests.test_streaming import BATCHED, _records


def test_versions_and_pointer(spark, tmp_path):
    store = MS.ModelStore(spark, str(tmp_path / "m"))
    assert store.version() is None
    with pytest.raises(ValueError):
        store.current()
    assert store.publish(MS.LinearScorer().spec()) == 1
    assert store.publish(MS.LinearScorer(bias=2.0).spec()) == 2
    assert store.version() == 2 and store.versions() == [1, 2]
    store.point(1)                                   # back to the first
    assert store.version() == 1 and store.current()().b == -0.3
    store.point(2)
    store.point(1)
    assert store.version() == 1
    with pytest.raises(ValueError):
        store.point(7)
    assert store.publish(MS.LinearScorer(bias=3.0).spec()) == 3 and store.current()().b == 3.0
    assert not [n for n in (tmp_path / "m").iterdir() if n.name.startswith(".new")]


def test_worker_follows_the_version(spark, tmp_path):
    parsed, _ = RQ.parse_requests(_records(spark, [json.dumps(BATCHED)]).coalesce(1))
    store = MS.ModelStore(spark, str(tmp_path / "m"))
    tops = []
    for bias in (-5.0, 5.0):
        store.publish(MS.LinearScorer(bias=bias).spec())
        tops.append(SC.score_requests(parsed, store.current()).agg(F.max("pred")).first()[0])
    store.point(1)
    tops.append(SC.score_requests(parsed, store.current()).agg(F.max("pred")).first()[0])
    assert tops[0] < 0.1 and tops[1] > 0.9 and tops[2] == tops[0]


def test_worker_keeps_a_bounded_number_of_models():
    for k in range(3 * SC.MAX_LOADED):
        SC.cached_scorer(f"test-{k}", object)
    assert len(SC._CACHE) <= SC.MAX_LOADED


def test_exported_model_scores_like_the_pipeline(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(*[float(v) for v in rng.integers(1, 30, 7)], float(rng.normal()), float(rng.normal())) for _ in range(400)]
    rows = [(*r, float(r[0] + 5 * r[7] > 15)) for r in rows]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*LR.ITEM_ID_COLS, "d0", "d1", "label"]))
    model = LR.fit_pointwise(df, n_dense=2)
    model.write().save(str(tmp_path / "p"))
    store = MS.ModelStore(spark, str(tmp_path / "m"))
    store.publish(*LR.export_pointwise(LR.PipelineModel.load(str(tmp_path / "p")), spark))
    scorer = store.current()()
    unseen = df.limit(5).select(*[(F.col(c) + 1000).alias(c) for c in LR.ITEM_ID_COLS], "d0", "d1", "label")
    x = LR.predict(model, df.unionByName(unseen)).toPandas()
    got = scorer.score(x[LR.ITEM_ID_COLS].to_numpy().astype(np.int64), x[["d0", "d1"]].to_numpy())
    assert np.abs(got - x["pred"].to_numpy()).max() < 1e-9 and scorer.n_dense == 2
    assert got.max() - got.min() > 0.5


def test_dense_inputs_of_requests(spark):
    class Sum:
        n_dense = 2

        def score(self, items, dense):
            return dense.sum(axis=1)

    dense = [[[[0.1, 0.2], [0.5, 0.5]]]]
    payloads = [BATCHED | {"inputs/candi_itm_dens": dense}, BATCHED,
                BATCHED | {"inputs/candi_itm_dens": [[[[0.1], [0.5]]]]},
                BATCHED | {"inputs/candi_itm_dens": [[[[0.1, 0.2]]]]},
                BATCHED | {"inputs/candi_itm_dens": [[[[0.1, 0.2], [0.5]]]]}]
    good, bad = RQ.parse_requests(_records(spark, [json.dumps(p) for p in payloads]))
    assert sorted(r["key"] for r in bad.collect()) == ["3", "4"]
    preds = {(r["key"], r["slot"]): r["pred"] for r in SC.score_requests(good, Sum).collect()}
    # the second slot is padding; records without the features have no score
    assert preds == {("0", 0): pytest.approx(0.3), ("0", 1): 0.0, ("1", 0): None, ("1", 1): 0.0,
                     ("2", 0): None, ("2", 1): 0.0}
    assert all(r["pred"] is not None for r in SC.score_requests(good).collect())


def test_keys_of_lists(spark):
    df = spark.createDataFrame([("train", 7), ("test", 7)], "split string, list_id bigint")
    back = df.select(RQ.list_key().alias("key")).select(*RQ.list_of_key())
    assert sorted(map(tuple, back.collect())) == [("test", 7), ("train", 7)]
    text = spark.createDataFrame([("train", "a:b")], "split string, list_id string")
    assert text.select(RQ.list_key().alias("key")).select(*RQ.list_of_key(id_type="string")).first()["list_id"] == "a:b"
