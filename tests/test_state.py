"""Tables that are kept from run to run: reused tables, vocabulary segments, run
logs, replays."""
import os
import time

import pytest
from pyspark.sql import functions as F

from slatekit.operators import learning as LR
from slatekit.operators import vocab as VO
from slatekit.sources import files as FS
from slatekit.sources import shared
from slatekit.streaming import replay as RP


def test_reuse_follows_its_inputs(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "prepared")
    built = []

    def get(*params):
        df = spark.read.parquet(src)
        return FS.reuse("t", [df], lambda: built.append(1) or df.selectExpr("id + 1 AS id"), *params, base=base)

    spark.range(5).write.parquet(src)
    assert get().count() == 5 and get().count() == 5 and len(built) == 1
    assert get("other").count() == 5 and len(built) == 2          # other parameters, beside the first
    assert get().count() == 5 and len(built) == 2
    spark.range(5, 8).write.mode("append").parquet(src)            # other files: another table
    assert get().count() == 8 and len(built) == 3
    spark.range(8).coalesce(1).write.mode("overwrite").parquet(src)
    (name,) = [f for f in os.listdir(src) if f.endswith(".parquet")]
    assert get().count() == 8 and len(built) == 4
    time.sleep(0.01)
    os.utime(f"{src}/{name}", (time.time() + 5, time.time() + 5))  # touched: built again, the old one removed
    assert get().count() == 8 and len(built) == 5
    kept = {d: [v for v in os.listdir(f"{base}/t/{d}") if not v.startswith(".")] for d in os.listdir(f"{base}/t")}
    assert all(len(v) == 1 for v in kept.values())


def test_reuse_publishes_whole_tables_only(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(5).write.parquet(src)
    df = spark.read.parquet(src)
    bad = df.select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        FS.reuse("t", [df], lambda: bad, base=str(tmp_path / "p"))
    assert FS.reuse("t", [df], lambda: df, base=str(tmp_path / "p")).count() == 5


def test_stages_are_removed_after_the_job(spark):
    with FS.staging(spark):
        t = FS.stage(spark.range(3), "gone")
        path = t.inputFiles()[0]
        assert t.count() == 3 and shared.exists(spark, path)
    assert not shared.exists(spark, path)


def _app(spark, rows):
    return spark.createDataFrame([(ns, v, 0, 0, k, 0) for k, (ns, v) in enumerate(rows)],
                                 "ns string, value string, phase int, split_ord int, pos bigint, sub int")


def test_vocabulary_ids_stay_over_days(spark, tmp_path):
    store = VO.VocabStore(spark, str(tmp_path / "v"))
    assert store.table().count() == 0 and store.next_id() == 1

    def ids():
        return {(r["ns"], r["value"]): (r["id"], r["segment"]) for r in store.table().collect()}
    store.grow("mon", _app(spark, [("a", "x"), ("a", "y"), ("b", "x"), ("a", "x")]))
    first = ids()
    assert first == {("a", "x"): (1, 0), ("a", "y"): (2, 0), ("b", "x"): (3, 0)}
    store.grow("tue", _app(spark, [("a", "z"), ("a", "y"), ("c", "x")]))
    second = ids()
    assert second == first | {("a", "z"): (4, 1), ("c", "x"): (5, 1)} and store.next_id() == 6
    store.grow("tue", _app(spark, [("q", "q")]))                   # a day that is there is left alone
    store.grow("wed", _app(spark, [("a", "x")]))                   # nothing new
    store.grow("thu", _app(spark, [("d", "d")]))
    assert ids() == second | {("d", "d"): (6, 3)}


def test_run_log_is_not_duplicated(spark, tmp_path):
    log = LR.RunLog(spark, str(tmp_path / "log"))
    for value in (0.1, 0.2):
        log.write("r", 0, 0, spark.createDataFrame([("m", value)], "metric string, value double"))
    log.write("r", 2, 1, spark.createDataFrame([("m", 0.3)], "metric string, value double"))
    assert sorted(map(tuple, log.read().collect())) == [("r", 0, 0, "m", 0.2), ("r", 2, 1, "m", 0.3)]


def test_gradient_steps_can_be_continued(spark):
    rows = [(*[float((i * k) % 5) for k in range(1, 8)], float(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*LR.ITEM_ID_COLS, "label"]))
    none = spark.createDataFrame([], LR.WEIGHTS)

    def table(w):
        return {(r["field"], r["id"]): r["weight"] for r in w.collect()}
    whole, half = LR.gradient_steps(df, none, 4), LR.gradient_steps(df, LR.gradient_steps(df, none, 2), 2)
    assert table(whole).keys() == table(half).keys()
    assert all(abs(v - table(half)[k]) < 1e-12 for k, v in table(whole).items())

    def loss(w):
        p = LR._with_weights(df, w)
        return p.agg(-F.avg(F.col("label") * F.log("pred") + (1 - F.col("label")) * F.log(1 - F.col("pred")))).first()[0]
    assert loss(whole) < loss(LR.gradient_steps(df, none, 1)) < loss(none)


def test_gradient_steps_read_the_slots_once(spark):
    """Steps over groups of equal items are those over the slots, one by one."""
    import math
    rows = [(*[float((i * k) % 3) if (i + k) % 11 else None for k in range(1, 8)],
             None if i % 13 == 0 else float(i % 3 == 0)) for i in range(90)]
    rows += rows[:40] + [(None,) * 8]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*LR.ITEM_ID_COLS, "label"]))
    groups = LR.item_groups(df)
    assert groups.count() == len({r[:7] for r in rows}) < len(rows)
    none = spark.createDataFrame([], LR.WEIGHTS)
    want: dict = {}
    for _ in range(2):
        move: dict = {}
        for *ids, label in rows:
            z = want.get((-1, 0)) or 0.0
            z += sum(want.get((f, v)) or 0.0 for f, v in enumerate(ids) if v is not None)
            for key in [(-1, 0), *enumerate(ids)]:
                move.setdefault(key, [])
                if label is not None:
                    move[key].append(1 / (1 + math.exp(-z)) - label)
        for key, g in move.items():
            if g:
                want[key] = (want.get(key) or 0.0) - sum(g) / len(rows)
    for train in (df, groups):
        got = {(r["field"], r["id"]): r["weight"] for r in LR.gradient_steps(train, none, 2).collect()}
        assert {k for k, v in got.items() if v is not None} == want.keys()
        assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())

    reads = []
    real = LR._with_weights
    LR._with_weights = lambda rows, weights: reads.append(rows.columns) or real(rows, weights)
    try:
        LR.gradient_steps(df, none, 2)
    finally:
        LR._with_weights = real
    assert reads == [groups.columns] * 2           # no step scores every slot


def test_early_stop_of_one_long_run(spark, small_split):
    import itertools
    for maximize in (True, False):
        vals = [((i * 37) % 101) / 100 for i in range(120)]
        df = spark.createDataFrame([("r", i, i, v) for i, v in enumerate(vals)] + [("s", 0, 0, 0.5)],
                                   "run string, step bigint, epoch bigint, value double")
        got = {r["step"]: r for r in LR.early_stop(df, 5, 0.5, 2, maximize=maximize).where("run = 'r'").collect()}
        best = list(itertools.accumulate(vals, max if maximize else min))
        for i, v in enumerate(vals):
            prev = best[i - 1] if i else None
            lag = 0 if prev is None else (prev - v if maximize else v - prev)
            assert got[i]["best"] == best[i] and got[i]["n_evals"] == i + 1
            assert got[i]["stop"] == int(i + 1 > 2 and i > 5 and lag > 0.5)


def test_replay_is_paced_and_goes_on(spark, tmp_path):
    rec = spark.range(60).select(
        F.col("id").cast("string").cast("binary").alias("key"), F.lit(b"{}").alias("value"), F.lit("t").alias("topic"),
        F.lit(0).alias("partition"), F.col("id").alias("offset"), F.current_timestamp().alias("timestamp"))
    RP.write_replay(rec, str(tmp_path / "r"))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run(until):
        src = RP.read_replay(spark, str(tmp_path / "r"), str(tmp_path / "progress"), 20, 15)
        RP.run_until(src, out, ckpt, until)
        return sorted(int(r["key"].decode()) for r in spark.read.parquet(out).collect())
    began = time.time()
    first = run(10)
    assert first == list(range(len(first))) and 10 <= len(first) <= 20 * (time.time() - began) + 1
    second = run(60)
    assert second == list(range(60)) and time.time() - began >= 60 / 20 - 0.5
    # admission: no micro-batch took more than its share
    sizes = [r["count"] for r in spark.read.parquet(out).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 60 and max(sizes) <= 15


def test_first_appearances_hold_the_first_of_every_value(spark):
    step = lambda *v: [str(x) for x in v]
    rows = [("train", None, 1, ["1", "2", "3", "4", "5", "6", "7"], [step(9, 8, 7, 6, 5, 4), step(1, 8, 7, 6, 5, 4)]),
            ("train", 5, 1, ["1", "2", "3", "4", "5", "6", "8"], [step(1, 8, 7, 6, 5, 4), step(9, 8, 7, 6, 5, 4)]),
            ("train", 5, 1, ["1", "2", "3", None, "5", "6", "8"], [step(3, 3, 3, 3, 3, 3), step(9, 8, 7, 6, 5, 4)]),
            ("test", 2, 1, ["1", "9", "3", "4", "5", "6", "7"], [step(2, 2, 2, 2, 2, 2)] * 3),
            ("test", 4, 0, ["0", "9", "3", "4", "5", "6", "7"], [])]
    log = spark.createDataFrame([(s, i, lab, *items, h) for s, i, lab, items, h in rows],
                                "split string, imp_id long, label int, " + ", ".join(f"{c} string" for c in VO.ITEM_COLS)
                                + ", hist array<array<string>>")
    users = spark.createDataFrame([("train", 1, *"abcde", 5), ("test", 1, *"abcdf", 2)],
                                  "split string, user_id long, " + ", ".join(f"{c} string" for c in VO.USER_FIELDS)
                                  + ", first_imp long")
    first = lambda app: sorted(map(str, app.groupBy("ns", "value").agg(
        F.min(F.struct("phase", "split_ord", "pos", "sub")).alias("o")).collect()))
    short, whole = VO.first_appearances(log, users), VO.appearances(log, users)
    assert first(short) == first(whole) and short.count() < whole.count()
