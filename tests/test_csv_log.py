"""The CSV log as the source of a dataset: row numbers per split, split-safe lists."""

from pyspark.sql import functions as F

from slatekit.operators import impressions as I
from slatekit.operators import sampling as S
from slatekit.sources import files as FS


def _write(spark, path, n_rows, n_files):
    """Row r: user r mod 3, every fifth row positive, one clicked step ``r``."""
    rows = spark.range(n_rows).repartitionByRange(n_files, "id").sortWithinPartitions("id")
    step = F.concat(F.col("id").cast("string"), F.lit(",0,0"))
    value = {"user_id": (F.col("id") % 3).cast("string"), "cand_item_pos": F.col("id").cast("string"),
             "label": (F.col("id") % 5 == 0).cast("int"), "score": F.col("id") / n_rows}
    FS.write_impression_csv(rows.select(*[
        value[c].alias(c) if c in value else (step if c.startswith("ipv_") else F.lit("1")).alias(c)
        for c in FS.LOG_COLUMNS]), path)


def test_row_numbers_follow_the_files(spark, tmp_path):
    _write(spark, f"{tmp_path}/train", 60, 4)
    log = I.log_from_csv(spark, f"{tmp_path}/train", "train")
    rows = {r["imp_id"]: r for r in log.collect()}
    assert sorted(rows) == list(range(60))
    for k, r in rows.items():
        assert r["pos"] == str(k) and r["split"] == "train"
        if k % 5 or not k:          # negatives carry none; a zero step is none
            assert (r["hist"], r["hist_len"]) == ([], 0)
        else:
            assert (r["hist"], r["hist_len"]) == ([[str(k)] * 6], 1)


def test_same_ids_in_both_splits_stay_apart(spark, tmp_path):
    for split, n in (("train", 150), ("test", 60)):
        _write(spark, f"{tmp_path}/{split}", n, 3)
    log = I.log_from_csv(spark, f"{tmp_path}/train", "train").unionByName(
        I.log_from_csv(spark, f"{tmp_path}/test", "test"))
    lists = S.candidates(I.prepare_log(log)).groupBy("split", "list_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).collect()
    assert len(lists) == 29 + 11       # row 0 has no history
    assert {(r["n"], r["pos"]) for r in lists} == {(10, 1)}


def test_empty_file(spark, tmp_path):
    _write(spark, f"{tmp_path}/train", 0, 1)
    assert I.log_from_csv(spark, f"{tmp_path}/train", "train").count() == 0


def test_rows_are_numbered_where_they_are_read(spark, tmp_path, monkeypatch):
    _write(spark, f"{tmp_path}/train", 400, 3)
    staged, run_path = [], FS.run_path
    monkeypatch.setattr(FS, "run_path", lambda s, name: staged.append(name) or run_path(s, name))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")          # several blocks a file
    try:
        log = I.log_from_csv(spark, f"{tmp_path}/train", "train").select("imp_id", "pos", "label", "hist_len")
        rows = log.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["imp_id"] for r in rows) == list(range(400))
    assert all(r["pos"] == str(r["imp_id"]) and r["hist_len"] == int(r["label"] and r["imp_id"] > 0) for r in rows)
    assert staged == ["csv-blocks"]                                      # no sorted copy


def _events(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}", i % 2, "click" if i % 3 else "view", 10.0 * i, '{"k": %d}' % i)
                           for i in range(40)], "event_id long, ts string, user_id long, event_type string, value double, "
                          "props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(
        f"{tmp_path}/events.parquet")


def test_rows_of_the_csv_files_are_made_once(spark, tmp_path, monkeypatch):
    from slatekit import queries as Q

    _events(spark, tmp_path)
    staged, run_path = [], FS.run_path
    monkeypatch.setattr(FS, "run_path", lambda s, name: staged.append(name) or run_path(s, name))
    base = Q._write_csv_logs(spark, str(tmp_path))
    assert staged == ["csv", "csv-rows"]
    logs = {s: I.log_from_csv(spark, f"{base}/{s}", s) for s in ("train", "test")}
    n = {s: x.count() for s, x in logs.items()}
    assert n == {"train": 32, "test": 8}
    assert logs["train"].where("label = 1 AND hist_len > 0").count() > 0
    assert logs["train"].where("label = 0 AND hist_len > 0").count() == 0


def test_the_prepared_log_keeps_no_history_of_negatives(spark, tmp_path):
    from slatekit import queries as Q
    from slatekit.plans import views as V

    _events(spark, tmp_path)
    _, log = Q._log(spark, str(tmp_path))
    held = {r["imp_id"]: r for r in log.select("imp_id", "label", "hist", "hist_len").collect()}
    assert {r["label"] for r in held.values()} == {0, 1}
    whole = {r["imp_id"]: r["hist"] for r in V.impressions(spark, str(tmp_path)).collect()}
    assert all(r["hist"] == (whole[i] if r["label"] else []) for i, r in held.items())
    assert all(r["hist_len"] == len(r["hist"]) for r in held.values())
