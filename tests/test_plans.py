"""Plan checks: the physical strategies the operators are designed for."""

from pyspark.sql import functions as F

from slatekit.functions.exprs import hash60
from slatekit.operators import lists as L
from slatekit.operators import ranking as R
from slatekit.plans import views as V
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_uses_window_group_limit(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        served = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
            F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").cast("bigint").alias("slot"),
            F.col("l_quantity").alias("pred"))
        assert "WindowGroupLimit" in _plan(R.top_k(served, 5))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_global_positions_avoid_single_partition(spark, small_split):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lists = V.served(spark, SF_SMALL).select("list_id").distinct().withColumn(
            "list_order", hash60("list_id"))
        lines = _plan(L.batch_assign(lists)).splitlines()
        # row-level positions never funnel through one task: a single-partition
        # exchange may only carry already-aggregated rows (global counts, the
        # bounded per-range totals)
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "HashAggregate" in lines[i + 1], lines[i + 1]
        # positions come from the range-partitioned table written once
        assert any("ordered-scan" in ln for ln in lines)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_metrics_stay_in_jvm_and_scan_prunes(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(R.rank_metrics(V.served(spark, SF_SMALL)))
        for py in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonUDF"):
            assert py not in plan
        assert "l_extendedprice" not in plan and "l_shipdate" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_profile_reads_its_input_once(spark, tmp_path):
    from slatekit.operators import impressions as I
    path = str(tmp_path / "log")
    V.impressions(spark, SF_SMALL).write.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(I.profile(spark.read.parquet(path)))
        assert plan.count("FileScan parquet") == 1 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_selection_needs_no_window_and_stopping_no_single_task(spark, small_split):
    from slatekit.operators import learning as LR
    log = spark.createDataFrame([("r", s, s, "m", 0.1 * s) for s in range(40)],
                                "run string, step bigint, epoch bigint, metric string, value double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "Window" not in _plan(LR.best_run(log, "m"))
        plan = _plan(LR.early_stop(log.drop("metric")))
        assert "ordered-scan" in plan and "Exchange SinglePartition" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
