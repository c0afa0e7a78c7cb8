from pyspark.sql import functions as F

from slatekit.operators import history as H


def _parse(spark, steps):
    """steps: list of per-step feature sums written as a single-field log."""
    seq = ",".join(str(s) for s in steps)
    df = spark.createDataFrame([(seq, seq)], "a string, b string")
    r = H.parse_history(df, ["a", "b"], as_int=True).first()
    return r["hist_len"], [s[0] for s in r["hist"]]


def test_parse_counts_and_prefix(spark):
    assert _parse(spark, [1, 0, 2])[0] == 2
    assert _parse(spark, [1, 0, 0, 2])[0] == 1
    assert _parse(spark, [0, 0])[0] == 0
    assert _parse(spark, [1, 0])[0] == 1
    assert _parse(spark, [0, 1])[0] == 1
    # gap kept, tail lost: count 2 -> prefix of two steps
    n, steps = _parse(spark, [5, 0, 7])
    assert n == 2 and steps == [5, 0]
    assert _parse(spark, [0, 1]) == (1, [0])


def test_union_history_cloud_lag(spark):
    df = spark.createDataFrame([([[1], [2]], 2)], "hist array<array<bigint>>, hist_len int")
    h, n = H.union_history("hist", "hist_len", max_n=4, width=1, kind="bigint")
    r = df.select(h, n).first()
    assert r["union_hist_len"] == 0
    assert r["union_hist"] == [[0]] * 4


def test_cate_split_history_last_n_and_reverse(spark):
    df = spark.createDataFrame([([[1], [2], [3]], 3)], "hist array<array<bigint>>, hist_len int")
    h, n = H.cate_split_history("hist", "hist_len", lambda s: F.lit(0), 1, max_n=2, width=1)
    r = df.select(h, n).first()
    assert r["cate_hist"] == [[[2], [3]]] and r["cate_hist_len"] == [2]
    h, n = H.cate_split_history("hist", "hist_len", lambda s: F.lit(0), 1, max_n=2, width=1,
                                reverse=True)
    assert df.select(h).first()["cate_hist"] == [[[3], [2]]]


def test_history_asof_split_matches_plain(spark, small_split):
    from tests.conftest import SF_SMALL
    from slatekit.plans import views as V
    split = {r["imp_id"]: r["hist"] for r in V.impressions(spark, SF_SMALL).collect()}
    spark.conf.unset("spark.slatekit.splitRows")
    plain = {r["imp_id"]: r["hist"] for r in V.impressions(spark, SF_SMALL).collect()}
    assert split == plain and len(plain) > 0


def test_history_length_column_matches_size(spark, small_split):
    from tests.conftest import SF_SMALL
    from slatekit.plans import views as V
    base = V.impressions_base(spark, SF_SMALL)
    for split in (True, False):
        if not split:
            spark.conf.unset("spark.slatekit.splitRows")
        h = H.history_asof(base, len_col="n")
        assert h.where(F.size("hist") != F.col("n")).count() == 0
