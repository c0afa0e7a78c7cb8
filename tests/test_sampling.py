import collections
import math

from pyspark.sql import functions as F

from slatekit.operators import impressions as I
from slatekit.operators import sampling as S
from slatekit.plans import views as V
from tests.conftest import SF_MID


def test_negatives_distinct_and_partition_independent(spark):
    log = I.prepare_log(I.with_hist_len(V.impressions(spark, SF_MID)))
    a = S.neg_sample(log)
    per = a.groupBy("list_id").agg(F.count("*").alias("n"), F.countDistinct("neg_id").alias("d"))
    assert per.where("n != d").count() == 0
    assert per.where("n != 9").count() == 0
    b = S.neg_sample(log.repartition(7, "imp_id"))
    key = ["list_id", "neg_id", "src", "t"]
    assert a.select(*key).exceptAll(b.select(*key)).count() == 0


def test_negatives_never_positive_and_own_first(spark):
    log = I.prepare_log(I.with_hist_len(V.impressions(spark, SF_MID)))
    c = S.candidates(log)
    assert c.groupBy("list_id").agg(F.sum("label").alias("p")).where("p != 1").count() == 0
    labels = log.select(F.col("imp_id").alias("neg_id"), "label")
    bad = S.neg_sample(log).join(labels, "neg_id").where("label != 0")
    assert bad.count() == 0


def test_lists_of_splits_with_the_same_ids_stay_apart(spark):
    rows = [(s, u, s_i * 0 + u * 40 + i, int(i == 0)) for s_i, s in enumerate(("train", "test"))
            for u in range(3) for i in range(12)]
    log = spark.createDataFrame(rows, "split string, user_id long, imp_id long, label int")
    per = S.candidates(log).groupBy("split", "list_id").agg(
        F.count("*").alias("n"), F.sum("label").alias("p"), F.max("slot").alias("last"))
    assert {(r["n"], r["p"], r["last"]) for r in per.collect()} == {(10, 1, 9)} and per.count() == 6


def _chi_square(counts, cells, n):
    """Standard deviations between the counts of equally likely cells and theirs."""
    e = n / cells
    x = sum((c - e) ** 2 / e for c in counts) + (cells - len(counts)) * e
    return (x - (cells - 1)) / math.sqrt(2 * (cells - 1))


def test_every_set_of_negatives_is_equally_likely(spark):
    n_pos = 12_000
    for n in (10, 11, 12):
        log = spark.range(n_pos + n).select(
            F.lit("train").alias("split"), F.lit(1).cast("long").alias("user_id"),
            F.col("id").alias("imp_id"), (F.col("id") >= n).cast("int").alias("label"))
        sets = collections.Counter(
            tuple(r["s"]) for r in S.neg_sample(log).groupBy("list_id").agg(
                F.sort_array(F.collect_list("neg_id")).alias("s")).collect())
        assert sum(sets.values()) == n_pos and all(len({*s}) == 9 for s in sets)
        assert abs(_chi_square(sets.values(), math.comb(n, 9), n_pos)) < 4
        rotated = {tuple(r["s"]) for r in S.neg_sample(log, method="rotate").groupBy("list_id").agg(
            F.sort_array(F.collect_list("neg_id")).alias("s")).collect()}
        assert len(rotated) == n                       # windows only


def test_fill_is_uniform_over_the_others_of_the_pool(spark):
    rows = [("train", 1, i, 1) for i in range(4000)] + [("train", 1, 10_000 + i, 0) for i in range(7)]
    rows += [("train", 2, 20_000 + i, 0) for i in range(6)]
    log = spark.createDataFrame(rows, "split string, user_id long, imp_id long, label int")
    fill = S.neg_sample(log).where("src = 'pool'").groupBy("list_id").agg(
        F.sort_array(F.collect_list("neg_id")).alias("s")).collect()
    pairs = collections.Counter(tuple(r["s"]) for r in fill)
    assert all(len(p) == 2 and min(p) >= 20_000 for p in pairs)
    assert abs(_chi_square(pairs.values(), math.comb(6, 2), 4000)) < 4


def test_permutations_are_permutations(spark):
    sizes = [1, 2, 3, 4, 5, 9, 10, 17, 100, 1000]
    rows = spark.createDataFrame([(k, n) for n in sizes for k in range(3)], "list_id long, n long")
    x = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    per = x.groupBy("list_id", "n").agg(F.sort_array(F.collect_list(
        S.permuted(F.col("t"), F.col("n"), "list_id"))).alias("v")).collect()
    assert len(per) == 3 * len(sizes) and all(r["v"] == list(range(r["n"])) for r in per)
    big = spark.range(2000).select(S.permuted(F.col("id"), F.lit(10 ** 12 + 7), F.lit(5)).alias("v"))
    assert big.distinct().count() == 2000 and big.agg(F.max("v")).first()[0] < 10 ** 12 + 7


def test_places_drawn_together_equal_places_drawn_alone(spark):
    rows = spark.createDataFrame([(i, n) for i in range(6) for n in (10, 11, 27, 81, 82, 300)], "list_id long, n long")
    places = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda t: t.cast("bigint"))
    keys = ("list_id", F.lit("own"))
    out = rows.select("n", S.permuted_places(places, F.col("n"), *keys, most=9).alias("together"),
                      F.array(*[S.permuted(F.lit(t), F.col("n"), *keys) for t in range(9)]).alias("alone")).collect()
    assert len(out) == 36 and all(r["together"] == r["alone"] and len({*r["alone"]}) == 9 for r in out)
    assert all(0 <= v < r["n"] for r in out for v in r["together"])


def test_draws_are_dealt_over_the_session_s_partitions(spark):
    rows = spark.createDataFrame([("train", 1, i) for i in range(64)], "split string, user_id long, list_id long")
    counts = rows.groupBy("split", "user_id").agg(F.count(F.lit(1)).alias("n"))      # one hot user
    drawn = S._drawn(rows.hint("merge").join(counts, ["split", "user_id"]), "n", "own", 9, "exact", "42", "t", "j")
    per = drawn.groupBy(F.spark_partition_id().alias("p")).count()
    assert drawn.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    assert per.agg(F.sum("count")).first()[0] == 64 * 9
