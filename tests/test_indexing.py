from pyspark.sql import Window
from pyspark.sql import functions as F

from slatekit.plans.indexing import Prefix, dense_index, ordered_scan


def _data(spark):
    rows = [(g, i, (i * 7919) % 101) for g, n in ((0, 40), (1, 3), (2, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "g int, i int, v int")


def test_dense_index_hot_groups_exact(spark, small_split):
    df = _data(spark)
    got = {(r["g"], r["i"]): r["idx"] for r in dense_index(df, ["v", "i"], ["g"]).collect()}
    w = Window.partitionBy("g").orderBy("v", "i")
    want = {(r["g"], r["i"]): r["idx"] for r in
            df.withColumn("idx", F.row_number().over(w) - 1).collect()}
    assert got == want


def test_global_index_and_running_sum(spark, small_split):
    df = _data(spark)
    out = ordered_scan(df, ["v", "g", "i"], (), "idx", {"run": "v"}).collect()
    rows = sorted(out, key=lambda r: r["idx"])
    assert [r["idx"] for r in rows] == list(range(len(rows)))
    vals = [r["v"] for r in rows]
    assert vals == sorted(vals)
    acc = 0
    for r in rows:
        acc += r["v"]
        assert r["run"] == acc


def test_running_values_of_any_associative_operation(spark):
    import itertools

    rows = [(g, i, (i * 7919) % 101 if (i + g) % 5 else None, (i * 31) % 9 == 0) for g in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i int, v int, f boolean")
    ops = {"top": Prefix("v", "max"), "prev": Prefix("v", "max", inclusive=False), "low": Prefix("v", "min"),
           "any": Prefix("f", "or", inclusive=False), "all": Prefix("f", "and"), "sum": Prefix("v")}

    def best(vals, fn):
        vals = [v for v in vals if v is not None]
        return fn(vals) if vals else None

    for groups, per_range in ((["g"], None), (["g"], 20), ([], None)):
        got = {(r["g"], r["i"]): r for r in ordered_scan(df, ["i", "g"], groups, "n", ops, per_range).collect()}
        order = sorted(rows, key=lambda r: (r[1], r[0])) if not groups else sorted(rows, key=lambda r: r[:2])
        for _, run in itertools.groupby(order, key=lambda r: r[0] if groups else 0):
            run = list(run)
            for k, (g, i, _, _) in enumerate(run):
                r, upto, before = got[(g, i)], [x[2] for x in run[:k + 1]], [x[2] for x in run[:k]]
                assert (r["n"], r["top"], r["prev"], r["low"], r["sum"]) == (
                    k, best(upto, max), best(before, max), best(upto, min), best(upto, sum))
                assert r["any"] == best([x[3] for x in run[:k]], any) and r["all"] == all(x[3] for x in run[:k + 1])
