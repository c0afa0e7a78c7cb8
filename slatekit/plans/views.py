"""Fixture views over the test tables (the tables hold no impression log).

A ``impressions``  from events    -- one impression per event.
B ``served``       from lineitem  -- one served list per order, one slot per line.
C ``item_vectors`` from embeddings.
D ``requests``     Kafka-shaped JSON requests built from B (streaming module).

Both engines (Spark here, DuckDB in the oracle) derive the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatekit.config import HIST_MAX_LEN
from slatekit.functions.exprs import score_bucket, sigmoid
from slatekit.sources.tables import table

ITEM_COLS = ("pos", "pagenum", "sex", "price_level", "age_level", "bc_type", "score_bucket")
USER_COLS = ("user_os", "user_gender", "user_age_level", "user_purchase_level", "user_hour")


def impressions_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View A without history: typed impression rows.  Feature values stay
    strings until they are encoded; ``score_bucket`` is the item's 7th field."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type",
                                               "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    s = lambda c: c.cast("string")
    return ev.select(
        F.col("event_id").alias("imp_id"),
        "user_id",
        "ts",
        F.when(F.col("event_id") % 5 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("label"),
        (F.col("value") / 500).alias("score"),
        s(k % 10).alias("pos"),
        s(F.floor(k / 10)).alias("pagenum"),
        s(F.col("event_id") % 3).alias("sex"),
        s(F.least(F.floor(F.col("value") / 50), F.lit(7))).alias("price_level"),
        s(F.col("user_id") % 5).alias("age_level"),
        s(k % 3 + 1).alias("bc_type"),
        s(score_bucket(F.col("value") / 500)).alias("score_bucket"),
        s(F.col("user_id") % 2).alias("user_os"),
        s(F.col("user_id") % 3).alias("user_gender"),
        s(F.col("user_id") % 5).alias("user_age_level"),
        s(F.col("user_id") % 7).alias("user_purchase_level"),
        s(F.hour("ts")).alias("user_hour"),
        k.alias("k"),
    )


def impressions(spark: SparkSession, sf_dir: str, max_len: int = HIST_MAX_LEN) -> DataFrame:
    """View A: impressions with ``hist`` = the positives among the user's
    previous ``max_len`` impressions (as-of, oldest first), six item fields
    per step (operator J8)."""
    from slatekit.operators.history import history_asof

    return history_asof(impressions_base(spark, sf_dir), max_len=max_len)


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View B: list_id = order, slot = 0-based line position in
    (l_linenumber, l_partkey, l_suppkey) order, cate from the return flag,
    label = open line, pred = sigmoid((quantity - 25) / 10)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_returnflag", "l_linestatus")
    w = Window.partitionBy("list_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return li.withColumnRenamed("l_orderkey", "list_id").select(
        "list_id",
        (F.row_number().over(w) - 1).cast("bigint").alias("slot"),
        F.col("l_partkey").alias("item_id"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1)
         .when(F.col("l_returnflag") == "R", 2).alias("cate"),
        (F.col("l_linestatus") == "O").cast("int").alias("label"),
        sigmoid((F.col("l_quantity") - 25) / 10).alias("pred"),
    )


def item_vectors(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    """View C: one vector for every feature id of the vocabulary.  The test
    table has fewer vectors than there are ids, so id ``i`` takes the vector
    ``i mod n`` of its ``n`` rows."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = emb.agg(F.count(F.lit(1)).alias("n"))
    ids = vocab.select("id").crossJoin(F.broadcast(n))          # one row
    return (ids.where(F.col("n") > 0)
            .select(F.col("id").alias("item_id"), (F.col("id") % F.col("n")).alias("vec_id"))
            .join(emb, "vec_id").select("item_id", "vec"))


def history_strings(imps: DataFrame, width: int = 6, max_len: int = HIST_MAX_LEN,
                    others: str | None = None) -> DataFrame:
    """The log's clicked-item sequence columns (ipv_*_seq) for positives: the
    as-of history with steps whose ``pos`` is 0 or 5 written as zero steps,
    right-padded with zero steps to ``max_len``, one comma-joined string per
    field.  Negatives are left out, or kept with the string ``others`` in every
    field.  Input of the history parser (P4)."""
    zero = F.array(*[F.lit("0") for _ in range(width)])
    steps = F.transform("hist", lambda s: F.when(F.element_at(s, 1).isin("0", "5"), zero)
                        .otherwise(s))
    padded = F.concat(steps, F.array_repeat(zero, F.greatest(F.lit(max_len) - F.size("hist"),
                                                             F.lit(0))))
    names = ["ipv_pos_seq", "ipv_pagenum_seq", "ipv_sex_seq", "ipv_price_level_seq",
             "ipv_age_level_seq", "ipv_bc_type_seq"]
    pos = F.col("label") == 1
    rows = imps.where(pos if others is None else pos | (F.col("label") == 0))

    def field(i):
        joined = F.array_join(F.transform("_padded", lambda s: F.element_at(s, i + 1)), ",")
        return joined if others is None else F.when(pos, joined).otherwise(others)

    return rows.withColumn("_padded", F.when(pos, padded)).select(
        *imps.columns, *[field(i).alias(n) for i, n in enumerate(names)])


def hist_str(c) -> "F.Column":
    """Steps joined with ';', fields with ',' (oracle-friendly scalar)."""
    return F.array_join(F.transform(c, lambda s: F.array_join(s, ",")), ";")
