"""Impression-log preparation and profiling (per split, per user).

A *log* is view A shaped: one row per impression with ``split``,
``user_id``, ``imp_id``, ``label``, ``score``, item fields, user fields and
``hist`` (array of steps; only positives carry one).  Every operator here is
a filter, a partial aggregate or a semi join, so a user holding a third of
all rows is combined map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatekit.config import (CATE_FIELD, FILTER_HIST_NUM, FILTER_NEG_NUM, FILTER_POS_NUM,
                             HIST_FIELDS, USER_FIELDS)
from slatekit.functions.exprs import score_bucket
from slatekit.operators.history import parse_history
from slatekit.plans.indexing import small
from slatekit.sources.files import LOG_COLUMNS, log_schema, stage

KEYS = ["split", "user_id"]


def log_from_csv(spark: SparkSession, path: str, split: str) -> DataFrame:
    """P1 + S1: the impression log of one split from its headered CSV files.

    ``imp_id`` is the row number from 0 in file order (files by path, then
    position in the file), so ids start anew in every split and an item is
    ``(split, imp_id)``.  The position inside a file block is only known while
    it is read; the rows are written once with it, so a recomputed task cannot
    number them differently, and the rows of earlier blocks are added to it: one
    task reads a block, so rows are neither sorted nor shuffled.  Candidate fields
    lose their prefix, the clicked-item sequences become ``hist``/``hist_len``
    (positives only; the others' are not parsed)."""
    rows = spark.read.csv(path, header=True, schema=log_schema(), mode="PERMISSIVE").select(
        "*", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))
    rows = stage(rows, "csv-blocks")
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)   # a row a block
    blocks = rows.groupBy("_file", "_block").agg(F.min("_row").alias("_start"), F.count(F.lit(1)).alias("_n"))
    first = blocks.select("_file", "_block", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    log = rows.join(small(first, blocks.count()), ["_file", "_block"]).withColumn(
        "imp_id", F.col("_first") + F.col("_row") - F.col("_start"))
    seqs = [c for c in LOG_COLUMNS if c.startswith("ipv_")]
    log = parse_history(log.withColumns({c: F.when(is_pos(), F.col(c)) for c in seqs}), seqs)
    hist = F.when(is_pos(), F.col("hist")).otherwise(F.array().cast("array<array<string>>"))
    return log.select(
        F.lit(split).alias("split"), "imp_id", "user_id", *USER_FIELDS,
        *[F.col(f"cand_item_{c}").alias(c) for c in HIST_FIELDS],
        score_bucket("score").cast("string").alias("score_bucket"), "label", "score",
        hist.alias("hist"), F.when(is_pos(), F.col("hist_len")).otherwise(F.lit(0)).alias("hist_len"))


def is_pos(label: str = "label"):
    return F.col(label) != 0


def with_hist_len(log: DataFrame) -> DataFrame:
    if "hist_len" in log.columns:
        return log
    return log.withColumn("hist_len", F.when(is_pos(), F.size("hist")).otherwise(F.lit(0)))


def pos_neg_split(log: DataFrame) -> DataFrame:
    """Positives and negatives per split (only positives carry history)."""
    return (log.groupBy("split", F.when(is_pos(), "pos").otherwise("neg").alias("kind"))
            .agg(F.count(F.lit(1)).alias("n_items")))


def filter_history(log: DataFrame, min_hist: int = FILTER_HIST_NUM) -> DataFrame:
    """P5: drop positives whose history length is <= ``min_hist``."""
    log = with_hist_len(log)
    return log.where(~is_pos() | (F.col("hist_len") > min_hist))


def eligible_users(log: DataFrame, min_pos: int = FILTER_POS_NUM,
                   min_neg: int = FILTER_NEG_NUM) -> DataFrame:
    return (log.groupBy(*KEYS)
            .agg(F.count_if(is_pos()).alias("n_pos"), F.count_if(~is_pos()).alias("n_neg"))
            .where((F.col("n_pos") >= min_pos) & (F.col("n_neg") >= min_neg))
            .select(*KEYS))


def filter_users(log: DataFrame, min_pos: int = FILTER_POS_NUM,
                 min_neg: int = FILTER_NEG_NUM) -> DataFrame:
    """Keep only users (per split) with enough positives and negatives."""
    return log.join(eligible_users(log, min_pos, min_neg), KEYS, "left_semi")


def prepare_log(imps: DataFrame, min_hist: int = FILTER_HIST_NUM) -> DataFrame:
    """P5 then P6: the filtered log the vocabulary and lists are built from."""
    return filter_users(filter_history(imps, min_hist))


def user_profile(imps: DataFrame) -> DataFrame:
    """A1: first-seen user fields per (split, user), taken over the
    unfiltered log (later rows' fields are ignored)."""
    first = F.min_by(F.struct(*[F.col(c) for c in USER_FIELDS]), F.col("imp_id"))
    return imps.groupBy(*KEYS).agg(first.alias("_u")).select(*KEYS, "_u.*")


def score_range(imps: DataFrame) -> DataFrame:
    """A2: score min and max per split."""
    return imps.groupBy("split").agg(F.min("score").alias("min_score"),
                                     F.max("score").alias("max_score"))


def user_counts(log: DataFrame) -> DataFrame:
    """A3: positives and negatives per (split, user)."""
    return log.groupBy(*KEYS).agg(F.count_if(is_pos()).alias("n_pos"),
                                  F.count_if(~is_pos()).alias("n_neg"))


def user_ladder(log: DataFrame) -> DataFrame:
    """A4: user threshold ladder per split, as counts and shares of users."""
    uc = user_counts(log)
    p, n = F.col("n_pos"), F.col("n_neg")
    rungs = {
        "pos_ge1": p >= 1, "pos_ge2": p >= 2, "neg_ge1": n >= 1, "neg_ge9": n >= 9,
        "pos1_neg1": (p >= 1) & (n >= 1), "pos1_neg2": (p >= 1) & (n >= 2),
        "pos1_neg5": (p >= 1) & (n >= 5), "pos1_neg9": (p >= 1) & (n >= 9),
    }
    agg = uc.groupBy("split").agg(F.count(F.lit(1)).alias("n_users"),
                                  *[F.count_if(c).alias(k) for k, c in rungs.items()])
    return agg.select("split", "n_users", *rungs,
                      *[F.try_divide(F.col(k), F.col("n_users")).alias(f"{k}_share")
                        for k in rungs])


def hist_buckets(log: DataFrame) -> DataFrame:
    """A5: history length of positives in buckets 0 / 1-5 / 6-10 / >10,
    counts, shares and the mean length, per split."""
    log = with_hist_len(log).where(is_pos())
    h = F.col("hist_len")
    b = {"e0": h < 1, "le5": (h >= 1) & (h <= 5), "le10": (h > 5) & (h <= 10), "g10": h > 10}
    agg = log.groupBy("split").agg(F.count(F.lit(1)).alias("n_pos"),
                                   F.sum(h).cast("bigint").alias("total_len"),
                                   *[F.count_if(c).alias(k) for k, c in b.items()])
    return agg.select("split", "n_pos", "total_len",
                      F.try_divide(F.col("total_len"), F.col("n_pos")).alias("avg_len"),
                      *b, *[F.try_divide(F.col(k), F.col("n_pos")).alias(f"{k}_share") for k in b])


def cate_histogram(log: DataFrame, cate_col: str = CATE_FIELD) -> DataFrame:
    """Category counts of all items, of positives and of history steps,
    with shares within (split, kind)."""
    log = with_hist_len(log)
    items = log.select("split", F.lit("item").alias("kind"), F.col(cate_col).alias("cate"))
    pos = log.where(is_pos()).select("split", F.lit("pos").alias("kind"),
                                     F.col(cate_col).alias("cate"))
    hist = (log.where(is_pos()).select("split", F.explode("hist").alias("step"))
            .select("split", F.lit("hist").alias("kind"),
                    F.element_at("step", -1).alias("cate")))
    cnt = items.unionByName(pos).unionByName(hist).groupBy("split", "kind", "cate").agg(
        F.count(F.lit(1)).alias("n"))
    # share over the (split, kind) total: a few rows per group after the aggregate
    return cnt.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split", "kind")))


def dataset_cardinality(log: DataFrame) -> DataFrame:
    """Users, items, positives and the positive share per split."""
    return (log.groupBy("split")
            .agg(F.count_distinct("user_id").alias("n_users"),
                 F.count(F.lit(1)).alias("n_items"),
                 F.count_if(is_pos()).alias("n_pos"))
            .withColumn("pos_share", F.try_divide(F.col("n_pos"), F.col("n_items"))))


def profile_stages(imps: DataFrame, min_hist: int = FILTER_HIST_NUM) -> DataFrame:
    """Cardinalities and the user ladder before and after filtering."""
    def prof(log, stage):
        c = dataset_cardinality(log)
        lad = user_ladder(log).select("split", "pos_ge1", "neg_ge1", "pos1_neg1", "pos1_neg9")
        return c.join(lad, "split").withColumn("stage", F.lit(stage))
    return prof(imps, "before").unionByName(prof(prepare_log(imps, min_hist), "after"))


LADDER = {
    "pos_ge1": (1, 0), "pos_ge2": (2, 0), "neg_ge1": (0, 1), "neg_ge9": (0, 9),
    "pos1_neg1": (1, 1), "pos1_neg2": (1, 2), "pos1_neg5": (1, 5), "pos1_neg9": (1, 9),
}
HIST_BUCKETS = {"e0": (0, 0), "le5": (1, 5), "le10": (6, 10), "g10": (11, None)}


def profile(log: DataFrame, min_hist: int = FILTER_HIST_NUM, min_pos: int = FILTER_POS_NUM,
            min_neg: int = FILTER_NEG_NUM, cate_col: str = CATE_FIELD) -> DataFrame:
    """The whole profile (A3 to A7) before and after filtering, from one scan.

    ``(stage, split, section, name, value, share)`` with the sections ``card``
    (A7), ``ladder`` (A4), ``hist`` (A5) and ``cate_item``, ``cate_pos``,
    ``cate_hist`` (A6); shares are of users, of positives, and of the section.

    A row of the log counts once for its user and once for each of its categories
    (its own, and its history's); counts per (user, kind, category) carry both
    stages, since whether a row survives is known from the row (P5) and from its
    user's counts (P6)."""
    log = with_hist_len(log)
    h, none = F.col("hist_len"), F.lit(None).cast("string")
    cate = F.col(cate_col).cast("string")
    steps = F.transform("hist", lambda s: F.struct(F.lit("hist").alias("kind"), F.element_at(s, -1).alias("cate")))
    entries = F.concat(
        F.array(F.struct(F.lit("user").alias("kind"), none.alias("cate")),
                F.struct(F.lit("item").alias("kind"), cate.alias("cate"))),
        F.when(is_pos(), F.concat(F.array(F.struct(F.lit("pos").alias("kind"), cate.alias("cate"))), steps))
         .otherwise(F.array().cast("array<struct<kind:string,cate:string>>")))
    x = log.select(*KEYS, is_pos().alias("p"), (~is_pos() | (h > min_hist)).alias("kept"), h.alias("h"),
                   F.explode(entries).alias("e")).select(*KEYS, "p", "kept", "h", "e.*")

    def in_bucket(lo, hi):
        return (F.col("h") >= lo) if hi is None else F.col("h").between(lo, hi)

    def counts(stage, keep):
        p = F.col("p") & keep
        return F.struct(
            F.count_if(keep).alias("n"), F.count_if(p).alias("n_pos"),
            F.count_if(~F.col("p")).alias("n_neg"),
            F.coalesce(F.sum(F.when(p, F.col("h"))), F.lit(0)).cast("bigint").alias("total_len"),
            *[F.count_if(p & in_bucket(*b)).alias(k) for k, b in HIST_BUCKETS.items()]).alias(stage)

    per = x.groupBy(*KEYS, "kind", "cate").agg(counts("before", F.lit(True)), counts("after", F.col("kept")))
    # a user's few aggregated rows learn whether the user stays
    own = F.when(F.col("kind") == "user", (F.col("after.n_pos") >= min_pos) & (F.col("after.n_neg") >= min_neg))
    per = per.withColumn("stays", F.max(own).over(Window.partitionBy(*KEYS)))
    staged = per.select("split", "kind", "cate", F.explode(F.array(
        F.struct(F.lit("before").alias("stage"), F.lit(True).alias("ok"), F.col("before").alias("c")),
        F.struct(F.lit("after").alias("stage"), F.col("stays").alias("ok"), F.col("after").alias("c")))).alias("s"))
    staged = staged.where("s.ok AND s.c.n > 0").select("split", "kind", "cate", "s.stage", "s.c.*")
    p, n = F.col("n_pos"), F.col("n_neg")
    agg = staged.groupBy("stage", "split", "kind", "cate").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_users"), F.sum("n_pos").alias("n_pos"),
        F.sum("total_len").alias("total_len"), *[F.sum(k).alias(k) for k in HIST_BUCKETS],
        *[F.count_if((p >= a) & (n >= b)).alias(k) for k, (a, b) in LADDER.items()])

    def row(section, name, value, share=None):
        c = F.col(value) if isinstance(value, str) else value
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), c.cast("double").alias("value"),
                        (F.lit(None) if share is None else F.try_divide(c, F.col(share))).cast("double").alias("share"))

    users = agg.where(F.col("kind") == "user").select("stage", "split", F.inline(F.array(
        row("card", "n_users", "n_users"), row("card", "n_items", "n"), row("card", "n_pos", "n_pos", "n"),
        *[row("ladder", k, k, "n_users") for k in LADDER],
        *[row("hist", k, k, "n_pos") for k in HIST_BUCKETS],
        row("hist", "total_len", "total_len"), row("hist", "avg_len", F.try_divide("total_len", "n_pos")))))
    total = F.sum("n").over(Window.partitionBy("stage", "split", "kind"))        # a row per category
    cates = agg.where(F.col("kind") != "user").select(
        "stage", "split", F.concat(F.lit("cate_"), F.col("kind")).alias("section"), F.col("cate").alias("name"),
        F.col("n").cast("double").alias("value"), F.try_divide("n", total).cast("double").alias("share"))
    return users.unionByName(cates)
