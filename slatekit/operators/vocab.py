"""Global feature vocabulary and encoding.

One dense id space starting at 1 (0 = padding / unseen).  Every feature
field has its own namespace, ids are never reused across namespaces, and ids
follow first appearance in this order: item fields of train then test rows,
history steps of train then test positives, then users of train then test
(user id first, then the five user fields).

Plan: every appearance becomes one narrow row ``(ns, value, order key)``;
``min(order key)`` per ``(ns, value)`` is a partial aggregate (a hot value
collapses map-side); the dense rank of the first appearances is the
skew-safe ordered scan (no single-partition window).  Where only the first
appearances count, items and steps collapse to the first of each before they
are taken apart into their fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatekit.config import (CATE_FIELD, CATE_IDX, HIST_FIELDS, HIST_MAX_LEN, ITEM_FIELDS,
                             LIST_LEN, USER_FIELDS)
from slatekit.plans.indexing import dense_index
from slatekit.sources import shared

# Namespaces of the vocabulary (the stats record's keys, below, are a file
# contract and FIXED VALUES).
ITEM_NS = [f"item:{f}" for f in ITEM_FIELDS]
USER_NS = ["uid"] + [f"user:{f}" for f in USER_FIELDS]
ITEM_COLS = ("pos", "pagenum", "sex", "price_level", "age_level", "bc_type", "score_bucket")

def _split_ord() -> Column:
    return F.when(F.col("split") == "train", 0).otherwise(1)


def _appear(ns: Column, value: Column, phase: int, pos: Column, sub: Column) -> Column:
    return F.struct(ns.alias("ns"), value.cast("string").alias("value"),
                    F.lit(phase).alias("phase"), F.col("split_ord"),
                    pos.cast("bigint").alias("pos"), sub.cast("int").alias("sub"))


def _items(log: DataFrame) -> DataFrame:
    return log.select(_split_ord().alias("split_ord"), F.array(*[F.col(c).cast("string") for c in ITEM_COLS]).alias("s"),
                      F.col("imp_id").cast("bigint").alias("pos"))


def _steps(log: DataFrame) -> DataFrame:
    return (log.where(F.col("label") != 0)
            .select(_split_ord().alias("split_ord"), F.col("imp_id").cast("bigint").alias("pos"),
                    F.posexplode("hist").alias("step", "s")))


def _union(items: DataFrame, steps: DataFrame, profiles: DataFrame) -> DataFrame:
    """Appearances of the fields of items and history steps, and of users."""
    items = items.select(F.explode(F.array(*[
        _appear(F.lit(ns), F.get("s", F.lit(i)), 0, F.col("pos"), F.lit(i))
        for i, ns in enumerate(ITEM_NS)])).alias("a"))
    hist = steps.select(F.explode(F.array(*[
        _appear(F.lit(ITEM_NS[i]), F.element_at("s", i + 1), 1, F.col("pos"),
                F.col("step") * len(HIST_FIELDS) + i)
        for i in range(len(HIST_FIELDS))])).alias("a"))
    users = profiles.withColumn("split_ord", _split_ord()).select(F.explode(F.array(
        _appear(F.lit("uid"), F.col("user_id"), 2, F.col("first_imp"), F.lit(0)),
        *[_appear(F.lit(ns), F.col(f), 2, F.col("first_imp"), F.lit(j + 1))
          for j, (ns, f) in enumerate(zip(USER_NS[1:], USER_FIELDS))])).alias("a"))
    return items.unionByName(hist).unionByName(users).select("a.*")


def appearances(log: DataFrame, profiles: DataFrame) -> DataFrame:
    """Ordered union of every feature appearance.

    ``log`` is the filtered log (items, positives' ``hist``); ``profiles``
    has one row per surviving (split, user) with ``first_imp`` and the user
    fields.
    """
    return _union(_items(log), _steps(log), profiles)


def first_appearances(log: DataFrame, profiles: DataFrame) -> DataFrame:
    """The appearances of the first of equal items and of equal steps: for every
    value its first one is among them.  An item's or step's fields are taken apart
    after that, as a place is ordered by row and step before the field."""
    items = _items(log)
    # rows without an id come first, as in the order of the appearances
    items = items.groupBy("split_ord", "s", F.col("pos").isNull()).agg(F.min("pos").alias("pos"))
    steps = _steps(log).groupBy("split_ord", "s").agg(F.min(F.struct("pos", "step")).alias("o"))
    return _union(items, steps.select("split_ord", "s", "o.*"), profiles)


def surviving_profiles(imps: DataFrame, log: DataFrame) -> DataFrame:
    """First-seen user fields (over the unfiltered log) of users that survive
    the filter, with the position of their first row."""
    first = F.min_by(F.struct(*[F.col(c) for c in USER_FIELDS]), F.col("imp_id"))
    prof = imps.groupBy("split", "user_id").agg(first.alias("_u"),
                                                 F.min("imp_id").alias("first_imp"))
    keep = log.select("split", "user_id").distinct()
    return prof.join(keep, ["split", "user_id"], "left_semi").select(
        "split", "user_id", "_u.*", "first_imp")


def build_vocab(imps: DataFrame, log: DataFrame) -> DataFrame:
    """``(ns, value, id)`` with dense ids from 1 in first-appearance order."""
    app = first_appearances(log, surviving_profiles(imps, log))
    first = app.groupBy("ns", "value").agg(
        F.min(F.struct("phase", "split_ord", "pos", "sub")).alias("o")).select("ns", "value", "o.*")
    ranked = dense_index(first, ["phase", "split_ord", "pos", "sub"], (), "idx")
    return ranked.select("ns", "value", (F.col("idx") + 1).alias("id"))


def vocab_sizes(vocab: DataFrame) -> DataFrame:
    """A10: vocabulary size per namespace."""
    return vocab.groupBy("ns").agg(F.count(F.lit(1)).alias("n_values"))


def cate_index(vocab: DataFrame, ns: str = f"item:{CATE_FIELD}") -> DataFrame:
    """0-based category index in vocabulary order (id -> index)."""
    cats = vocab.where(F.col("ns") == ns)
    return dense_index(cats, ["id"], (), "cate_idx").select(
        F.col("value").alias("cate_value"), F.col("id").alias("cate_id"), "cate_idx")


def vocab_increment(vocab: DataFrame, new_values: DataFrame) -> DataFrame:
    """Extend a vocabulary with unseen ``(ns, value, order)`` rows; new
    ids continue after the current maximum in order of first appearance.
    ``new_values`` carries ``ns``, ``value`` and a numeric ``ord``."""
    fresh = (new_values.groupBy("ns", "value").agg(F.min("ord").alias("ord"))
             .join(vocab.select("ns", "value"), ["ns", "value"], "left_anti"))
    top = vocab.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ranked = dense_index(fresh, ["ord", "ns", "value"], (), "idx")
    added = ranked.crossJoin(F.broadcast(top)).select(
        "ns", "value", (F.col("top") + F.col("idx") + 1).alias("id"))
    return vocab.select("ns", "value", "id").unionByName(added)


class VocabStore:
    """A vocabulary that grows day by day under ``path``, an append-only
    folder of id segments.

    A segment holds the values that no earlier one has, with ids from the
    high-water mark on in order of first appearance (items, histories, users, as
    in ``build_vocab``), so an id never changes and never means two values.  Its
    folder names its number, first id, next id and day: the mark is read from the
    last name.  Segments are written aside and moved into place; a day that is
    there already is left alone, so a job that runs again adds nothing."""

    SCHEMA = "ns string, value string, id bigint, segment int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def segments(self) -> list[tuple[int, int, int, str]]:
        """(number, first id, next id, day) in order."""
        parts = [n.split("_", 4) for n in shared.names(self.spark, self.path) if n.startswith("seg_")]
        return sorted((int(k), int(first), int(after), day) for _, k, first, after, day in parts)

    def next_id(self) -> int:
        """The high-water mark."""
        return max((after for _, _, after, _ in self.segments()), default=1)

    def _folder(self, k: int, first: int, after: int, day: str) -> str:
        return f"{self.path}/seg_{k:06d}_{first:016d}_{after:016d}_{day}"

    def table(self) -> DataFrame:
        """``(ns, value, id, segment)`` of all segments."""
        paths = [self._folder(*s) for s in self.segments()]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*paths)

    def grow(self, day: str, app: DataFrame) -> DataFrame:
        """Add the unseen values of a day's ``appearances`` and return the table."""
        held = self.segments()
        if day in [s[3] for s in held]:
            return self.table()
        k, first = len(held), self.next_id()
        fresh = app.groupBy("ns", "value").agg(
            F.min(F.struct("phase", "split_ord", "pos", "sub")).alias("o")).join(
            self.table().select("ns", "value"), ["ns", "value"], "left_anti").select("ns", "value", "o.*")
        ranked = dense_index(fresh, ["phase", "split_ord", "pos", "sub"], (), "idx").select(
            "ns", "value", (F.col("idx") + first).alias("id"), F.lit(k).alias("segment"))
        tmp = shared.temporary(f"{self.path}/seg")
        ranked.write.parquet(tmp)
        after = first + self.spark.read.parquet(tmp).count()       # from the files' footers
        if not shared.publish(self.spark, tmp, self._folder(k, first, after, day)):
            raise RuntimeError(f"another job is adding segment {k} to {self.path}")
        return self.table()


# ------------------------------------------------------------------ encoding
def _side(vocab: DataFrame, ns: str, value: str, out: str) -> DataFrame:
    return vocab.where(F.col("ns") == ns).select(F.col("value").alias(value),
                                                 F.col("id").alias(out))


def encode_fields(df: DataFrame, vocab: DataFrame, fields: dict[str, str],
                  suffix: str = "_id") -> DataFrame:
    """Add ``<col><suffix>`` ids for scalar columns (null or unseen -> 0).

    One equi-join per field on the namespace's values, unhinted: a namespace
    the planner measures as small is broadcast (a vocabulary written by
    ``ns`` gives it the size of each namespace alone), a large one such as
    the user ids is shuffled."""
    out = df
    for c, ns in fields.items():
        out = (out.join(_side(vocab, ns, "_v", "_i"), F.col(c).cast("string") == F.col("_v"),
                        "left")
               .withColumn(c + suffix, F.coalesce("_i", F.lit(0)).cast("bigint"))
               .drop("_v", "_i"))
    return out


def encode_steps(df: DataFrame, vocab: DataFrame, keys: Sequence[str], hist_col: str = "hist",
                 namespaces: list[str] | None = None, out_col: str | None = None) -> DataFrame:
    """J1 for histories: map every step's fields to ids (unseen -> 0).

    ``keys`` identify a row (no nulls).  Steps are exploded once, every field is
    one equi-join as in ``encode_fields``, and the steps are regrouped once by
    ``keys`` (a history holds at most its cap of steps)."""
    ns = namespaces or ITEM_NS[:len(HIST_FIELDS)]
    out_col = out_col or hist_col + "_ids"
    steps = df.select(*keys, F.posexplode(hist_col).alias("_p", "_s")).select(
        *keys, "_p", *[F.element_at("_s", i + 1).alias(f"_f{i}") for i in range(len(ns))])
    enc = encode_fields(steps, vocab, {f"_f{i}": n for i, n in enumerate(ns)})
    rows = enc.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "_p", F.array(*[F.col(f"_f{i}_id") for i in range(len(ns))]).alias("_ids")))).alias("_e"))
    return (df.join(rows, list(keys), "left")
            .withColumn(out_col, F.coalesce(F.transform("_e", lambda e: e["_ids"]),
                                            F.array().cast("array<array<bigint>>")))
            .drop("_e"))


def item_fields_map(item_cols=ITEM_COLS) -> dict[str, str]:
    return dict(zip(item_cols, ITEM_NS))


def user_fields_map() -> dict[str, str]:
    return {"user_id": "uid", **{f: f"user:{f}" for f in USER_FIELDS}}


def stats_record(spark: SparkSession, vocab: DataFrame, cate: DataFrame) -> DataFrame:
    """Helper for S5: the dataset stats as a one-row DataFrame."""
    total = vocab.agg((F.max("id") + 1).alias("ft_num"))
    users = vocab.where(F.col("ns") == "uid").agg(F.count(F.lit(1)).alias("user_num"))
    cmap = cate.agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("cate_id").cast("string"), F.col("cate_idx").cast("int"))))).alias("cate_idx_map"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col("cate_value"), F.col("cate_id").cast("int"))))).alias("cate_name_map"))
    return (total.crossJoin(users).crossJoin(cmap)
            .select(F.lit(len(ITEM_FIELDS)).alias("itm_fnum"),
                    F.size("cate_idx_map").alias("cate_num"),
                    F.lit(LIST_LEN).alias("list_len"), F.lit(HIST_MAX_LEN).alias("hist_len"),
                    F.col("ft_num").cast("int").alias("ft_num"),
                    F.col("user_num").cast("int").alias("user_num"),
                    F.lit(len(HIST_FIELDS)).alias("hist_fnum"),
                    F.lit(len(USER_FIELDS) + 1).alias("usr_fnum"),
                    F.lit(CATE_IDX).alias("cate_idx"), "cate_idx_map", "cate_name_map"))
