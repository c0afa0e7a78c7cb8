"""Candidate-list (slate) assembly and reshaping (D6, D9, X1-X3, X7, X8,
P7, A12, W8).

Dataset row, one per list: ``split, list_id, user_id, usr array<bigint>[6],
candi array<array<bigint>>[n][7], labels array<int>[n],
hist array<array<bigint>>[30][6], hist_len int``.

Lists are bounded (1 positive + 9 negatives), so grouping candidates by list
ships at most 10 rows per key; every per-user input is joined on narrow rows
before the wide arrays exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatekit.config import (BATCH_SIZE, CANDIDATE_NEG_NUM, CATE_IDX, DEFAULT_SEED,
                             HIST_CATE_MAX_LEN, HIST_FIELDS, HIST_MAX_LEN, ITEM_FIELDS, LIST_LEN)
from slatekit.functions.exprs import categories, col, let, pad_right, zero_step
from slatekit.operators import vocab as VO
from slatekit.operators.history import cate_split_history, pad_history, union_history
from slatekit.operators.sampling import candidates
from slatekit.plans.indexing import dense_index


def build_dataset(imps: DataFrame, log: DataFrame, vocab: DataFrame,
                  n_neg: int = CANDIDATE_NEG_NUM, hist_max: int = HIST_MAX_LEN,
                  seed: str = DEFAULT_SEED) -> DataFrame:
    """Encoded candidate lists with labels, user ids and padded history."""
    item_map = VO.item_fields_map()
    items = VO.encode_fields(log.select("split", "imp_id", *item_map), vocab, item_map).select(
        "split", "imp_id", F.array(*[F.col(c + "_id") for c in item_map]).alias("ids"))
    cands = candidates(log, n_neg, seed).join(items, ["split", "imp_id"])
    lists = cands.groupBy("split", "list_id").agg(
        F.array_sort(F.collect_list(F.struct("slot", "ids", "label"))).alias("_c"))
    lists = lists.select("split", "list_id", F.transform("_c", lambda x: x["ids"]).alias("candi"),
                         F.transform("_c", lambda x: x["label"]).alias("labels"))

    users = VO.encode_fields(VO.surviving_profiles(imps, log), vocab, VO.user_fields_map())
    usr = users.select("split", "user_id",
                       F.array(*[F.col(c + "_id") for c in VO.user_fields_map()]).alias("usr"))
    pos = VO.encode_steps(log.where(F.col("label") != 0).select(
        "split", "user_id", F.col("imp_id").alias("list_id"), "hist"), vocab, ["split", "list_id"])
    hist, hist_len = pad_history("hist_ids", hist_max)
    pos = pos.select("split", "user_id", "list_id", hist, hist_len).join(usr, ["split", "user_id"])
    return pos.join(lists, ["split", "list_id"]).select(
        "split", "list_id", "user_id", "usr", "candi", "labels", "hist", "hist_len")


def list_keys(df: DataFrame) -> list[str]:
    """The columns that identify a list: ids start anew in every split."""
    return [c for c in ("split", "list_id") if c in df.columns]


def with_categories(df: DataFrame, cate_idx: DataFrame) -> DataFrame:
    """Add ``cmap`` (category id -> 0-based index) and ``n_cate`` to every row.
    The reshaped rows hold one array per category, so the map is of the size of
    a row; it is one row, taken from the data's own index."""
    one = cate_idx.agg(F.map_from_entries(F.collect_list(
        F.struct("cate_id", F.col("cate_idx").cast("int")))).alias("cmap"),
        F.count(F.lit(1)).cast("int").alias("n_cate"))
    return df.crossJoin(F.broadcast(one))


def cate_of(cmap: str | Column, cate_id: Column) -> Column:
    """Category index of an id.  Id 0 (padding or unseen) has none (null); any
    other id outside the map is an error, never a dropped row."""
    missing = F.raise_error(F.concat(F.lit("category id without an index: "),
                                     cate_id.cast("string"))).cast("int")
    return F.when(cate_id != 0, F.coalesce(F.element_at(col(cmap), cate_id), missing))


def pad_candidates(candi: str | Column = "candi", labels: str | Column = "labels",
                   max_len: int = LIST_LEN, width: int = len(ITEM_FIELDS),
                   kind: str = "bigint") -> list[Column]:
    """Flat truncate / right-pad of candidates and labels, with length."""
    return [pad_right(candi, max_len, zero_step(width, kind)).alias("full_candi"),
            pad_right(labels, max_len, F.lit(0)).alias("full_labels"),
            F.least(F.size(col(candi)), F.lit(max_len)).cast("int").alias("candi_len")]


def cate_split_candidates(cmap: str | Column = "cmap", n_cate: int | str | Column = "n_cate",
                          candi: str | Column = "candi", labels: str | Column = "labels",
                          max_len: int = LIST_LEN, width: int = len(ITEM_FIELDS),
                          cate_idx: int = CATE_IDX, kind: str = "bigint") -> list[Column]:
    """Per category (in slot order) the candidates and labels of that
    category, truncated / padded to ``max_len``, with per-category lengths."""
    z = F.transform(F.arrays_zip(col(candi).alias("c"), col(labels).alias("l")), lambda e: F.struct(
        e["c"].alias("c"), e["l"].alias("l"),
        cate_of(cmap, F.element_at(e["c"], cate_idx + 1).cast("bigint")).alias("k")))
    pad = zero_step(width, kind)
    # the candidates' categories are looked up once, not once a category and output
    per = let(z, lambda tagged: F.transform(categories(n_cate), lambda c: let(
        F.filter(tagged, lambda e: e["k"] == c), lambda p: F.struct(
            pad_right(p.getField("c"), max_len, pad).alias("c"),
            pad_right(p.getField("l"), max_len, F.lit(0)).alias("l"),
            F.least(F.size(p), F.lit(max_len)).cast("int").alias("n")))))
    return [per.getField("c").alias("candi_c"), per.getField("l").alias("labels_c"),
            per.getField("n").alias("candi_len_c")]


def slot_layout(df: DataFrame, max_len: int = LIST_LEN) -> DataFrame:
    """Flatten (category x position) into slots; ``slot = cate * max_len +
    pos``, ``cate = slot div max_len``, ``mask`` = position < category length.
    Needs ``labels_c``, ``candi_len_c``; keeps the list's keys, the items where there
    are ``candi_c``, and where there are ``preds`` (a prediction a slot) the slots that
    have one, with it as ``pred``."""
    keys = list_keys(df)
    extra = [c for c in ("item", "pred") if {"item": "candi_c", "pred": "preds"}[c] in df.columns]
    z = {"label": F.flatten("labels_c")}
    if "item" in extra:
        z["item"] = F.flatten("candi_c")
    if "pred" in extra:
        z["pred"] = F.col("preds")
    # arrays_zip gives as many slots as the longest array has; those of all are kept
    n = F.least(*[F.size(c) for c in z.values()]) if len(z) > 1 else F.size(z["label"])
    flat = df.select(*keys, F.posexplode(F.slice(F.arrays_zip(*[c.alias(k) for k, c in z.items()]), F.lit(1), n))
                     .alias("slot", "_z"), "candi_len_c")
    cate = (F.col("slot") / max_len).cast("int")
    return flat.select(
        *keys, F.col("slot").cast("bigint").alias("slot"), cate.alias("cate"),
        *[F.col(f"_z.{c}").alias(c) for c in extra], F.col("_z.label").alias("label"),
        F.when(F.col("slot") % max_len < F.element_at("candi_len_c", cate + 1), 1)
         .otherwise(0).alias("mask"))


def feature_split(arr: str | Column, n_sparse: int) -> list[Column]:
    """First ``n_sparse`` fields of every item are sparse ids, the rest
    dense features."""
    a = col(arr)
    return [F.transform(a, lambda f: F.slice(f, 1, n_sparse)).alias("sparse"),
            F.transform(a, lambda f: F.slice(f, n_sparse + 1, F.greatest(F.size(f) - n_sparse,
                                                                         F.lit(0))))
            .alias("dense")]


def pack_dense(ds: DataFrame, dense: DataFrame, n_dense: int) -> DataFrame:
    """Candidates as ids followed by their ``n_dense`` dense features (doubles);
    ``dense`` has per list ``dens``, ``n_dense`` numbers a candidate in slot order."""
    packed = F.transform("candi", lambda c, i: F.concat(
        F.transform(c, lambda v: v.cast("double")), F.slice("dens", i * n_dense + 1, F.lit(n_dense))))
    return (ds.join(dense.select("split", "list_id", "dens"), ["split", "list_id"])
            .withColumn("candi", packed).drop("dens"))


def pages_per_user(dataset: DataFrame, vocab: DataFrame) -> DataFrame:
    """Lists per split and lists per user id (train + test over the uid
    vocabulary)."""
    per = dataset.groupBy("split").agg(F.count(F.lit(1)).alias("n_lists"))
    uid = vocab.where(F.col("ns") == "uid").agg(F.count(F.lit(1)).alias("n_uid"))
    tot = per.agg(F.sum("n_lists").alias("total"))
    return (per.crossJoin(F.broadcast(uid)).crossJoin(F.broadcast(tot))   # 1-row sides
            .select("split", "n_lists", (F.col("total") / F.col("n_uid")).alias("pages_per_user")))


def batch_assign(lists: DataFrame, batch_size: int = BATCH_SIZE, group_cols=(),
                 order_key: str = "list_order", drop_last: bool = True) -> DataFrame:
    """Mini-batch number of every list (dense order div batch size); the
    last partial batch of each group is dropped when ``drop_last``."""
    g = list(group_cols)
    idx = dense_index(lists, [order_key, "list_id"], g, "_bi")
    out = idx.withColumn("batch", (F.col("_bi") / batch_size).cast("bigint"))
    if drop_last:
        n = lists.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
        full = n.select(*g, (F.col("_n") / batch_size).cast("bigint").alias("_full"))
        # one row per group: AQE broadcasts it when small, joins otherwise
        out = out.join(full, g) if g else out.crossJoin(F.broadcast(full))  # 1 row
        out = out.where(F.col("batch") < F.col("_full")).drop("_full")
    return out.drop("_bi")


def model_ready(ds: DataFrame, list_len: int = LIST_LEN,
                cate_hist_len: int = HIST_CATE_MAX_LEN, union_hist_len: int = HIST_MAX_LEN,
                cloud: bool = True, reverse: bool = False, item_dense: int = 0,
                hist_dense: int = 0) -> DataFrame:
    """Per list (with ``cmap`` and ``n_cate``) the category-split candidates,
    labels and lengths, the per-category and union histories, and the flat
    padded candidates.  Items and steps may carry ``item_dense`` and
    ``hist_dense`` dense features after their ids; such arrays hold doubles."""
    item = {"width": len(ITEM_FIELDS) + item_dense, "kind": "double" if item_dense else "bigint"}
    step = {"width": len(HIST_FIELDS) + hist_dense, "kind": "double" if hist_dense else "bigint"}
    full, _, _ = pad_candidates("candi", "labels", list_len, **item)
    return ds.select(
        "split", "list_id", "user_id", "usr",
        *cate_split_candidates(max_len=list_len, **item),
        *cate_split_history("hist", "hist_len",
                            lambda s: cate_of("cmap", F.element_at(s, CATE_IDX + 1).cast("bigint")),
                            "n_cate", cate_hist_len, reverse=reverse, **step),
        *union_history("hist", "hist_len", union_hist_len, cloud, reverse, **step),
        full)
