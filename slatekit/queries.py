"""Registered queries: one per operator of the inventory, each reading the
given tables (through the fixture views) at ``sf_dir``.  Every computed
column is aliased to the name the DuckDB oracle uses; doubles are rounded to
6 places as the last step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatekit.config import EXPOSURE_SCOPE, METRIC_SCOPES, TARGET_EXPOSURE
from slatekit.functions.exprs import round6
from slatekit.operators import metrics as M
from slatekit.operators import ranking as R
from slatekit.plans import views as V
from slatekit.plans.indexing import split_rows
from slatekit.session import scratch_dir
from slatekit.sources import files as FS
from slatekit.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[round6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- ranking / metrics
@query("rank_metrics")
def q_rank_metrics(spark, sf):
    out = R.rank_metrics(V.served(spark, sf), METRIC_SCOPES, is_rank=True)
    return _round(out, "ndcg", "map", "utility")


@query("initial_rank_metrics")
def q_initial_rank_metrics(spark, sf):
    out = R.rank_metrics(V.served(spark, sf), METRIC_SCOPES, is_rank=False)
    return _round(out, "ndcg", "map", "utility")


@query("list_metrics")
def q_list_metrics(spark, sf):
    out = R.list_metrics(V.served(spark, sf), METRIC_SCOPES, is_rank=True)
    return _round(out, "ndcg", "map", "utility")


@query("rerank")
def q_rerank(spark, sf):
    return R.rerank(V.served(spark, sf)).select("list_id", "slot", "rank")


@query("khot_pick")
def q_khot_pick(spark, sf):
    return R.khot_pick(V.served(spark, sf), EXPOSURE_SCOPE).select("list_id", "slot", "pick")


@query("exposure_ratio")
def q_exposure_ratio(spark, sf):
    return _round(M.exposure_counts(V.served(spark, sf), EXPOSURE_SCOPE), "ratio")


@query("exposure_js")
def q_exposure_js(spark, sf):
    return _round(M.exposure_js(V.served(spark, sf), TARGET_EXPOSURE, EXPOSURE_SCOPE), "js")


@query("kl_divergence")
def q_kl_divergence(spark, sf):
    expo = M.exposure_counts(V.served(spark, sf), EXPOSURE_SCOPE)
    return _round(M.kl_divergence(M.with_target(expo), "ratio", "target", (), "kl"), "kl")


@query("log_loss")
def q_log_loss(spark, sf):
    return _round(M.log_loss(V.served(spark, sf)), "log_loss")


@query("auc")
def q_auc(spark, sf):
    return _round(M.auc(V.served(spark, sf)), "auc")


@query("lists_without_positive")
def q_lists_without_positive(spark, sf):
    return M.lists_without_positive(V.served(spark, sf))


@query("score_heads")
def q_score_heads(spark, sf):
    s = V.served(spark, sf).withColumn("logit", (F.col("pred") - 0.5) * 4)
    out = M.score_heads(s, "logit").select("list_id", "slot", "sigmoid", "softmax")
    return _round(out, "sigmoid", "softmax")


# ---------------------------------------------------------------- log preparation
from slatekit.operators import history as H  # noqa: E402
from slatekit.operators import impressions as I  # noqa: E402


def _imps(spark, sf):
    return I.with_hist_len(V.impressions(spark, sf))


@query("hist_asof")
def q_hist_asof(spark, sf):
    return V.impressions(spark, sf).select(
        "imp_id", F.size("hist").cast("int").alias("hist_len"), V.hist_str("hist").alias("hist_str"))


@query("score_bucket")
def q_score_bucket(spark, sf):
    return V.impressions_base(spark, sf).select("imp_id", F.col("score_bucket").cast("int")
                                                .alias("score_bucket"))


@query("pos_neg_split")
def q_pos_neg_split(spark, sf):
    return I.pos_neg_split(V.impressions_base(spark, sf))


@query("hist_parse")
def q_hist_parse(spark, sf):
    seqs = V.history_strings(V.impressions(spark, sf))
    cols = [c for c in seqs.columns if c.startswith("ipv_")]
    parsed = H.parse_history(seqs, cols)
    return parsed.select("imp_id", "hist_len", V.hist_str("hist").alias("hist_str"))


@query("filter_history")
def q_filter_history(spark, sf):
    return I.filter_history(_imps(spark, sf)).select("split", "imp_id", "label",
                                                     F.col("hist_len").cast("int"))


@query("filter_users")
def q_filter_users(spark, sf):
    return I.prepare_log(_imps(spark, sf)).select("split", "user_id", "imp_id", "label")


@query("user_profile")
def q_user_profile(spark, sf):
    return I.user_profile(V.impressions_base(spark, sf))


@query("score_range")
def q_score_range(spark, sf):
    return _round(I.score_range(V.impressions_base(spark, sf)), "min_score", "max_score")


@query("user_counts")
def q_user_counts(spark, sf):
    return I.user_counts(I.prepare_log(_imps(spark, sf)))


@query("user_ladder")
def q_user_ladder(spark, sf):
    out = I.user_ladder(_imps(spark, sf))
    return _round(out, *[c for c in out.columns if c.endswith("_share")])


@query("hist_buckets")
def q_hist_buckets(spark, sf):
    out = I.hist_buckets(_imps(spark, sf))
    return _round(out, "avg_len", *[c for c in out.columns if c.endswith("_share")])


@query("cate_histogram")
def q_cate_histogram(spark, sf):
    return _round(I.cate_histogram(_imps(spark, sf)), "share")


@query("dataset_cardinality")
def q_dataset_cardinality(spark, sf):
    return _round(I.dataset_cardinality(I.prepare_log(_imps(spark, sf))), "pos_share")


@query("profile_stages")
def q_profile_stages(spark, sf):
    return _round(I.profile_stages(_imps(spark, sf)), "pos_share")


@query("profile_full")
def q_profile_full(spark, sf):
    return _round(I.profile(_imps(spark, sf)), "value", "share")


@query("pad_history")
def q_pad_history(spark, sf):
    imps = I.prepare_log(_imps(spark, sf)).where(F.col("label") == 1)
    hist, n = H.pad_history("hist", kind="string")
    return imps.select("imp_id", n.alias("hist_len"), V.hist_str(hist).alias("hist_str"))


# ---------------------------------------------------------------- vocabulary / encoding
from slatekit.operators import vocab as VO  # noqa: E402


def _prepared(name, spark, sf, build, partition_by=()):
    """A table built from the events once, as long as they do not change."""
    events = table(spark, sf, "events")
    return FS.reuse(name, [events], build, split_rows(events), partition_by=partition_by)


def _log(spark, sf):
    """Unfiltered impressions (profiles need no history) and the filtered log."""
    base = V.impressions_base(spark, sf)

    def build():
        hist = H.history_asof(base, len_col="_n").withColumn(
            "hist_len", F.when(F.col("label") != 0, F.col("_n")).otherwise(0).cast("int")).drop("_n")
        # only positives carry a history, as in the CSV log
        none = F.array().cast("array<array<string>>")
        return I.prepare_log(hist.withColumn("hist", F.when(F.col("label") != 0, F.col("hist")).otherwise(none)))
    return base, _prepared("log", spark, sf, build)


def _log_and_vocab(spark, sf):
    """The filtered log and the vocabulary (they feed several encoders)."""
    base, log = _log(spark, sf)
    # written by namespace: a lookup reads, and the planner measures, one of them
    vocab = _prepared("vocab", spark, sf, lambda: VO.build_vocab(base, log).repartition("ns"), ["ns"])
    return base, log, vocab.select("ns", "value", "id")


@query("vocab")
def q_vocab(spark, sf):
    return VO.build_vocab(*_log(spark, sf))


@query("vocab_sizes")
def q_vocab_sizes(spark, sf):
    return VO.vocab_sizes(_log_and_vocab(spark, sf)[2])


@query("cate_index")
def q_cate_index(spark, sf):
    return VO.cate_index(_log_and_vocab(spark, sf)[2])


@query("encode_items")
def q_encode_items(spark, sf):
    _, log, vocab = _log_and_vocab(spark, sf)
    enc = VO.encode_fields(log, vocab, VO.item_fields_map())
    return enc.select("imp_id", *[c + "_id" for c in VO.ITEM_COLS])


@query("encode_users")
def q_encode_users(spark, sf):
    imps, log, vocab = _log_and_vocab(spark, sf)
    prof = VO.surviving_profiles(imps, log)
    enc = VO.encode_fields(prof, vocab, VO.user_fields_map())
    return enc.select("split", "user_id", *[c + "_id" for c in VO.user_fields_map()])


@query("encode_history")
def q_encode_history(spark, sf):
    _, log, vocab = _log_and_vocab(spark, sf)
    enc = VO.encode_steps(log.where(F.col("label") == 1), vocab, ["split", "imp_id"])
    return enc.select("imp_id", V.hist_str(F.transform("hist_ids", lambda s: F.transform(
        s, lambda v: v.cast("string")))).alias("hist_ids"))


@query("vocab_increment")
def q_vocab_increment(spark, sf):
    imps = _imps(spark, sf)
    train = imps.where(F.col("split") == "train")
    tlog = I.prepare_log(train)
    base = VO.build_vocab(train, tlog)
    test = I.prepare_log(imps.where(F.col("split") == "test"))
    new = test.select("imp_id", F.explode(F.array(*[
        F.struct(F.lit(ns).alias("ns"), F.col(c).alias("value"), F.lit(i).alias("f"))
        for i, (c, ns) in enumerate(VO.item_fields_map().items())])).alias("a")).select(
        "a.ns", "a.value", (F.col("imp_id") * 8 + F.col("a.f")).alias("ord"))
    return VO.vocab_increment(base, new)


@query("vocab_days")
def q_vocab_days(spark, sf):
    """The vocabulary grown over three days of the log: the train rows, then the
    test rows in two halves."""
    imps = _imps(spark, sf)
    half = (F.col("imp_id") / 5).cast("bigint") % 2
    days = {"day0": F.col("split") == "train", "day1": (F.col("split") == "test") & (half == 0),
            "day2": (F.col("split") == "test") & (half == 1)}
    store = VO.VocabStore(spark, FS.run_path(spark, "vocab-days"))
    for day, rows in days.items():
        base = imps.where(rows)
        log = FS.stage(I.prepare_log(base), "day")
        app = VO.appearances(log, VO.surviving_profiles(base, log))
        store.grow(day, app)
        store.grow(day, app)              # a job that runs again adds nothing
    return store.table()


# ---------------------------------------------------------------- sampling / lists
from slatekit.operators import lists as L  # noqa: E402
from slatekit.operators import sampling as S  # noqa: E402


def _ids_str(c):
    """Nested bigint arrays -> 'a,b;c,d' (or 'a,b' for a flat array)."""
    return F.array_join(F.transform(c, lambda s: F.array_join(s, ",")), ";")


def _dataset(spark, sf):
    imps, log, vocab = _log_and_vocab(spark, sf)
    return _prepared("dataset", spark, sf, lambda: L.build_dataset(imps, log, vocab)), vocab


@query("neg_sample")
def q_neg_sample(spark, sf):
    log = I.prepare_log(_imps(spark, sf))
    return S.neg_sample(log).select("split", "list_id", "neg_id", "src", F.col("t").cast("int"))


@query("neg_sample_rotate")
def q_neg_sample_rotate(spark, sf):
    log = I.prepare_log(_imps(spark, sf))
    return S.neg_sample(log, method="rotate").select("split", "list_id", "neg_id", "src",
                                                     F.col("t").cast("int"))


@query("neg_fill")
def q_neg_fill(spark, sf):
    return q_neg_sample(spark, sf).where(F.col("src") == "pool")


@query("candidates")
def q_candidates(spark, sf):
    log = I.prepare_log(_imps(spark, sf))
    return S.candidates(log).select("split", "list_id", "slot", "imp_id", "label")


@query("shuffle_lists")
def q_shuffle_lists(spark, sf):
    log = I.prepare_log(_imps(spark, sf))
    lists = log.where(F.col("label") != 0).select("split", F.col("imp_id").alias("list_id"))
    return S.shuffle_lists(lists)


@query("dataset")
def q_dataset(spark, sf):
    ds = L.build_dataset(*_log_and_vocab(spark, sf))
    return ds.select("split", "list_id", "user_id", F.array_join("usr", ",").alias("usr"),
                     _ids_str("candi").alias("candi"), F.array_join("labels", ",").alias("labels"),
                     _ids_str("hist").alias("hist"), "hist_len")


@query("pages_per_user")
def q_pages_per_user(spark, sf):
    ds, vocab = _dataset(spark, sf)
    return _round(L.pages_per_user(ds, vocab), "pages_per_user")


def _reshaped(spark, sf):
    ds, vocab = _dataset(spark, sf)
    return L.with_categories(ds, VO.cate_index(vocab))


@query("pad_candidates")
def q_pad_candidates(spark, sf):
    ds, _ = _dataset(spark, sf)
    c, lb, n = L.pad_candidates()
    return ds.select("list_id", _ids_str(c).alias("full_candi"),
                     F.array_join(lb, ",").alias("full_labels"), n)


@query("cate_split_candidates")
def q_cate_split_candidates(spark, sf):
    ds = _reshaped(spark, sf)
    c, lb, n = L.cate_split_candidates()
    return ds.select("list_id",
                     F.array_join(F.transform(c, _ids_str), "|").alias("candi_c"),
                     F.array_join(F.transform(lb, lambda x: F.array_join(x, ",")), "|")
                     .alias("labels_c"),
                     F.array_join(n, ",").alias("candi_len_c"))


@query("cate_split_history")
def q_cate_split_history(spark, sf):
    ds = _reshaped(spark, sf)
    h, n = H.cate_split_history("hist", "hist_len", lambda s: L.cate_of("cmap", F.element_at(s, 6)),
                                "n_cate", kind="bigint")
    return ds.select("list_id", F.array_join(F.transform(h, _ids_str), "|").alias("cate_hist"),
                     F.array_join(n, ",").alias("cate_hist_len"))


@query("union_history")
def q_union_history(spark, sf):
    ds, _ = _dataset(spark, sf)
    h, n = H.union_history("hist", "hist_len", kind="bigint")
    return ds.select("list_id", _ids_str(h).alias("union_hist"), n)


@query("seq_mask")
def q_seq_mask(spark, sf):
    from slatekit.functions.exprs import seq_mask
    ds, _ = _dataset(spark, sf)
    return ds.select("list_id", F.array_join(seq_mask("hist_len", 30), ",").alias("mask"))


@query("slot_layout")
def q_slot_layout(spark, sf):
    wide = _reshaped(spark, sf).select("split", "list_id", *L.cate_split_candidates())
    return L.slot_layout(wide).select("split", "list_id", "slot", "cate",
                                      F.array_join("item", ",").alias("item"), "label", "mask")


@query("feature_split")
def q_feature_split(spark, sf):
    ds, _ = _dataset(spark, sf)
    sp, de = L.feature_split("candi", 6)
    return ds.select("list_id", _ids_str(sp).alias("sparse"), _ids_str(de).alias("dense"))


@query("batch_assign")
def q_batch_assign(spark, sf):
    from slatekit.functions.exprs import hash60
    lists = V.served(spark, sf).select("list_id").distinct().withColumn(
        "list_order", hash60("list_id"))
    return L.batch_assign(lists).select("list_id", "batch")


# ---------------------------------------------------------------- picks / losses
from slatekit.operators import losses as LO  # noqa: E402
from slatekit.operators import picks as PK  # noqa: E402


@query("gumbel_topk")
def q_gumbel_topk(spark, sf):
    return PK.gumbel_topk(V.served(spark, sf), EXPOSURE_SCOPE).select("list_id", "slot", "pick")


@query("relaxed_topk")
def q_relaxed_topk(spark, sf):
    out = PK.relaxed_topk(V.served(spark, sf), 2)
    return _round(out.select("list_id", "slot", "khot", "pick"), "khot")


def _batched_slots(spark, sf):
    from slatekit.functions.exprs import hash60
    served = V.served(spark, sf)
    lists = served.select("list_id").distinct().withColumn("list_order", hash60("list_id"))
    batches = L.batch_assign(lists).select("list_id", "batch")
    return served.join(batches, "list_id")


@query("batch_loss")
def q_batch_loss(spark, sf):
    return _round(LO.batch_loss(_batched_slots(spark, sf)), "loss")


@query("batch_js_loss")
def q_batch_js_loss(spark, sf):
    return _round(LO.batch_js_loss(_batched_slots(spark, sf)), "js")


@query("combined_loss")
def q_combined_loss(spark, sf):
    return _round(LO.combined_loss(_batched_slots(spark, sf)), "log_loss", "js", "loss")


# ---------------------------------------------------------------- embeddings
from slatekit.operators import embeddings as EM  # noqa: E402


@query("embed_lookup")
def q_embed_lookup(spark, sf):
    ds, vocab = _dataset(spark, sf)
    c = ds.select("split", "list_id", F.posexplode("candi").alias("slot", "ids"))
    out = EM.lookup_vectors(c, ["split", "list_id", "slot"], F.col("ids"),
                            V.item_vectors(spark, sf, vocab),
                            concat=True, stats=True)
    return _round(out.select("list_id", F.col("slot").cast("bigint"), "dim", "norm", "vsum"),
                  "norm", "vsum")


@query("attn_pool")
def q_attn_pool(spark, sf):
    ds, vocab = _dataset(spark, sf)
    out = EM.attention_pool(ds, V.item_vectors(spark, sf, vocab))
    return _round(out.select("list_id", F.col("slot").cast("bigint"), *EM.vec_stats("pooled")),
                  "norm", "vsum")


@query("recency_pool")
def q_recency_pool(spark, sf):
    ds, vocab = _dataset(spark, sf)
    out = EM.recency_pool(L.with_categories(ds, VO.cate_index(vocab)),
                          V.item_vectors(spark, sf, vocab))
    return _round(out.select("list_id", "cate", F.col("n_steps").cast("bigint"),
                             *EM.vec_stats("pooled")), "norm", "vsum")


# ---------------------------------------------------------------- sources / sinks / streams
from slatekit.sources import kafka as K  # noqa: E402
from slatekit.streaming import models as MS  # noqa: E402
from slatekit.streaming import replay as RP  # noqa: E402
from slatekit.streaming import requests as RQ  # noqa: E402
from slatekit.streaming import scoring as SC  # noqa: E402


def _write_csv_logs(spark, sf):
    """The impressions of each split as a folder of CSV files in ``imp_id`` order."""
    rows = V.history_strings(V.impressions(spark, sf), others=",".join(["0"] * 30))
    ipv = [c for c in rows.columns if c.startswith("ipv_")]
    out = rows.select(
        "split", "imp_id", F.col("user_id").cast("string").alias("user_id"),
        *[F.col(c) for c in ("user_os", "user_gender", "user_age_level", "user_purchase_level",
                             "user_hour")],
        *[F.col(c).alias(f"cand_item_{c}") for c in ("pos", "pagenum", "sex", "price_level",
                                                      "age_level", "bc_type")],
        *[F.lit("").alias(f"exp_item_{c}_seq") for c in ("pos", "pagenum", "sex", "price_level",
                                                          "age_level", "bc_type")],
        *[F.col(c).alias(c.replace("ipv_", "ipv_item_")) for c in ipv],
        "label", "score")
    base = FS.run_path(spark, "csv")
    # made once: each split's bounds and its files read it
    out = FS.stage(out, "csv-rows", ["split"])
    for split in ("train", "test"):
        one = out.where(F.col("split") == split).repartitionByRange("imp_id")
        FS.write_impression_csv(one.sortWithinPartitions("imp_id"), f"{base}/{split}")
    return base


@query("src_csv_impressions")
def q_src_csv_impressions(spark, sf):
    base = _write_csv_logs(spark, sf)
    parts = []
    for split in ("train", "test"):
        log = FS.read_impression_csv(spark, f"{base}/{split}")
        parsed = H.parse_history(log, [c for c in FS.LOG_COLUMNS if c.startswith("ipv_")])
        parts.append(parsed.select(F.lit(split).alias("split"), "*"))
    allr = parts[0].unionByName(parts[1])
    from slatekit.functions.exprs import score_bucket
    return allr.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") != 0).alias("n_pos"),
        F.count_distinct("user_id").alias("n_users"),
        F.sum(score_bucket("score")).cast("bigint").alias("sum_bucket"),
        F.sum(F.when(F.col("label") != 0, F.col("hist_len"))).cast("bigint").alias("total_hist_len"))


def _csv_log(spark, sf):
    base = _write_csv_logs(spark, sf)
    return I.log_from_csv(spark, f"{base}/train", "train").unionByName(
        I.log_from_csv(spark, f"{base}/test", "test"))


@query("csv_log")
def q_csv_log(spark, sf):
    return _csv_log(spark, sf).select(
        "split", "imp_id", F.col("user_id").cast("bigint").alias("user_id"), "label", "bc_type",
        "score_bucket", F.col("hist_len").cast("int"), V.hist_str("hist").alias("hist_str"))


def _csv_dataset(spark, sf):
    imps = FS.stage(_csv_log(spark, sf), "csv-log")
    log = FS.stage(I.prepare_log(imps), "log")
    vocab = FS.stage(VO.build_vocab(imps, log).repartition("ns"), "vocab", ["ns"]).select("ns", "value", "id")
    return L.build_dataset(imps, log, vocab), vocab


@query("csv_dataset")
def q_csv_dataset(spark, sf):
    ds, _ = _csv_dataset(spark, sf)
    return ds.select("split", "list_id", F.col("user_id").cast("bigint").alias("user_id"),
                     F.array_join("usr", ",").alias("usr"), _ids_str("candi").alias("candi"),
                     F.array_join("labels", ",").alias("labels"), _ids_str("hist").alias("hist"),
                     "hist_len")


@query("staged_reuse")
def q_staged_reuse(spark, sf):
    """The second call names the same inputs and parameters, so it must give the
    table of the first, not its own (empty) plan."""
    base, served = FS.run_path(spark, "reuse"), V.served(spark, sf)
    FS.materialize(served, base, sf, "served", METRIC_SCOPES)
    back = FS.materialize(served.where(F.lit(False)), base, sf, "served", METRIC_SCOPES)
    return _round(back.agg(F.count(F.lit(1)).alias("n_rows"),
                           F.count_distinct("list_id").alias("n_lists"),
                           F.sum("label").cast("bigint").alias("n_pos"),
                           F.sum("pred").alias("sum_pred")), "sum_pred")


@query("job_rerank")
def q_job_rerank(spark, sf):
    from slatekit.plans.jobs import Job
    path = FS.run_path(spark, "rerank")
    Job(read=lambda s: V.served(s, sf), process=R.rerank,
        write=lambda df: FS.write_parquet(df, path)).run(spark)
    return spark.read.parquet(path).select("list_id", "slot", "rank")


@query("sink_parquet_roundtrip")
def q_sink_parquet_roundtrip(spark, sf):
    path = FS.run_path(spark, "served")
    FS.write_parquet(V.served(spark, sf), path)
    back = spark.read.parquet(path)
    return _round(back.agg(F.count(F.lit(1)).alias("n_rows"),
                           F.count_distinct("list_id").alias("n_lists"),
                           F.sum("label").cast("bigint").alias("n_pos"),
                           F.sum("pred").alias("sum_pred")), "sum_pred")


@query("dataset_roundtrip")
def q_dataset_roundtrip(spark, sf):
    ds, _ = _dataset(spark, sf)
    path = FS.run_path(spark, "dataset")
    FS.write_parquet(ds, path, ["split"])
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_lists"),
        F.sum("hist_len").cast("bigint").alias("sum_hist_len"),
        F.sum(F.aggregate("labels", F.lit(0), lambda a, x: a + x)).cast("bigint").alias("sum_labels"),
        F.sum(F.aggregate(F.flatten("candi"), F.lit(0).cast("bigint"), lambda a, x: a + x))
        .cast("bigint").alias("sum_candi_ids"))


@query("dataset_stat")
def q_dataset_stat(spark, sf):
    _, _, vocab = _log_and_vocab(spark, sf)
    stats = VO.stats_record(spark, vocab, VO.cate_index(vocab))
    path = FS.run_path(spark, "stat")
    FS.write_stats(stats, path)
    back = FS.read_stats(spark, path, stats.schema)
    return back.select("itm_fnum", "cate_num", "list_len", "hist_len", "ft_num", "user_num",
                       "hist_fnum", "usr_fnum", "cate_idx",
                       F.to_json(F.map_entries("cate_idx_map")).alias("cate_idx_map"))


def _requests(spark, sf, n_partitions=4, reshaped=None, batched=True):
    ds = _reshaped(spark, sf) if reshaped is None else reshaped
    payload = RQ.request_payload(L.model_ready(ds), batched=batched)
    return K.to_kafka_records(payload, "key", "value", n_partitions=n_partitions)


@query("request_publish")
def q_request_publish(spark, sf):
    rec = _requests(spark, sf)
    v = F.col("value").cast("string")
    return rec.select(F.col("key").cast("string").alias("key"), "topic", "partition", "offset",
                      F.get_json_object(v, "$['inputs/usr_ph']").alias("usr_ph"),
                      F.get_json_object(v, "$['inputs/candi_list_len']").alias("candi_list_len"),
                      F.get_json_object(v, "$['inputs/union_hist_len']").alias("union_hist_len"))


@query("request_parse")
def q_request_parse(spark, sf, batched=True):
    parsed, _ = RQ.parse_requests(_requests(spark, sf, batched=batched))
    return parsed.select("key", F.array_join("usr_ph", ",").alias("usr"),
                         F.array_join(F.transform("lb", lambda x: F.array_join(x, ",")), "|")
                         .alias("labels"),
                         F.array_join("candi_list_len", ",").alias("candi_len"),
                         "union_hist_len", "keep_prob", "is_train")


@query("request_parse_unbatched")
def q_request_parse_unbatched(spark, sf):
    return q_request_parse(spark, sf, batched=False)


@query("request_quarantine")
def q_request_quarantine(spark, sf):
    rec = _requests(spark, sf)
    broken = rec.withColumn("value", F.substring(F.col("value").cast("string"), 1, 40)
                            .cast("binary")).withColumn("key", F.concat(
                                F.col("key").cast("string"), F.lit("-broken")).cast("binary"))
    parsed, bad = RQ.parse_requests(rec.unionByName(broken))
    return (parsed.select(F.lit("parsed").alias("kind"), "key")
            .unionByName(bad.select(F.lit("quarantine").alias("kind"), "key"))
            .groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


@query("batch_score")
def q_batch_score(spark, sf):
    parsed, _ = RQ.parse_requests(_requests(spark, sf))
    return _round(SC.score_requests(parsed).select("key", "slot", "pred"), "pred")


@query("batch_replay")
def q_batch_replay(spark, sf):
    """A micro-batch that is processed twice is written once; an empty one
    writes nothing."""
    path = FS.run_path(spark, "replay")
    rec = FS.stage(_requests(spark, sf), "requests")
    process = SC.scoring_batch(path)
    process(rec, 0)
    process(rec, 0)
    process(rec.where(F.lit(False)), 1)
    return _round(spark.read.parquet(path).select("key", "slot", "pred"), "pred")


@query("stream_score")
def q_stream_score(spark, sf):
    base = FS.run_path(spark, "stream")
    # short row groups: a micro-batch is one file, and its tasks read row groups
    _requests(spark, sf).repartition(4).write.option("parquet.block.size", 1 << 24).parquet(f"{base}/source")
    src = K.read_request_files(spark, f"{base}/source", max_files_per_trigger=1)
    SC.run_stream_scoring(spark, src, f"{base}/preds", f"{base}/checkpoint",
                          f"{base}/quarantine")
    return _round(spark.read.parquet(f"{base}/preds").select("key", "slot", "pred"), "pred")


# ---------------------------------------------------------------- learning / selection
from slatekit.operators import learning as LR  # noqa: E402


@query("fit_and_rerank")
def q_fit_and_rerank(spark, sf):
    ds, _ = _dataset(spark, sf)
    return _round(LR.fit_and_rerank(ds), "ndcg", "map", "utility")


@query("metrics_compare")
def q_metrics_compare(spark, sf):
    return _round(LR.metrics_compare(V.served(spark, sf)), "ndcg", "map", "utility")


def _run_metrics(spark, sf):
    """Every candidate ranker of the served lists evaluated on the whole table
    (ndcg@5, map@5 and exposure JS per ranker)."""
    served = FS.stage(V.served(spark, sf).select("list_id", "slot", "cate", "label", "pred"), "served")
    runs = {
        "by_pred": served,
        "by_inverse_pred": served.withColumn("pred", 1 - F.col("pred")),
        "by_gumbel": served.withColumn("pred", F.col("pred") + PK.gumbel_noise("list_id", "slot")),
    }
    parts = []
    for name, df in runs.items():
        m = R.rank_metrics(df, [5]).select(
            F.lit(name).alias("run"),
            F.explode(F.array(F.struct(F.lit("ndcg@5").alias("metric"), F.col("ndcg").alias("value")),
                              F.struct(F.lit("map@5").alias("metric"), F.col("map").alias("value"))))
            .alias("m")).select("run", "m.*")
        js = M.exposure_js(df).select(F.lit(name).alias("run"), F.lit("js").alias("metric"),
                                      F.col("js").alias("value"))
        parts += [m, js]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("ranker_select")
def q_ranker_select(spark, sf):
    rm = _run_metrics(spark, sf)
    out = LR.best_run(rm, "ndcg@5", True).unionByName(LR.best_run(rm, "js", False))
    return _round(out, "best_value")


@query("batch_early_stop")
def q_batch_early_stop(spark, sf):
    slots = _batched_slots(spark, sf)
    per = R.list_metrics(slots.select("list_id", "slot", "pred", "label"), [5]).join(
        slots.select("list_id", "batch").distinct(), "list_id")
    evals = per.groupBy("batch").agg(F.avg("ndcg").alias("value")).select(
        F.lit("by_pred").alias("run"), F.col("batch").alias("step"),
        (F.col("batch") / 2).cast("bigint").alias("epoch"), "value")
    return _round(LR.early_stop(evals), "value", "best")


RUNS = {"rate_1": 1.0, "rate_03": 0.3}       # learning rate of each run
EVALS, STEPS_BETWEEN, MONITOR = 2, 2, "ndcg@5"
LIST = ("split", "list_id")


def _evaluate(scored):
    """(metrics, list metrics) of scored test slots."""
    x = FS.stage(scored.select(*LIST, "slot", "cate", F.col("label").cast("int").alias("label"),
                               F.round("pred", 10).alias("pred")), "scored")
    per = FS.stage(R.list_metrics(x, [5], list_col=LIST), "list-metrics")
    means = per.agg(F.avg("ndcg").alias("ndcg"), F.avg("map").alias("map"))
    parts = [means.select(F.inline(F.array(*[F.struct(F.lit(f"{c}@5").alias("metric"), F.col(c).alias("value"))
                                             for c in ("ndcg", "map")]))),
             M.exposure_js(x, list_col=LIST).select(F.lit("js").alias("metric"), F.col("js").alias("value")),
             M.auc(x).select(F.lit("auc").alias("metric"), F.col("auc").alias("value")),
             M.log_loss(x).select(F.lit("log_loss").alias("metric"), F.col("log_loss").alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, per


def _run_log(spark, sf):
    """The log of training runs over the lists, made once for the events as they
    are; a run that was cut short is made again and replaces its partitions."""
    from slatekit.sources import shared

    events = table(spark, sf, "events")
    key = FS.fingerprint(FS.input_files(events), FS.code_fingerprint(), split_rows(events), RUNS, EVALS, STEPS_BETWEEN)
    log = LR.RunLog(spark, f"{scratch_dir(spark, 'runs')}/{key}")
    if not shared.exists(spark, f"{log.path}/done"):
        with FS.staging(spark):
            rows = FS.stage(LR.slot_rows(_reshaped(spark, sf)), "slots", ["split"])
            train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
            for run, rate in RUNS.items():
                LR.train_run(log, run, train, test, _evaluate, EVALS, STEPS_BETWEEN, rate, MONITOR)
        shared.mark(spark, f"{log.path}/done")
    return log


@query("run_log")
def q_run_log(spark, sf):
    return _round(_run_log(spark, sf).read(), "value")


@query("run_list_metrics")
def q_run_list_metrics(spark, sf):
    """The list metrics that were written at each improvement."""
    out = _run_log(spark, sf).read_lists()
    return _round(out.select("run", F.col("step").cast("bigint").alias("step"), "split", "list_id", "k", "ndcg",
                             "map", "utility"), "ndcg", "map", "utility")


@query("best_run")
def q_best_run(spark, sf):
    log = _run_log(spark, sf).read()
    out = LR.best_run(log, MONITOR, True).unionByName(LR.best_run(log, "js", False)).unionByName(
        LR.best_run(log, "log_loss", False))
    return _round(out, "best_value")


@query("early_stop")
def q_early_stop(spark, sf):
    log = _run_log(spark, sf).read()
    rule = {"min_epoch": 0, "drop": 0.001, "min_evals": 1}
    up = LR.early_stop(log.where(F.col("metric") == MONITOR).drop("metric"), **rule)
    down = LR.early_stop(log.where(F.col("metric") == "js").drop("metric"), maximize=False, **rule)
    out = up.withColumn("metric", F.lit(MONITOR)).unionByName(down.withColumn("metric", F.lit("js")))
    return _round(out, "value", "best")


def _dense_dataset(spark, sf):
    """Lists whose candidates carry their affinities as dense features."""
    def build():
        ds, vocab = _dataset(spark, sf)
        x = L.with_categories(ds, VO.cate_index(vocab))
        return L.pack_dense(ds, EM.affinities(x, V.item_vectors(spark, sf, vocab)), 2)
    events, vecs = table(spark, sf, "events"), table(spark, sf, "embeddings")
    ds = FS.reuse("dense", [events, vecs], build, split_rows(events))
    return L.with_categories(ds, VO.cate_index(_dataset(spark, sf)[1]))


@query("serve_fitted")
def q_serve_fitted(spark, sf):
    """A model fitted on ids and pooled features, saved, exported and
    served from its store to requests, in batch and on a stream; its predictions
    beside those of the saved pipeline."""
    base = FS.run_path(spark, "serve")
    ds = _dense_dataset(spark, sf)
    rows = LR.slot_rows(ds.drop("cmap"), 2)
    LR.fit_pointwise(rows.where(F.col("split") == "train"), n_dense=2).write().save(f"{base}/pipeline")
    model = LR.PipelineModel.load(f"{base}/pipeline")
    store = MS.ModelStore(spark, f"{base}/model")
    store.publish(*LR.export_pointwise(model, spark))

    wide = ds.select(*LIST, *L.cate_split_candidates(width=9, kind="double"))
    slots = L.slot_layout(wide).where("mask = 1").select(*LIST, "slot", *LR.item_columns("item", 2))
    want = LR.predict(model, slots).select(*LIST, "slot", F.col("pred").alias("want"))
    payload = RQ.request_payload(L.model_ready(ds, item_dense=2), item_dense=2)
    rec = FS.stage(K.to_kafka_records(payload, "key", "value", n_partitions=4), "requests")
    parsed, _ = RQ.parse_requests(rec)
    rec.write.parquet(f"{base}/source")
    SC.run_stream_scoring(spark, K.read_request_files(spark, f"{base}/source"), f"{base}/preds",
                          f"{base}/checkpoint", factory=store)
    served = {"batch": SC.score_requests(parsed, store.current()), "stream": spark.read.parquet(f"{base}/preds")}
    parts = []
    for mode, preds in served.items():
        x = R.join_predictions(preds.select(*RQ.list_of_key(), "slot", "pred"), want)
        parts.append(x.agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n_slots"),
                           F.count_if(F.abs(F.col("pred") - F.col("want")) <= 1e-9).alias("n_equal"),
                           F.count_if(F.col("pred").between(0, 1)).alias("n_in_range")))
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- scored lists
def _scored_slots(spark, sf, ds=None):
    """Scores of every request joined (J7) to the slot-layout labels and mask."""
    ds = _reshaped(spark, sf) if ds is None else ds
    _, labels, n = L.cate_split_candidates()
    parsed, _ = RQ.parse_requests(_requests(spark, sf, reshaped=ds))
    preds = SC.score_requests(parsed, packed=True).select(*RQ.list_of_key(), "preds")
    # joined by list and laid out after it: a thirtieth of the rows to shuffle and sort
    both = R.join_predictions(preds, ds.select(*LIST, labels, n), LIST)
    return L.slot_layout(both).select(*LIST, "slot", "pred", "cate", "label", "mask")


@query("scored_metrics")
def q_scored_metrics(spark, sf):
    out = R.rank_metrics(_scored_slots(spark, sf), METRIC_SCOPES, is_rank=True, list_col=LIST)
    return _round(out, "ndcg", "map", "utility")


@query("csv_scored_metrics")
def q_csv_scored_metrics(spark, sf):
    """From CSV files, where list ids start anew in every split."""
    ds, vocab = _csv_dataset(spark, sf)
    x = _scored_slots(spark, sf, L.with_categories(FS.stage(ds, "dataset"), VO.cate_index(vocab)))
    x = FS.stage(x, "scored")
    out = R.rank_metrics(x, METRIC_SCOPES, is_rank=True, list_col=LIST)
    n = x.agg(F.count(F.lit(1)).alias("n_slots"))
    return _round(out.crossJoin(F.broadcast(n)), "ndcg", "map", "utility")        # one row


@query("slot_order_metrics")
def q_slot_order_metrics(spark, sf):
    """The initial order of the slot layout, category by category, padding
    included."""
    out = R.rank_metrics(_scored_slots(spark, sf), METRIC_SCOPES, is_rank=False, list_col=LIST)
    return _round(out, "ndcg", "map", "utility")


@query("scored_exposure_js")
def q_scored_exposure_js(spark, sf):
    """A13 over scored slots: padding that reaches the top counts."""
    x = FS.stage(_scored_slots(spark, sf), "scored")
    parts = [M.exposure_js(x, TARGET_EXPOSURE, EXPOSURE_SCOPE, is_rank=r, list_col=LIST).withColumn(
        "stage", F.lit("rerank" if r else "initial")) for r in (True, False)]
    return _round(parts[0].unionByName(parts[1]), "js")


@query("scored_auc")
def q_scored_auc(spark, sf):
    return _round(M.auc(_scored_slots(spark, sf), mask_col="mask"), "auc")


@query("scored_auc_binned")
def q_scored_auc_binned(spark, sf):
    """The binned estimate, its bounds, and whether they hold the exact value."""
    x = FS.stage(_scored_slots(spark, sf), "scored")
    exact = M.auc(x, mask_col="mask").withColumnRenamed("auc", "exact")
    out = M.auc_binned(x, 64, mask_col="mask").crossJoin(F.broadcast(exact))      # one row
    inside = F.col("exact").between(F.col("auc_low"), F.col("auc_high")) & (
        F.abs(F.col("exact") - F.col("auc")) <= F.col("error"))
    return _round(out.select("auc_low", "auc", "auc_high", "error", inside.cast("int").alias("inside")),
                  "auc_low", "auc", "auc_high", "error")


@query("graded_metrics")
def q_graded_metrics(spark, sf):
    """W5 with labels above 1."""
    x = V.served(spark, sf).withColumn("label", (F.col("item_id") % 5).cast("int"))
    return _round(R.rank_metrics(x, METRIC_SCOPES), "ndcg", "map", "utility")


@query("log_loss_slots")
def q_log_loss_slots(spark, sf):
    s = FS.stage(_scored_slots(spark, sf), "scored")
    masked = M.log_loss(s, mask_col="mask").withColumnRenamed("log_loss", "masked")
    full = M.log_loss(s).withColumnRenamed("log_loss", "unmasked")
    return _round(masked.crossJoin(full), "masked", "unmasked")


@query("request_dense")
def q_request_dense(spark, sf):
    """P8 with dense features: two behind the ids of an item, one behind those of
    a history step."""
    ds = _reshaped(spark, sf)

    def with_dense(c, *at):
        return F.transform(c, lambda f: F.concat(
            F.transform(f, lambda v: v.cast("double")),
            F.array(*[(F.element_at(f, i) % 97) / 97 for i in at])))
    mr = L.model_ready(ds.withColumn("candi", with_dense("candi", 1, 7)).withColumn("hist", with_dense("hist", 2)),
                       item_dense=2, hist_dense=1)
    payload = RQ.request_payload(mr, item_dense=2, hist_dense=1)
    parsed, _ = RQ.parse_requests(K.to_kafka_records(payload, "key", "value"))

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return _round(parsed.select(
        "key", F.array_join(F.transform("candi_itm_ft", _ids_str), "|").alias("candi"),
        total(F.flatten(F.flatten("candi_itm_dens"))).alias("item"),
        total(F.flatten(F.flatten("cate_hist_dens"))).alias("cate"),
        total(F.flatten("union_hist_dens")).alias("uni")), "item", "cate", "uni")


SECOND = MS.LinearScorer((-0.2, 0.7, 0.1, -0.4, 0.5, 0.3, -0.6), 0.2)


@query("stream_versions")
def q_stream_versions(spark, sf):
    """Two versions of a stored model in one running stream: the second is
    published between micro-batches."""
    base = FS.run_path(spark, "versions")
    store = MS.ModelStore(spark, f"{base}/model")
    store.publish(MS.LinearScorer().spec())
    rec = FS.stage(_requests(spark, sf), "requests")
    rec.where("partition < 2").write.parquet(f"{base}/source")
    q = SC.run_stream_scoring(spark, K.read_request_files(spark, f"{base}/source"), f"{base}/preds",
                              f"{base}/checkpoint", factory=store, available_now=False,
                              processing_time="0 seconds")
    try:
        q.processAllAvailable()
        store.publish(SECOND.spec())
        rec.where("partition >= 2").write.mode("append").parquet(f"{base}/source")
        q.processAllAvailable()
    finally:
        q.stop()
    return _round(spark.read.parquet(f"{base}/preds").select("key", "slot", "pred"), "pred")


@query("paced_replay")
def q_paced_replay(spark, sf):
    """The requests replayed at a set rate, stopped after a while and started
    again from its checkpoint; every request comes once."""
    base = FS.run_path(spark, "paced")
    rec = FS.stage(_requests(spark, sf), "requests")
    RP.write_replay(rec, f"{base}/replay")
    total = rec.count()
    for part in (0.3, 1.0):
        src = RP.read_replay(spark, f"{base}/replay", f"{base}/progress", max(1, total / 3), -(-total // 4))
        RP.run_until(src, f"{base}/out", f"{base}/checkpoint", int(total * part))
    out = spark.read.parquet(f"{base}/out") if total else rec
    return out.groupBy(F.col("key").cast("string").alias("key"), "topic", "partition", "offset").agg(
        F.count(F.lit(1)).alias("n"))


@query("union_history_reversed")
def q_union_history_reversed(spark, sf):
    ds, _ = _dataset(spark, sf)
    h, n = H.union_history("hist", "hist_len", cloud=False, reverse=True, kind="bigint")
    return ds.select("list_id", _ids_str(h).alias("union_hist"), n)
