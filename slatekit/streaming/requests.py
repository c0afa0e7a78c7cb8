"""Request payloads (P8, M9) and their parsing.

A request carries one model-ready list as JSON with keys ``inputs/<name>``
and a leading batch dimension of 1; its record key names the split and the list
(``list_key``), as list ids may start anew in every split.  Dense features that
follow an item's or step's ids go into inputs of their own.  Parsing accepts the payload with or
without that batch dimension, renames the signature aliases and sets the
inference constants; values that are not JSON (or truncated JSON) go to a
quarantine output instead of being dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatekit.config import HIST_FIELDS, ITEM_FIELDS
from slatekit.functions.exprs import col, let

# FIXED VALUES: names of the request's inputs (INPUTS, DENSE) and of the serving
# signature (ALIASES).
INPUTS = {
    "usr_ph": "usr",
    "candi_itm_ft": "candi_c",
    "candi_list_len": "candi_len_c",
    "lb": "labels_c",
    "cate_hist_ft": "cate_hist",
    "cate_hist_len": "cate_hist_len",
    "union_hist_ft": "union_hist",
    "union_hist_len": "union_hist_len",
}
# Dense inputs: the row's column, ids before the dense features, array depth.
DENSE = {
    "candi_itm_dens": ("candi_c", len(ITEM_FIELDS), 3),
    "cate_hist_dens": ("cate_hist", len(HIST_FIELDS), 3),
    "union_hist_dens": ("union_hist", len(HIST_FIELDS), 2),
}
ALIASES = {"labels": "lb", "user_features": "usr_ph"}

KEY_SEPARATOR = ":"

_L = T.LongType()
_I = T.IntegerType()
_D = T.DoubleType()


def list_key(split: str | Column = "split", list_id: str | Column = "list_id") -> Column:
    """The record key of a list: ``<split>:<list_id>``."""
    return F.concat_ws(KEY_SEPARATOR, col(split), col(list_id).cast("string"))


def list_of_key(key: str | Column = "key", id_type: str = "bigint") -> list[Column]:
    """``split`` and ``list_id`` of a record key."""
    k = col(key).cast("string")
    at = F.instr(k, KEY_SEPARATOR)
    return [F.substr(k, F.lit(1), at - 1).alias("split"),
            F.substr(k, at + 1).cast(id_type).alias("list_id")]


def _arr(t, depth):
    for _ in range(depth):
        t = T.ArrayType(t)
    return t


# element type and depth (without batch dimension) of every input
_SHAPES = {
    "usr_ph": (_L, 1), "candi_itm_ft": (_L, 3), "candi_list_len": (_I, 1), "lb": (_I, 2),
    "cate_hist_ft": (_L, 3), "cate_hist_len": (_I, 1), "union_hist_ft": (_L, 2),
    "union_hist_len": (_I, 0),
    **{name: (_D, depth) for name, (_, _, depth) in DENSE.items()},
}


def request_schema(batched: bool) -> T.StructType:
    extra = 1 if batched else 0
    fields = [T.StructField(f"inputs/{n}", _arr(t, d + extra)) for n, (t, d) in _SHAPES.items()]
    # serving-signature names accepted in place of the request names
    fields += [T.StructField(f"inputs/{alias}", _arr(*_SHAPES[name][:1], _SHAPES[name][1] + extra))
               for alias, name in ALIASES.items()]
    fields += [T.StructField("inputs/keep_prob", T.DoubleType()),
               T.StructField("inputs/is_train", T.BooleanType()),
               T.StructField("_corrupt", T.StringType())]
    return T.StructType(fields)


def _innermost(c: Column, depth: int, fn: Callable[[Column], Column]) -> Column:
    """``fn`` applied to the innermost arrays of ``c``."""
    return fn(c) if depth == 1 else F.transform(c, lambda x: _innermost(x, depth - 1, fn))


def request_payload(mr: DataFrame, key: Column | None = None, split_hist: bool = True,
                    union_hist: bool = True, batched: bool = True, item_dense: int = 0,
                    hist_dense: int = 0) -> DataFrame:
    """P8 + M9: one JSON request per model-ready list (batch dimension 1,
    left out unless ``batched``); the per-category and union histories are
    included per flag.  Where rows carry ``item_dense`` or ``hist_dense`` dense
    features after the ids, ids and dense features become separate inputs.  The
    record key is ``list_key`` where the rows have a split, else the list id."""
    if key is None:
        key = list_key() if "split" in mr.columns else F.col("list_id")
    skip = set()
    if not split_hist:
        skip |= {"cate_hist_ft", "cate_hist_len", "cate_hist_dens"}
    if not union_hist:
        skip |= {"union_hist_ft", "union_hist_len", "union_hist_dens"}
    n_dense = {"candi_itm_dens": item_dense, "cate_hist_dens": hist_dense, "union_hist_dens": hist_dense}
    inputs = {name: F.col(src) for name, src in INPUTS.items()}
    for name, (src, n_ids, depth) in DENSE.items():
        if n_dense[name]:
            ids = name.replace("_dens", "_ft")
            inputs[ids] = _innermost(F.col(src), depth, lambda f, n=n_ids: F.transform(
                F.slice(f, 1, n), lambda v: v.cast("bigint")))
            inputs[name] = _innermost(F.col(src), depth, lambda f, n=n_ids, m=n_dense[name]: F.slice(f, n + 1, m))
    fields = [(F.array(c) if batched else c).alias(f"inputs/{name}")
              for name, c in inputs.items() if name not in skip]
    fields += [F.lit(1.0).alias("inputs/keep_prob"), F.lit(False).alias("inputs/is_train")]
    return mr.select(key.alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def _request(txt: Column, batched: bool) -> Column:
    """The request's inputs without the batch dimension, null where the text is
    not such a request."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return let(F.from_json(txt, request_schema(batched), opts), lambda r: F.when(
        r.getField("_corrupt").isNull() & _complete(r, batched),
        F.struct(*[_first_of(r, n, batched).alias(n) for n in _SHAPES])))


def parse_records(records: DataFrame) -> DataFrame:
    """T1 + X9: one parse of every record, as ``_req`` (null where it failed).
    The batched payload is parsed first; the unbatched parse (missing batch
    dimension) is evaluated only for records the batched parse rejected."""
    txt = F.col("value").cast("string")
    return records.select(F.col("key").cast("string").alias("key"), "topic", "partition", "offset",
                          "timestamp", txt.alias("_raw"),
                          F.coalesce(_request(txt, True), _request(txt, False)).alias("_req"))


_NAMES = {n: [n] + [a for a, m in ALIASES.items() if m == n] for n in _SHAPES}


def _first_of(src: Column, name: str, batched: bool):
    """The request name first, else its signature alias."""
    vals = [src.getField(f"inputs/{k}") for k in _NAMES[name]]
    if batched:
        vals = [F.get(v, F.lit(0)) for v in vals]
    return F.coalesce(*vals) if len(vals) > 1 else vals[0]


def _complete(src: Column, batched: bool):
    """A request the scorer can read: user, candidates and list lengths are
    there, categories hold equally many candidates of ``ITEM_FIELDS`` ids, dense
    features (if any) are equally many for every candidate, and nothing inside is
    null.  Anything else goes to quarantine (T5)."""
    candi, lens = _first_of(src, "candi_itm_ft", batched), _first_of(src, "candi_list_len", batched)
    slots = F.size(F.get(candi, F.lit(0)))
    whole = F.forall(candi, lambda c: c.isNotNull() & (F.size(c) == slots) & F.forall(
        c, lambda item: item.isNotNull() & (F.size(item) == len(ITEM_FIELDS)) & F.forall(
            item, lambda v: v.isNotNull())))
    dense = _first_of(src, "candi_itm_dens", batched)
    per = F.size(F.get(F.get(dense, F.lit(0)), F.lit(0)))
    dense_whole = dense.isNull() | ((F.size(dense) == F.size(candi)) & F.forall(
        dense, lambda c: c.isNotNull() & (F.size(c) == slots) & F.forall(
            c, lambda item: item.isNotNull() & (F.size(item) == per) & F.forall(
                item, lambda v: v.isNotNull()))))
    return F.coalesce(
        dense_whole & _first_of(src, "usr_ph", batched).isNotNull() & (F.size(candi) > 0)
        & (F.size(candi) == F.size(lens)) & F.forall(lens, lambda n: n.isNotNull()) & whole, F.lit(False))


def split_parsed(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T2 + T5: (parsed, quarantine) from ``parse_records`` output.  Parsed
    rows carry the model inputs without the batch dimension, ``keep_prob =
    1`` and ``is_train = false``; quarantine rows keep the raw text."""
    meta = ["key", "topic", "partition", "offset", "timestamp"]
    # exploded, not filtered: the optimizer would copy the parse into the filter
    ok = F.explode(F.filter(F.array("_req"), lambda r: r.isNotNull())).alias("_req")
    parsed = x.select(*meta, ok).select(*meta, "_req.*", F.lit(1.0).alias("keep_prob"),
                                        F.lit(False).alias("is_train"))
    quarantine = x.where(F.col("_req").isNull()).select(*meta, F.col("_raw").alias("raw"))
    return parsed, quarantine


def parse_requests(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T1 + T2 + X9 + T5: (parsed, quarantine)."""
    return split_parsed(parse_records(records))
