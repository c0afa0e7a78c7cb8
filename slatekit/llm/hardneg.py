"""Hard negatives by L2AP-style threshold joins.

An anchor's positives are its best rows of the same label; for each positive, its
hard negatives are the best rows of other labels whose score lies between two
shares of the positive's score.  Both are searches for the best ``k`` rows in a
window of scores, by one routine (``best_in_windows``):

* Rows stream through tasks in Arrow batches.  For a batch and a band of anchors
  with like thresholds, an inverted index holds the leading dimensions of each
  row and omits the trailing ones that the suffix-norm bound covers: no anchor of
  the band can reach its threshold with them alone.  A posting list is a run of
  the rows sorted by how far they are indexed.
* Partial scores are accumulated over the posting lists, pairs whose partial score
  plus the product of the remaining norms is under the threshold are pruned, and
  the others are scored in full.  Scores are integers and exact.
* A batch gives at most ``k`` pairs a window (ties by id), so copies of a vector
  are never expanded into pairs.
* Thresholds start where a bounded sample of rows expects a few times ``k``
  matches; windows that do not fill go to the next round with a lower threshold,
  at last the window's floor, so that results never depend on the sample.

Anchors are written in blocks of about ``BLOCK`` to the shared folder
(``spark.checkpoint.dir``), and tasks read them there: nothing passes through the
driver but counts.

Defined results: rows with a null label or vector, or a null or non-finite
component, take no part; a shorter vector counts as ending in zeros, an empty one
scores 0; rows with equal ids are rows of their own (an anchor is not its own
positive, another row with its id may be); null ids are never anchors and come
last among ties; a negative positive_score has no negatives; scores beyond 2^59
either way count as that; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatekit.llm.common import Scratch, ship_package, shuffle_partitions, table
from slatekit.llm.warc import file_system

SCALE = 256              # a component x counts as floor(SCALE * x)
POSITIVES, NEGATIVES = 5, 10
LOW_SHARE, HIGH_SHARE = 30, 90     # of the positive's score, in hundredths
BLOCK = 4096             # anchors of one block, about, and
VALUES = 1 << 20         # at most about so many components in it, or in rows searched together
BAND = 256               # anchors that share an index
STRIDE = 4               # dimensions of one posting run
SAMPLE = 4096            # rows that set the first thresholds
EXPECT = (3, 24)         # matches expected in each round, times k; then the floor
FAR = 1 << 59            # scores are cut off here
EXACT32, EXACT64 = 1 << 24, 1 << 26    # norm products, norms that stay exact
SLACK = 1 + 1e-9         # of rounded norms


def scaled(column: pa.Array) -> np.ndarray:
    """Lists of numbers as a matrix of floor(SCALE * x), short ones zero-filled."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    with np.errstate(over="ignore"):
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.nan_to_num(np.floor(flat * SCALE))
    return out


def widened(x: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dims - x.shape[1]))) if x.shape[1] < dims else x


def norm(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(axis=1))


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """[i, p]: norm of the dimensions of row i from p on."""
    out = np.zeros((len(x), x.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum((x * x)[:, ::-1], axis=1))[:, ::-1]
    return out * SLACK


def long_score(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of two rows by integers of any size."""
    return max(-FAR, min(FAR, sum(int(p) * int(q) for p, q in zip(a, b))))


def threshold_join(a: np.ndarray, least: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
    """Every pair (i, j) with a[i] . x[j] >= least[i], and its score, in parts:
    one for each band of anchors, and those of components too large for floats."""
    dims = max(a.shape[1], x.shape[1])
    a, x = widened(a, dims), widened(x, dims)
    na, nx = norm(a), norm(x)
    wide, far = np.flatnonzero(~(na < EXACT64)), np.flatnonzero(~(nx < EXACT64))
    queries, rows = np.flatnonzero(na < EXACT64), np.flatnonzero(nx < EXACT64)
    for qs, rs in ((wide, np.arange(len(x))), (queries, far)):
        for i in qs:
            s = np.array([long_score(a[i], x[j]) for j in rs], np.int64)
            hit = np.flatnonzero(s >= least[i])
            yield np.full(len(hit), i), rs[hit], s[hit]
    if not len(queries) or not len(rows):
        return
    # dimensions by decreasing weight leave short suffixes
    turn = np.argsort(-(a[queries] ** 2).sum(axis=0), kind="stable")
    exact = np.float32 if na[queries].max() * nx[rows].max() < EXACT32 else np.float64
    held = x[rows][:, turn]
    norms, held = suffix_norms(held), held.astype(exact)
    queries = queries[np.argsort(-least[queries], kind="stable")]
    for k in range(0, len(queries), BAND):
        band = queries[k:k + BAND]
        i, j, s = _indexed_join(a[band][:, turn], least[band], held, norms)
        yield band[i], rows[j], s


def _indexed_join(a, least, x, sx):
    dims = x.shape[1]
    sa = suffix_norms(a)
    a = a.astype(x.dtype)
    floor = float(least.min())
    # trailing dimensions that cannot reach the lowest threshold stay out
    covered = sx * sa[:, 0].max() < floor
    cut = np.where(covered.any(axis=1), covered.argmax(axis=1), dims)
    out = covered[:, 0]                                        # rows that no anchor can reach
    cut = np.minimum(-(-cut // STRIDE) * STRIDE, dims)
    order = np.argsort(-cut, kind="stable")
    order = order[~out[order]]
    held, reach = x[order], cut[order]
    partial = np.zeros((len(a), len(order)), x.dtype)
    for d in range(0, dims, STRIDE):
        n = int(np.searchsorted(-reach, -d, side="left"))      # rows indexed beyond d
        if not n:
            break
        partial[:, :n] += a[:, d:d + STRIDE] @ held[:n, d:d + STRIDE].T
    rest = sa[:, reach] * sx[order, reach]
    i, j = np.nonzero(partial + rest * SLACK >= least[:, None])
    score = np.zeros(len(i), np.int64)
    for k in range(0, len(i), 1 << 16):
        p, q = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
        score[k:k + (1 << 16)] = np.einsum("ij,ij->i", a[p], held[q]).astype(np.int64)
    hit = score >= least[i]
    return i[hit], order[j[hit]], score[hit]


@lru_cache(maxsize=4)
def _block(folder: str, number: int) -> dict:
    """Anchors of one block; windows as arrays [anchor, place], unused places
    shut by a floor above their ceiling."""
    fs, path = file_system(f"{folder}/blk={number}")
    t = pq.read_table(path, filesystem=fs, partitioning=None)
    wins = t.column("wins").to_pylist()
    places = max(map(len, wins))
    shape = (len(wins), places)
    out = {"a": t.column("a").to_numpy(), "label": t.column("label").to_numpy(zero_copy_only=False),
           "x": scaled(t.column("vec").combine_chunks()),
           "w": np.zeros(shape, np.int32), "t": np.full(shape, FAR + 1), "hi": np.full(shape, -FAR - 1)}
    for i, ws in enumerate(wins):
        for p, w in enumerate(ws):
            out["w"][i, p], out["t"][i, p], out["hi"][i, p] = w["w"], w["t"], w["hi"]
    return out


def _pairs(block: dict, label: np.ndarray, x: np.ndarray, same: bool) -> Iterator[tuple]:
    least = block["t"].min(axis=1)
    if not same:
        yield from threshold_join(block["x"], least, x)
        return
    for v in np.intersect1d(block["label"], label):
        qs, rs = np.flatnonzero(block["label"] == v), np.flatnonzero(label == v)
        for i, j, s in threshold_join(block["x"][qs], least[qs], x[rs]):
            yield qs[i], rs[j], s


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows searched together: fewer of long vectors."""
    for batch in batches:
        if batch.num_rows:
            most = max(1, pc.max(pc.list_value_length(batch.column("vec"))).as_py() or 0)
            rows = max(1, VALUES // most)
            for k in range(0, batch.num_rows, rows):
                yield batch.slice(k, rows)


def _search(folder: str, blocks: list[int], k: int, same: bool):
    """The best ``k`` pairs of each window that a batch of rows gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rid = batch.column("r").to_numpy()
            label = batch.column("label").to_numpy(zero_copy_only=False)
            x = scaled(batch.column("vec"))
            tie = pc.rank(batch.column("id"), sort_keys="ascending", null_placement="at_end",
                          tiebreaker="dense").to_numpy().astype(np.int64)
            for number in blocks:
                b = _block(folder, number)
                for i, j, s in _pairs(b, label, x, same):
                    ok = b["a"][i] != rid[j]
                    if not same:
                        ok &= b["label"][i] != label[j]
                    i, j, s = i[ok], j[ok], s[ok]
                    for p in range(b["w"].shape[1]):
                        i2, j2, s2 = _best(b, p, i, j, s, tie, rid, k)
                        if len(i2):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(b["a"][i2]), pa.array(b["w"][i2, p]), pa.array(rid[j2]),
                                 batch.column("id").take(pa.array(j2)), pa.array(s2)],
                                names=["a", "w", "r", "id", "score"])
    return run


def _best(b: dict, p: int, i, j, s, tie, rid, k: int):
    """Of the pairs, the best ``k`` inside each anchor's window at place ``p``."""
    inside = (s >= b["t"][i, p]) & (s <= b["hi"][i, p])
    i, j, s = i[inside], j[inside], s[inside]
    order = np.lexsort((rid[j], tie[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    at = np.arange(len(i))
    start = np.maximum.accumulate(np.where(np.diff(i, prepend=-1) != 0, at, 0))
    top = at - start < k
    return i[top], j[top], s[top]


def _ladder(folder: str, k: int, same: bool, total: int):
    """Thresholds of each round for windows (a, w, label, vec, lo, hi)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        t = pq.read_table(path, filesystem=fs)
        rid, label, x = t.column("r").to_numpy(), t.column("label").to_numpy(zero_copy_only=False), scaled(t.column("vec").combine_chunks())
        per = max(1.0, total / max(1, len(rid)))
        ranks = [max(1, math.ceil(e * k / per)) for e in EXPECT]
        for batch in batches:
            a, own = batch.column("a").to_numpy(), batch.column("label").to_numpy(zero_copy_only=False)
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            q = scaled(batch.column("vec"))
            dims = max(q.shape[1], x.shape[1])
            q, held = widened(q, dims), widened(x, dims).T
            steps = []
            for n in range(len(q)):
                with np.errstate(over="ignore", invalid="ignore"):
                    guess = np.nan_to_num(q[n] @ held, posinf=FAR, neginf=-FAR)    # rounding does no harm
                fit = (label == own[n]) if same else (label != own[n])
                s = np.sort(np.clip(guess[fit & (rid != a[n]) & (guess <= hi[n])], -FAR, FAR))[::-1]
                steps.append([max(int(lo[n]), int(np.floor(s[r - 1]))) if r <= len(s) else int(lo[n])
                              for r in ranks] + [int(lo[n])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("w"), batch.column("lo"), batch.column("hi"),
                 pa.array(steps, pa.list_(pa.int64()))], names=["a", "w", "lo", "hi", "steps"])
    return run


def best_in_windows(rows: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool,
                    scratch: Scratch, name: str, block: int = BLOCK) -> DataFrame:
    """(a, w, r, id, score, rank): the best ``k`` rows of ``rows`` (r, id,
    label, vec) in each window (a, w, lo, hi) of the anchors (a, label, vec), of
    the anchor's label or of the others."""
    spark = rows.sparkSession
    ship_package(spark)
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 1
    block = max(1, min(block, VALUES // max(1, longest)))
    some = scratch.path(f"{name}-sample")
    rows.orderBy(F.xxhash64("r"), "r").limit(SAMPLE).select("r", "label", "vec").coalesce(1).write.parquet(some)
    total = rows.count()
    steps = scratch.write(
        windows.join(anchors, "a").select("a", "w", "label", "vec", "lo", "hi")
        .mapInArrow(_ladder(some, k, same, total), "a long, w int, lo long, hi long, steps array<long>"), f"{name}-steps")
    at = Window.partitionBy("a", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "r")
    schema = f"a long, w int, r long, id {rows.schema['id'].dataType.simpleString()}, score long"
    done, left = [], steps
    for n in range(len(EXPECT) + 1):
        now = left.select("a", "w", "lo", "hi", F.get("steps", F.lit(n)).alias("t"))
        wins = now.groupBy("a").agg(F.collect_list(F.struct("w", "hi", "t")).alias("wins"))
        count = wins.count()
        if not count:
            break
        blocks = -(-count // block)
        folder = scratch.path(f"{name}-block-{n}")
        (wins.join(anchors, "a").select("a", "label", "vec", "wins", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("blk"))
         .repartition(blocks, "blk").write.partitionBy("blk").parquet(folder))
        held = sorted(r["blk"] for r in spark.read.parquet(folder).select("blk").distinct().collect())
        pairs = scratch.write(rows.mapInArrow(_search(folder, held, k, same), schema), f"{name}-pairs-{n}")
        ranked = pairs.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)
        if n == len(EXPECT):
            done.append(ranked)
            break
        full = scratch.write(ranked.groupBy("a", "w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
                             .select("a", "w").union(now.where("t <= lo").select("a", "w")).distinct(), f"{name}-full-{n}")
        done.append(ranked.join(full, ["a", "w"], "left_semi"))
        left = scratch.write(left.join(full, ["a", "w"], "left_anti"), f"{name}-left-{n}")
    if not done:
        return spark.createDataFrame([], schema + ", rank int")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label",
         vec_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: the hard negatives of every positive of the rows for which
    ``is_anchor`` holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hardneg")
    real = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & real).select(
        F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id"), F.col(label_col).alias("label"),
        F.col(vec_col).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = scratch.write(rows.repartition(shuffle_partitions(spark)), "rows")
    anchors = scratch.write(rows.where("anchor").select(F.col("r").alias("a"), F.col("id").alias("anchor_id"),
                                                        "label", "vec"), "anchors")
    full = anchors.select("a", F.lit(0).alias("w"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi"))
    rows, own = rows.select("r", "id", "label", "vec"), anchors.select("a", "label", "vec")
    pos = scratch.write(best_in_windows(rows, own, full, positives, True, scratch, "pos").select(
        "a", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "pos")
    share = lambda n: F.col("positive_score").cast("decimal(20,0)") * n / 100
    windows = pos.where("positive_score >= 0").select(
        "a", "w", F.ceil(share(LOW_SHARE)).cast("long").alias("lo"),
        F.floor(share(HIGH_SHARE)).cast("long").alias("hi")).where("lo <= hi")
    neg = best_in_windows(rows, own, windows, negatives, False, scratch, "neg")
    return (neg.select("a", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(pos, ["a", "w"]).join(anchors.select("a", "anchor_id"), "a")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    "positive_score", "negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(vectors, F.col("vec_id") % 100 == 0)


SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS r, b.vec_id AS id, a.label = b.label AS same,
    list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (
  SELECT a, anchor_id, id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY a ORDER BY score DESC, id, r) AS w
  FROM s WHERE same QUALIFY w <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.a, p.w ORDER BY s.score DESC, s.id, s.r) AS INTEGER) AS rank,
  s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same
  AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""
