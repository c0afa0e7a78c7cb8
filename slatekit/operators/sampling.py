"""Deterministic negative sampling and shuffles.

Randomness is a hash of a seed and the keys (md5), so every result is
reproducible, independent of partitioning, and expressible in SQL.

R1/R2 draw without replacement: a user's negatives are put in hash order once
(index j in 0..n-1, a skew-safe ordered scan), and every positive has a
permutation of its own over 0..n-1, of which it takes the first ``min(9, n)``
values, so all sets of 9 are equally likely and nothing pairs positives with
negatives.  Users with fewer than 9 negatives fill the rest from the split's pool
(all negatives of the split, in hash order, index g): the first 9 values of
another permutation, over the pool, without the user's own items, which leaves at
least the 9 - n needed.  Every join is an equi-join on (split, user, j) or
(split, g), keys that a hot user cannot concentrate.

The permutation is a keyed Feistel network over a square just above n, walked
along its cycle until the value is below n.  ``method="rotate"`` takes
consecutive indices from a hash offset instead: only n different windows, but one
hash a positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatekit.config import CANDIDATE_NEG_NUM, DEFAULT_SEED
from slatekit.functions.exprs import col, hash60, hash60_text, let
from slatekit.plans.indexing import dense_index

KEYS = ["split", "user_id"]
FEISTEL_ROUNDS = 8
# Cycle steps of one draw.  A walk leaves the square's rim (fewer than 2 sqrt(n) + 1
# values) after at most that many steps, which the bound covers up to n = 361;
# beyond, a longer walk has a probability below 1e-30 and is an error.
MAX_WALK = 40


def _positives(log: DataFrame) -> DataFrame:
    return log.where(F.col("label") != 0).select("split", "user_id",
                                                 F.col("imp_id").alias("list_id"))


def _negatives(log: DataFrame, seed: str) -> DataFrame:
    return log.where(F.col("label") == 0).select(
        "split", "user_id", F.col("imp_id").alias("neg_id"),
        hash60("imp_id", seed=seed).alias("h"))


def _key_text(*keys: str | Column, seed: str) -> Column:
    """What the hashes of a permutation's rounds begin with, as ``hash60`` joins it."""
    return F.concat_ws("|", F.lit(seed), *[col(k).cast("string") for k in keys])


def _round_hash(text: Column, k: Column, r: Column, a: Column) -> Column:
    """``hash60`` of the keys, the round and ``r``, modulo ``a``."""
    return hash60_text(F.concat(text, F.lit("|"), k.cast("string"), F.lit("|"), r.cast("string"))) % a


def _walked(t: Column, z: Column, table: Column | None) -> Column:
    """Value ``t`` of the permutation of ``z`` (n, a, text); ``table`` holds the hash of
    (round, r) at round * a + r, or is null."""
    n, a = z["n"], z["a"]

    def network(v: Column) -> Column:
        def step(v: Column, k: Column) -> Column:
            r = v % a
            h = _round_hash(z["text"], k, r, a)
            if table is not None:
                h = F.when(table.isNotNull(), F.get(table, (k * a + r).cast("int"))).otherwise(h)
            return r * a + (F.floor(v / a).cast("bigint") + h) % a

        return F.aggregate(F.sequence(F.lit(0), F.lit(FEISTEL_ROUNDS - 1)), v, step)

    steps = F.sequence(F.lit(1), F.least(F.lit(MAX_WALK), a * a - n + 1).cast("int"))
    end = F.aggregate(steps, network(t.cast("bigint")), lambda v, _: F.when(v < n, v).otherwise(network(v)))
    return let(end, lambda v: F.when(v < n, v).otherwise(
        F.raise_error(F.lit("the cycle of a permutation is too long")).cast("bigint")))


def _square(n: Column, text: Column) -> Column:
    n = n.cast("bigint")
    return F.struct(n.alias("n"), F.ceil(F.sqrt(n)).cast("bigint").alias("a"), text.alias("text"))


def permuted(t: Column, n: Column, *keys: str | Column, seed: str = DEFAULT_SEED) -> Column:
    """Value ``t`` of the permutation of 0..n-1 that belongs to ``keys``.

    Round r of the network takes (l, r) to (r, l + hash(keys, round, r) mod a) over
    an a x a square, a = ceil(sqrt(n)); a value of n or more is permuted again.  A
    pair is held as l * a + r."""
    return let(_square(n, _key_text(*keys, seed=seed)), lambda z: _walked(t, z, None))


def permuted_places(places: Column, n: Column, *keys: str | Column, most: int,
                    seed: str = DEFAULT_SEED) -> Column:
    """``permuted`` of every place of an array of at most ``most``.  Where the square is
    no wider than that, the rounds have fewer different hashes than the places take:
    those are made once."""
    def drawn(z: Column) -> Column:
        a = z["a"]
        def hashes(k: int) -> Column:
            return let(F.concat(z["text"], F.lit(f"|{k}|")), lambda text: F.transform(
                F.sequence(F.lit(0).cast("bigint"), a - 1), lambda r: hash60_text(F.concat(text, r.cast("string"))) % a))

        cells = F.concat(*[hashes(k) for k in range(FEISTEL_ROUNDS)])
        return let(F.when(a <= most, cells), lambda table: F.transform(places, lambda t: _walked(t, z, table)))

    return let(_square(n, _key_text(*keys, seed=seed)), drawn)


def _drawn(rows: DataFrame, n_col: str, kind: str, want: int, method: str, seed: str,
           t_col: str, out_col: str) -> DataFrame:
    """``min(want, n)`` rows for every row, each with another index of 0..n-1; a
    row that takes all of them takes them in order.

    Rows are short and a draw is long: they are dealt over the session's partitions,
    whatever few tasks their bytes would make and whichever user holds most of them."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "split", "list_id")
    n = F.col(n_col)
    offset = () if kind == "own" else (F.lit(kind),)
    places = F.sequence(F.lit(0), F.least(n, F.lit(want)).cast("int") - 1)
    if method == "rotate":
        first = hash60("list_id", *offset, seed=seed) % n
        drawn = let(first, lambda o: F.transform(places, lambda t: (o + t) % n))
    elif method == "exact":
        drawn = F.when(n <= want, F.transform(places, lambda t: t.cast("bigint"))).otherwise(
            permuted_places(places, n, "list_id", F.lit(kind), most=want, seed=seed))
    else:
        raise ValueError(f"unknown sampling method {method!r}")
    # one array a row: the indices are computed before they are exploded, once
    return rows.select("*", F.posexplode(drawn).alias(t_col, out_col))


def neg_sample(log: DataFrame, n_neg: int = CANDIDATE_NEG_NUM, seed: str = DEFAULT_SEED,
               method: str = "exact") -> DataFrame:
    """R1 + R2 (+J2): ``(split, list_id, user_id, neg_id, src, t)`` where
    ``src`` is 'own' or 'pool' and ``t`` the pick order.  ``method`` is
    'exact' (uniform sets without replacement) or 'rotate'."""
    pos = _positives(log)
    neg = _negatives(log, seed)
    own_idx = dense_index(neg, ["h", "neg_id"], KEYS, "j")
    n_u = neg.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))

    p = pos.join(n_u, KEYS, "left").fillna(0, ["n"])
    own = (_drawn(p.where(F.col("n") > 0), "n", "own", n_neg, method, seed, "t", "j")
           .join(own_idx.select(*KEYS, "j", "neg_id"), [*KEYS, "j"])
           .select("split", "list_id", "user_id", "neg_id", F.lit("own").alias("src"), "t"))

    # pool fill for users with fewer than n_neg negatives of their own
    short = p.where(F.col("n") < n_neg)
    pool = dense_index(neg, ["h", "neg_id"], ["split"], "g")
    g_n = neg.groupBy("split").agg(F.count(F.lit(1)).alias("pool_n"))
    want = _drawn(short.join(F.broadcast(g_n), "split"),  # one row per split
                  "pool_n", "pool", n_neg, method, seed, "u", "g")
    cand = (want.join(pool.select("split", "g", "neg_id", F.col("user_id").alias("owner")),
                      ["split", "g"])
            .where(F.col("owner") != F.col("user_id")))
    r = F.row_number().over(Window.partitionBy("split", "list_id").orderBy("u"))  # <= 9 rows per list
    fill = (cand.withColumn("r", r).where(F.col("r") <= n_neg - F.col("n"))
            .select("split", "list_id", "user_id", "neg_id", F.lit("pool").alias("src"),
                    (F.col("n") + F.col("r") - 1).alias("t")))
    return own.unionByName(fill)


def candidates(log: DataFrame, n_neg: int = CANDIDATE_NEG_NUM, seed: str = DEFAULT_SEED,
               method: str = "exact") -> DataFrame:
    """U2 + R3: per list (one per positive) the positive (label 1) and its
    sampled negatives (label 0), shuffled by hash into slots 0..n.  A list is
    ``(split, list_id)``: ids may be numbered anew in every split."""
    pos = _positives(log).select("split", "list_id", "user_id",
                                 F.col("list_id").alias("imp_id"), F.lit(1).alias("label"))
    negs = neg_sample(log, n_neg, seed, method).select("split", "list_id", "user_id",
                                               F.col("neg_id").alias("imp_id"),
                                               F.lit(0).alias("label"))
    allc = pos.unionByName(negs)
    w = Window.partitionBy("split", "list_id").orderBy(hash60("list_id", "imp_id", seed=seed), "imp_id")
    return allc.withColumn("slot", (F.row_number().over(w) - 1).cast("bigint"))


def shuffle_lists(lists: DataFrame, seed: str = DEFAULT_SEED,
                  out_col: str = "list_order") -> DataFrame:
    """Position of every list within its split in hash order (exact,
    no single-partition sort)."""
    h = hash60("list_id", seed=seed)
    return dense_index(lists.withColumn("_h", h), ["_h", "list_id"], ["split"],
                       out_col).drop("_h")
