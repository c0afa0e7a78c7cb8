"""Mixing sources to target weights.

Every document gets a hash-random key.  Rows are range-sorted by key within
their source and a distributed running sum of word counts is taken; a source
gives whole epochs of itself and then the documents up to its exact budget.  The
document on the cut gives its first words up to the budget: the start of its text
as it stands, to the end of the last of them.  Rows are taken each
on their own by ``mix``; for ``mixed``, rows that share doc_id and text are one
document with the copies of all of them.

Targets: sources in code-point order (null last) weigh ``WEIGHTS``, repeated;
all together get ``SHARE`` of all words; a target stops at ``MOST`` times its
source, and the excess goes to the others by weight until none is above.

Defined results: null text has no words and is never taken; a null source is a
source of its own, last; a null doc_id takes part like any other; repeated rows
are taken each on its own; an empty table gives no rows; other columns are
ignored by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatekit.llm.common import Scratch, null_safe, running, table, unique_rows, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def random_key(id_col: str = "doc_id", seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
                 .cast("binary"))


def fill_level(sources: DataFrame, budget: float) -> float:
    """Words per unit of weight at which the capped targets add up to
    ``budget``: each pass caps the sources below the level and shares out the
    rest; the passes end because the capped set only grows."""
    level, capped = 0.0, -1
    below = F.lit(False)
    while True:
        r = sources.agg(
            F.sum(F.when(below, F.lit(MOST) * F.col("source_size")).otherwise(0)).alias("got"),
            F.sum(F.when(~below, F.col("weight")).otherwise(0)).alias("w"),
            F.sum(below.cast("int")).alias("n")).first()
        if r["n"] is None or r["n"] == capped or not r["w"]:
            return level
        capped, level = r["n"], (budget - r["got"]) / r["w"]
        below = F.lit(level) * F.col("weight") > MOST * F.col("source_size")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, scratch: Scratch | None = None
            ) -> DataFrame:
    """One row per source: source, source_size, target."""
    scratch = scratch or Scratch(sized.sparkSession, "mix")
    per = scratch.write(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "per")
    order = running(per, [], [F.col("source").asc_nulls_last()], {"pos": F.lit(1)}, scratch, "order")
    arr = F.array(*[F.lit(w) for w in weights])
    src = scratch.write(order.withColumn(
        "weight", F.get(arr, ((F.col("pos") - 1) % len(weights)).cast("int"))), "sources")
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level = fill_level(src, share * total)
    return src.select("source", "source_size", F.least(
        F.lit(level) * F.col("weight"), (F.lit(MOST) * F.col("source_size")).cast("double"))
        .alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: str = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken,
    and text_crc32 (which tells rows of one doc_id apart)."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.write(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"), random_key(id_col, seed).alias("key"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32")), "sized")
    goal = scratch.write(targets(sized, weights, share, scratch), "goal")
    cum = running(sized, ["source"], ["key", "doc_id", "text_crc32"], {"cum": F.col("size")},
                  scratch, "ranged")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0,
                    F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - (F.col("cum") - F.col("size"))))
    return null_safe(cum, goal, "source").select(
        "doc_id", "size", "source_size", "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"), "source", "text_crc32")


def mixed(docs: DataFrame, **args) -> DataFrame:
    """The mix itself: whole copies of each taken document, and for the
    document on a source's cut the words within the budget; columns of
    ``docs``, n_chars following the text."""
    cols = docs.columns
    key = lambda crc: F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                                  F.coalesce(crc.cast("string"), F.lit("null")))
    rest = (F.col("taken") % F.col("size")).cast("int")
    take = mix(docs, **args).where("taken > 0").groupBy(key(F.col("text_crc32")).alias("_k")).agg(
        F.sum(F.floor(F.col("taken") / F.col("size"))).cast("int").alias("_whole"),
        F.collect_list(F.when(rest > 0, rest)).alias("_rest"), F.count(F.lit(1)).alias("_n"))
    take = Scratch(docs.sparkSession, "mixed").write(take, "take")
    # the row travels whole, beside its key
    rows = docs.select(key(F.crc32(F.col("text").cast("binary"))).alias("_k"),
                       F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))
    rows = unique_rows(rows, take.where("_n > 1"), "_k").join(take, "_k")
    copies = F.concat(F.array_repeat(F.lit(0), F.col("_whole")), F.col("_rest"))
    rows = rows.withColumn("_cut", F.explode(copies))
    words = F.split(F.col("_row.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")    # each with the space before it
    start = F.array_join(F.slice(words, 1, F.greatest(F.col("_cut"), F.lit(1))), "")
    own = {c: F.col("_row").getField(c) for c in cols}
    own["text"] = F.when(F.col("_cut") > 0, start).otherwise(own["text"])
    if "n_chars" in cols:
        own["n_chars"] = F.when(F.col("_cut") > 0, F.length(start)).otherwise(
            own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in own.items()])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2 * source_size / CAST(weight AS DOUBLE) AS ratio,
         sum(2 * source_size) OVER o - 2 * source_size AS got_before,
         (SELECT sum(weight) FROM src) - (sum(weight) OVER o - weight) AS w_left,
         (SELECT 1.5 * sum(source_size) FROM src) AS budget
  FROM src WINDOW o AS (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), source ROWS UNBOUNDED PRECEDING)),
lvl AS (
  SELECT (budget - CAST(got_before AS DOUBLE)) / CAST(w_left AS DOUBLE) AS level
  FROM ranked WHERE (budget - CAST(got_before AS DOUBLE)) / CAST(w_left AS DOUBLE) <= ratio
  ORDER BY ratio, source LIMIT 1),
goal AS (
  SELECT source, source_size, least((SELECT level FROM lvl) * weight, CAST(2 * source_size AS DOUBLE)) AS target FROM src),
cum AS (
  SELECT s.*, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM sized s),
j AS (
  SELECT c.doc_id, c.size, g.source_size, g.target, c.cum,
         CAST(floor(g.target + 0.5) AS BIGINT) AS b
  FROM cum c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (b // source_size) * size
         + least(size, greatest(0, b - (b // source_size) * source_size - (cum - size))) ELSE 0 END AS BIGINT) AS taken
FROM j
"""
