"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set is its distinct 5-word shingles.  Documents with equal sets
form a class, and only one of each class goes on.  Each class is posted under
every (coordinate, value) of its signature of ``COORDS`` minima.  Two sets at
similarity 0.75 agree in 36 of 48 coordinates on average; pairs agreeing in at
least ``MATCH`` = 21 are retained (a pair at exactly 0.75 falls short with a
probability below 1e-6) and confirmed on the full sets.

* Prefix: posting keys are ordered by how many classes share them.  Two classes
  that agree in MATCH keys share one outside the MATCH - 1 most frequent keys of
  either, so only the rarer rest is merged; keys with one class, and classes
  with fewer than MATCH shared keys, leave at once.
* Skip: in ``ROUNDS`` first merges every list is dealt by hash into hands of
  about ``HAND`` members, each joined to the smallest member of its hand (rows
  linear in the list), and each class confirms the ``TRY`` partners of other
  components it agrees with most.  The last merge compares every remaining
  pair: it skips lists that hold one component, pairs inside a component, pairs
  whose set sizes cannot reach the similarity and pairs that an earlier common
  key has.  Long lists are cut into blocks of ``BLOCK`` members and block pairs
  go to tasks of their own; a task holds one block pair's members and the pairs at
  one distance in it, however many agree.  No link between components is left
  out: every pair that shares a prefix key is in one component or is compared.
* Pairs of the last merge must also agree in a second signature of ``BINS``
  bytes, one for each part of the hash range that holds a shingle (at 0.75 on
  average in 0.75 of the bytes that either has; ``BIN_SLACK`` deviations below
  that, a probability under 1e-7, are let through), and then in their ``LOW``
  smallest shingle hashes: exactly for sets that these hold whole, else in
  ``LOW_MATCH`` of the LOW smallest of the union (192 on average at 0.75, a
  shortfall that far has a probability below 1e-6).

Components come from star contraction on the link table (large-star and
small-star steps, every step written to the checkpoint folder).

Defined results: a text without words (null, empty, blank) has an empty set and
links with nothing; a text of one to four words is one shingle; repeated rows
and rows that share a doc_id are one document (each row is returned, with the
same component); a null doc_id links with nothing, has a null component and is
kept; an empty table gives no rows; other columns are ignored by
``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatekit.llm.common import Scratch, arrow_batches, drop_ids, maybe_ids, ship_package, shuffled_joins, table, unique_rows

SHINGLE = 5
COORDS = 48
MATCH = 21
LEAST = 75               # percent
BLOCK = 4096
ROUNDS = 2
HAND = 8
TRY = 2
LOW = 256
LOW_MATCH = 158
BINS = 256
BIN_SLACK = 5.3
COMPARE = 2048           # pairs compared at a time
CHUNK_WORDS = 250_000    # words hashed together

_MULT = (np.random.default_rng(5).integers(0, 2**63, COORDS + 8, dtype=np.uint64)
         * np.uint64(2) + np.uint64(1))
_PAD = np.uint64(0xFFFFFFFF)      # above every kept hash
_XOR = np.random.default_rng(6).integers(0, 2**64, COORDS, dtype=np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes methods know
    ASCII only)."""
    return text.lower().split() if text else []


def shingle_set(text: bytes | None) -> set:
    w = words_of(text)
    if len(w) < SHINGLE:
        return {tuple(w)} if w else set()
    return set(zip(*[w[i:] for i in range(SHINGLE)]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bin_bytes(hashes: np.ndarray) -> np.ndarray:
    """A byte of the smallest of the sorted hashes in each of ``BINS`` equal parts
    of the hash range, 0 where there is none."""
    out = np.zeros(BINS, np.uint8)
    part = (hashes >> np.uint64(56)).astype(np.int64)
    least = np.flatnonzero(np.diff(part, prepend=-1))
    out[part[least]] = (hashes[least] >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
    return out


def signatures(texts: list[bytes | None]) -> tuple[list[int], list, list, np.ndarray]:
    """Set size, digest of the set, its bytes by hash range and smallest hashes,
    and minima (one row per text with words)."""
    words = [words_of(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    hashed = xxhash.xxh3_64_intdigest
    h = np.fromiter((hashed(x) for w in words for x in w), np.uint64, int(n.sum()))
    del words
    first = np.cumsum(n) - n
    s = np.zeros(len(h), np.uint64)
    for i in range(min(SHINGLE, len(h))):
        s[: len(h) - i] += h[i:] * _MULT[COORDS + i]
    valid = np.ones(len(h), bool)
    for d in np.flatnonzero((n > 0) & (n < SHINGLE)):     # the whole sequence as one
        own = h[first[d]:first[d] + n[d]]
        s[first[d]] = (np.append(own, np.uint64(n[d])) * _MULT[COORDS + SHINGLE - n[d]:COORDS + SHINGLE + 1]).sum()
    for i in range(1, SHINGLE):
        at = first + n - i
        valid[at[(n >= i) & (at > first)]] = False
    sh = _mix(s[valid])
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    start = np.cumsum(count) - count
    sizes, digests, bins = [], [], []
    for a, c in zip(start.tolist(), count.tolist()):
        own = np.unique(sh[a:a + c])
        sizes.append(len(own))
        digests.append(xxhash.xxh3_128_digest(own.tobytes()) if c else None)
        bins.append(bin_bytes(own).tobytes() + np.minimum(own[:LOW] >> np.uint64(32), _PAD - 1).astype("<u4").tobytes())
    have = start[count > 0]
    mins = np.empty((len(have), COORDS), np.int32)
    buf = np.empty_like(sh)
    for k in range(COORDS if len(have) else 0):
        np.bitwise_xor(sh, _XOR[k], out=buf)
        np.multiply(buf, _MULT[k], out=buf)
        mins[:, k] = (np.minimum.reduceat(buf, have) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return sizes, digests, bins, mins


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body = batch.column("body")
        size = pc.binary_length(body).fill_null(0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(size) // (6 * CHUNK_WORDS)
        for c in np.unique(cut):
            a, b = np.searchsorted(cut, [c, c + 1])
            part = batch.slice(a, b - a)
            sizes, same, bins, mins = signatures(part.column("body").to_pylist())
            ends = np.cumsum([0] + [COORDS * (x is not None) for x in same]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("h"), pa.array(sizes, pa.int64()),
                 pa.array(same, pa.binary()), pa.array(bins, pa.binary()),
                 pa.ListArray.from_arrays(ends, mins.ravel())],
                names=["doc_id", "h", "n_shingles", "same", "bins", "sig"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose full sets reach the similarity."""
    last, one = None, set()
    for batch in batches:
        keep = []
        for i, (a, ha) in enumerate(zip(batch.column("a").to_pylist(), batch.column("ha").to_pylist())):
            if (a, ha) != last:
                last, one = (a, ha), shingle_set(batch.column("ta")[i].as_py())
            two = shingle_set(batch.column("tb")[i].as_py())
            both = len(one & two)
            if 100 * both >= LEAST * (len(one) + len(two) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])


def bins_agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bytes (rows of BINS) allow the similarity."""
    both = ((a == b) & (a != 0)).sum(axis=1)
    either = ((a != 0) | (b != 0)).sum(axis=1)
    share = LEAST / 100
    return both >= share * either - BIN_SLACK * np.sqrt(share * (1 - share) * either)


def low_agree(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the smallest hashes (rows of LOW, padded) allow the similarity."""
    c = np.sort(np.concatenate((a, b), axis=1), axis=1)
    twice = np.zeros(c.shape, bool)
    twice[:, 1:] = (c[:, 1:] == c[:, :-1]) & (c[:, 1:] != np.uint32(_PAD))
    both = twice.sum(axis=1)
    seen = np.cumsum(~twice, axis=1, dtype=np.int16) <= LOW
    return np.where((na <= LOW) & (nb <= LOW), 100 * both >= LEAST * (na + nb - both),
                    (twice & seen).sum(axis=1) >= LOW_MATCH)


def _merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs between components of each posting list (rows sorted by list, then
    set size) that agree in at least MATCH coordinates and in their bytes; a pair
    is given by the first of its common prefix keys."""
    held: pa.Table | None = None

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        names = ("grp", "x", "y", "mine", "node", "h", "comp", "n", "mask")
        col = {c: t.column(c).to_numpy() for c in names}
        sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDS)
        bins = np.zeros((t.num_rows, BINS), np.uint8)
        low = np.full((t.num_rows, LOW), _PAD, np.uint32)
        for r, z in enumerate(t.column("bins")):
            bins[r] = np.frombuffer(z.as_buffer(), np.uint8, BINS)
            v = np.frombuffer(z.as_buffer(), "<u4", offset=BINS)
            low[r, :len(v)] = v
        here = col["grp"] >> 32
        mask = (col["mask"][:, None] >> np.arange(COORDS)) & 1 == 1
        rows = np.arange(t.num_rows)
        d = 1
        while len(rows):
            rows = rows[rows + d < t.num_rows]
            i, j = rows, rows + d
            on = (col["grp"][i] == col["grp"][j]) & (col["x"][i] == col["x"][j]) & \
                 (col["y"][i] == col["y"][j]) & (100 * col["n"][i] >= LEAST * col["n"][j])
            rows = rows[on]
            i, j = rows, rows + d
            go = (col["comp"][i] != col["comp"][j]) & \
                 ((col["x"][i] == col["y"][i]) | (col["mine"][i] != col["mine"][j]))
            i, j = i[go], j[go]
            d += 1
            for k in range(0, len(i), COMPARE):
                p, q = i[k:k + COMPARE], j[k:k + COMPARE]
                same = sig[p] == sig[q]
                hit = same.sum(axis=1) >= MATCH
                p, q, same = p[hit], q[hit], same[hit]
                hit = (same & mask[p] & mask[q]).argmax(axis=1) == here[p]
                p, q = p[hit], q[hit]
                hit = bins_agree(bins[p], bins[q])
                p, q = p[hit], q[hit]
                hit = low_agree(low[p], low[q], col["n"][p], col["n"][q])
                p, q = p[hit], q[hit]
                if len(p):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(col[c][z]) for c, z in (("node", p), ("h", p), ("node", q), ("h", q))],
                        names=["a", "ha", "b", "hb"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        g = [t.column(c).to_numpy() for c in ("grp", "x", "y")]
        open_ = np.logical_and.reduce([c == c[-1] for c in g]) if t.num_rows else np.zeros(0, bool)
        end = t.num_rows - int(open_[::-1].argmin() or len(open_)) if t.num_rows else 0
        held = t.slice(end).combine_chunks()
        if end:
            yield from pairs(t.slice(0, end))
    if held is not None and held.num_rows:
        yield from pairs(held)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for every node of the edge table (a, b); comp is the
    smallest node reachable.  Alternates large-star and small-star steps until
    the edges no longer change; nothing leaves the executors but two numbers."""
    with shuffled_joins(scratch.spark):
        return _components(edges, scratch, name)


def _components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = scratch.write(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen, step = mark(e), 0
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        nxt = scratch.write(nxt, f"{name}-{step}")
        now = mark(nxt)
        scratch.drop(f"{name}-{step - 1}")
        e = nxt
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, ha, b, hb) whose texts reach the similarity, as (a, b)."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    texts = maybe_ids(docs, ids, "doc_id")
    ta = texts.select(F.col("doc_id").alias("a"), F.col("h").alias("ha"), F.col("body").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"), F.col("body").alias("tb"))
    both = pairs.join(tb, ["b", "hb"]).join(ta, ["a", "ha"])
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "ha", "ta", "b", "tb").mapInArrow(_confirm, f"a {kind}, b {kind}")


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose members are in different components."""
    for c in ("a", "b"):
        pairs = pairs.join(comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")), c, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ship_package(spark)
    with arrow_batches(spark):         # every step that runs Python is written in here
        return _near_duplicates(docs, Scratch(spark, "neardup"), id_col, text_col)


def _near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"),
                      F.col(text_col).cast("binary").alias("body"))
    rows = scratch.write(src.mapInArrow(
        _sign, f"doc_id {kind}, h long, n_shingles long, same binary, bins binary, sig array<int>"), "rows")
    own = rows.where("same IS NOT NULL AND doc_id IS NOT NULL").drop("bins")
    classes = scratch.write(own.groupBy("same").agg(
        F.min(F.struct("doc_id", "h")).alias("rep"), F.first("n_shingles").alias("n"),
        F.first("sig").alias("sig"))
        .select("same", F.col("rep.doc_id").alias("node"), F.col("rep.h").alias("h"), "n", "sig"),
        "classes")

    # postings of the prefix: all but the MATCH - 1 most frequent shared keys
    posts = classes.select("node", F.posexplode("sig").alias("pos", "val")).select(
        "node", (F.shiftleft(F.col("pos").cast("long"), 32)
                 + F.col("val").cast("long") + F.lit(1 << 31)).alias("grp"))
    shared = posts.groupBy("grp").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    rare = Window.partitionBy("node").orderBy(F.col("freq").desc(), F.col("grp").desc())
    prefix = scratch.write(posts.join(shared, "grp").withColumn("at", F.row_number().over(rare))
                           .where(F.col("at") >= MATCH).select("grp", "node", "freq"), "prefix")

    # first merges: hands of about HAND members, joined to their smallest one
    side = lambda p: classes.select(F.col("node").alias(p), F.col("h").alias(f"h{p}"),
                                    F.col("n").alias(f"n{p}"), F.col("sig").alias(f"s{p}"))
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    comp = None
    for r in range(1, ROUNDS + 1):
        dealt = prefix.select("grp", "node", F.pmod(F.xxhash64("node", "grp", F.lit(r)), F.ceil(
            F.col("freq") / HAND)).alias("hand"))
        least = dealt.groupBy("grp", "hand").agg(F.min("node").alias("a"))
        pairs = dealt.join(least, ["grp", "hand"]).where("node <> a").select(
            "a", F.col("node").alias("b")).distinct()
        if comp is not None:
            pairs = _between(pairs, comp)
        pairs = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("agree", agree).where(
            (F.col("agree") >= MATCH) & (F.lit(100) * F.least("na", "nb") >= LEAST * F.greatest("na", "nb")))
        best = Window.partitionBy("b").orderBy(F.col("agree").desc(), "a", "ha")
        pairs = scratch.write(pairs.withColumn("at", F.row_number().over(best))
                              .where(F.col("at") <= TRY).select("a", "ha", "b", "hb"), f"tried-{r}")
        found = scratch.write(_confirmed(pairs, src), f"links-{r}")
        if comp is not None:           # earlier links as the stars they have become
            found = found.unionByName(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        comp = scratch.write(components(found, scratch, f"c{r}"), f"comp-{r}")

    # last merge: pairs between components only
    lists = prefix.select("grp", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = lists.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                     F.count(F.lit(1)).alias("len")).where("lo < hi")
    nb = F.ceil(F.col("len") / BLOCK).cast("int")
    cells = (lists.join(mixed.select("grp", nb.alias("nb")), "grp")
             .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))))
    cells = scratch.write(cells, "cells")
    masks = prefix.groupBy(F.col("node").alias("m")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(shiftright(grp, 32) AS INT))")).alias("mask"))
    bins = maybe_ids(rows.select(F.col("doc_id").alias("node"), "h", "bins"), cells, "node").distinct()
    facts = classes.select("node", "h", "n", "sig").join(bins, ["node", "h"]).join(masks, F.col("node") == F.col("m"))
    cells = (cells.join(facts.drop("m"), "node")
             .select("grp", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"),
                     "mine", "node", "h", "comp", "n", "mask", "sig", "bins"))
    cells = cells.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "n", "node")
    cross = cells.mapInArrow(_merge_lists, f"a {kind}, ha long, b {kind}, hb long").distinct()
    cross = scratch.write(cross, "cross")
    more = scratch.write(_confirmed(cross, src), "links-last")

    # rows that share a doc_id are one document
    member = own.join(classes.select("same", "node"), "same").select("doc_id", "node").distinct()
    again = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    again = member.join(again, "doc_id").select("a", F.col("node").alias("b"))
    over = more.unionByName(again)
    for c in ("a", "b"):
        over = over.join(comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")), c, "left")
    over = over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    comp2 = scratch.write(components(over, scratch, "cl"), "comp-last")
    scratch.drop("prefix", "cells", "cross", "links-last", *[f"{x}-{r}" for r in range(1, ROUNDS + 1)
                                                            for x in ("tried", "links")])

    final = (classes.select("same", "node").join(comp, "node", "left")
             .withColumn("node", F.coalesce("comp", "node")).drop("comp")
             .join(comp2, "node", "left").select("same", F.coalesce("comp", "node").alias("comp")))
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return rows.select("doc_id", "n_shingles", "same").join(final, "same", "left").select(
        "doc_id", "n_shingles", cid.alias("component_id"),
        F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component; of rows that share a doc_id, one row."""
    labels = Scratch(docs.sparkSession, "dedup").write(near_duplicates(docs), "labels")
    out = drop_ids(docs, labels.where(~F.col("kept")).select("doc_id"), "doc_id")
    again = labels.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    return unique_rows(out, again, "doc_id")


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i:i + least(5, len(w)) - 1] AS x
  FROM w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 75 * (na.n + nb.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""
