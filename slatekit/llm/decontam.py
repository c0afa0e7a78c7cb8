"""Benchmark decontamination with an FM-index per shard of the corpus.

Each Arrow batch of documents is a shard.  Its words become symbols of the
benchmark's vocabulary; words that no benchmark item holds end a run, and runs
shorter than the shortest window cannot hold an occurrence and are not indexed.
All windows are searched backward through the wavelet ranks, occurrences are
located by sampled suffix positions, and their spans are merged per document.

The benchmark is written in blocks of about ``BLOCK_WORDS`` words to the shared
folder (``spark.checkpoint.dir``), where tasks read them: nothing of it passes
through the driver.  A pass over the documents takes up to ``PASS`` blocks, whose
windows a Python worker keeps; a larger benchmark takes more passes, each of which
writes the spans and items it finds, and these are united by document at the end.

Defined results: null or empty text has no words and is clean; an item without
words has no window; items of fewer than ``WINDOW`` words are one window;
repeated items count each by its id (null ids are left out of the list);
repeated rows are judged alike; a null doc_id stays null; empty tables give no
rows or no hits; other columns are ignored by ``scan`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatekit.llm.common import Scratch, drop_ids, free_name, row_key, ship_package, table
from slatekit.llm.fmindex import FMIndex
from slatekit.llm.warc import file_system

WINDOW = 10
BLOCK_WORDS = 500_000
PASS = 2                      # blocks of one pass
SHARD_WORDS = 1_500_000       # indexed words of one FM-index, about
# Bytes to words: A-Z fall to a-z, all ASCII but letters and digits separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32
             for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Windows:
    """The windows of one benchmark block as symbol rows, by length."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.symbols: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        self.ids = sorted({i for i, _ in items if i is not None})
        at = {x: n for n, x in enumerate(self.ids)}
        for item, text in items:
            w = [self.symbols.setdefault(x, len(self.symbols) + 1) for x in words_of(text)]
            size = min(window, len(w))
            for k in range(len(w) - size + 1 if size else 0):
                rows.setdefault(tuple(w[k:k + size]), set()).update(
                    [at[item]] if item is not None else [])
        self.by_size = {}
        for size in sorted({len(r) for r in rows}):
            own = [r for r in rows if len(r) == size]
            starts = np.cumsum([0] + [len(rows[r]) for r in own])
            flat = np.array([i for r in own for i in sorted(rows[r])], np.int64)
            self.by_size[size] = (np.array(own, np.int64), starts, flat)
        self.shortest = min(self.by_size, default=0)


class Shard:
    """Documents whose runs are gathered, then searched together."""

    def __init__(self, win: Windows):
        self.win, self.parts, self.n = win, [], 0
        self.doc, self.begin, self.length = [], [], []

    def add(self, doc: int, syms: np.ndarray) -> None:
        gaps = np.concatenate(([-1], np.flatnonzero(syms == 0), [len(syms)]))
        for g in np.flatnonzero(np.diff(gaps) > self.win.shortest):
            a, b = gaps[g] + 1, gaps[g + 1]
            self.parts += [syms[a:b], np.zeros(1, syms.dtype)]
            self.doc.append(doc)
            self.begin.append(a)
            self.length.append(b - a + 1)
            self.n += b - a + 1

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, first word, length) of each occurrence; (doc, item) pairs."""
        none = np.empty(0, np.int64)
        if not self.parts:
            return none, none, none, none, none
        index = FMIndex(np.concatenate(self.parts), len(self.win.symbols))
        start = np.concatenate(([0], np.cumsum(self.length)))
        doc, begin = np.array(self.doc), np.array(self.begin)
        docs, firsts, sizes, item_doc, item = [none], [none], [none], [none], [none]
        for size, (rows, offs, flat) in self.win.by_size.items():
            lo, hi = index.search(rows)
            which = np.repeat(np.arange(len(rows)), hi - lo)
            ranks = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) \
                + lo[which]
            pos = index.locate(ranks)
            run = np.searchsorted(start, pos, "right") - 1
            docs.append(doc[run])
            firsts.append(begin[run] + pos - start[run])
            sizes.append(np.full(len(pos), size))
            pairs = np.unique(doc[run] * len(rows) + which)
            d, w = pairs // len(rows), pairs % len(rows)
            n = offs[w + 1] - offs[w]
            item_doc.append(np.repeat(d, n))
            item.append(flat[np.repeat(offs[w], n) + np.arange(n.sum())
                             - np.repeat(np.cumsum(n) - n, n)])
        return tuple(np.concatenate(x) for x in (docs, firsts, sizes, item_doc, item))


def merged(first: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Union of the spans [first, first + size)."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate((first + size)[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    return list(zip(a[new].tolist(), b[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))].tolist()))


@lru_cache(maxsize=PASS)
def _block(folder: str, number: int, window: int) -> Windows:
    fs, path = file_system(f"{folder}/blk={number}")
    t = pq.read_table(path, filesystem=fs, partitioning=None)
    return Windows(list(zip(t.column("id").to_pylist(), t.column("body").to_pylist())), window)


def _search(shard: Shard, spans: list, items: list) -> None:
    """Adds a shard's merged spans and item ids to the rows'."""
    doc, first, size, item_doc, item = shard.search()
    order = np.argsort(doc, kind="stable")
    doc, first, size = doc[order], first[order], size[order]
    for d, a, b in _pieces(doc):
        old = spans[d] or []
        f = np.concatenate((first[a:b], [x["a"] for x in old])).astype(np.int64)
        z = np.concatenate((size[a:b], [x["b"] - x["a"] for x in old])).astype(np.int64)
        spans[d] = [{"a": x, "b": y} for x, y in merged(f, z)]
    order = np.argsort(item_doc, kind="stable")
    item_doc, item = item_doc[order], item[order]
    for d, a, b in _pieces(item_doc):
        items[d] = sorted({*items[d], *(shard.win.ids[i] for i in item[a:b].tolist())})


def _mark(folder: str, blocks: list[int], window: int):
    """mapInArrow body: the spans and item ids of the blocks for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wins = [_block(folder, k, window) for k in blocks]
        for batch in batches:
            spans: list = [[] for _ in range(batch.num_rows)]
            items: list = [[] for _ in range(batch.num_rows)]
            counts = np.zeros(batch.num_rows, np.int64)
            shards = [Shard(win) for win in wins]
            for d, text in enumerate(batch.column("body")):
                w = words_of(text.as_py())
                counts[d] = len(w)
                for k, win in enumerate(wins):
                    if win.shortest and len(w) >= win.shortest:
                        get = win.symbols.get
                        shards[k].add(d, np.fromiter((get(x, 0) for x in w), np.int32, len(w)))
                    if shards[k].n >= SHARD_WORDS:
                        _search(shards[k], spans, items)
                        shards[k] = Shard(win)
            for shard in shards:
                _search(shard, spans, items)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts),
                 pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                 pa.array(items, pa.list_(pa.string()))],
                names=[batch.schema.names[0], "n_words", "spans", "items"])
    return run


def _pieces(keys: np.ndarray):
    """(key, start, end) of each run of equal values."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
        if b > a:
            yield int(keys[a]), a, b


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (word spans [a, b)
    to remove, merged, in order) and items (ids found, sorted as strings)."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "decontam")
    bench = benchmark.select(F.col("item_id").cast("string").alias("id"),
                             F.col("text").cast("binary").alias("body"))
    n_bytes = bench.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // (6 * block_words)))
    folder = scratch.path("blocks")
    blk = F.pmod(F.xxhash64("id", "body"), F.lit(n_blocks)).cast("int")
    bench.withColumn("blk", blk).repartition(n_blocks, "blk").write.partitionBy("blk").parquet(folder)
    held = sorted(r["blk"] for r in spark.read.schema("blk int").parquet(folder).distinct().collect())
    passes = [held[k:k + PASS] for k in range(0, len(held), PASS)] or [[]]
    found = "n_words long, spans array<struct<a:long,b:long>>, items array<string>"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    if len(passes) == 1:
        kind = docs.schema[id_col].dataType.simpleString()
        return rows.mapInArrow(_mark(folder, passes[0], window), f"doc_id {kind}, {found}")
    # rows are numbered once, so that all passes mean the same ones
    rows = scratch.write(rows.withColumn("n", F.monotonically_increasing_id()), "rows")
    hits = None
    for k, blocks in enumerate(passes):
        out = scratch.write(rows.select("n", "body").mapInArrow(_mark(folder, blocks, window), f"n long, {found}"),
                            f"pass-{k}")
        hits = out if hits is None else hits.unionByName(out)
    per = hits.groupBy("n").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select("n", "doc_id").join(per, "n").select("doc_id", "n_words", united("spans").alias("spans"), "items")


def united(spans: str) -> Column:
    """The union of spans as merged spans in order: a span begins where none
    before it reaches, and ends with the last that reaches the next."""
    s = F.array_sort(spans)
    far = F.aggregate(s, F.array().cast("array<long>"), lambda acc, x: F.concat(
        acc, F.array(F.greatest(x["b"], F.coalesce(F.get(acc, F.size(acc) - 1), x["b"])))))
    both = F.transform(F.array(F.struct(s.alias("s"), far.alias("far"))), lambda z: F.zip_with(
        F.filter(F.transform(z["s"], lambda x, i: F.when((i == 0) | (x["a"] > F.get(z["far"], i - 1)), x["a"])),
                 lambda a: a.isNotNull()),
        F.filter(F.transform(z["far"], lambda b, i: F.when(
            (i == F.size(z["far"]) - 1) | (F.get(z["s"], i + 1)["a"] > b), b)), lambda b: b.isNotNull()),
        lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return F.get(both, F.lit(0))


def digest_columns(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any hit word."""
    k = free_name(docs, "_k")
    keyed = docs.withColumn(k, row_key("doc_id", "text"))
    hit = scan(keyed, benchmark, id_col=k).where(F.size("spans") > 0).select(F.col("doc_id").alias(k))
    hit = Scratch(docs.sparkSession, "contaminated").write(hit, "ids")
    return drop_ids(keyed, hit, k).drop(k)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return digest_columns(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS sz, w[i:i + least(10, len(w)) - 1] AS x
  FROM b, unnest(generate_series(1, greatest(len(w) - least(10, len(w)) + 1, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT sz FROM win),
pos AS (
  SELECT doc_id, i, sz, w[i:i + sz - 1] AS x
  FROM d, sizes, unnest(generate_series(1, len(w) - sz + 1)) AS t(i) WHERE len(w) >= sz),
occ AS (SELECT p.doc_id, p.i, p.sz, win.item_id FROM pos p JOIN win ON p.sz = win.sz AND p.x = win.x),
hit AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, sz FROM occ) q, unnest(generate_series(0, sz - 1)) AS t(o) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
