"""Document fingerprints by a homomorphic multiset hash.

A document is the multiset of its paragraphs (lines with a character).  Each
paragraph is hashed to a wide vector: ``LANES`` identity lanes, of which its own
hash fills ``SPREAD``, and ``COUNTS`` count lanes.  For these the paragraph is cut
into units where its bytes say so (one in ``UNIT`` bytes, nowhere else than
inside the paragraph), and each unit adds +1 or -1 to one lane of each of
``SPREAD`` blocks.  A document's fingerprint is the sum of its vectors modulo
2**32 per lane.  It does not depend on the order of the paragraphs, it follows
insertion and deletion by adding and subtracting (``combine``, ``remove``), and
the fingerprint of a union is the sum of the fingerprints.  The count lanes keep
squared norms on average, at every length, so the norm of a difference against
the norms of both tells how much two documents have in common (``likeness``).

``successor_pairs`` gives every document its successor in doc_id order: ids are
cut into ranges, each range is one sorted run, and the first document of the next
range is sent along (the first of all to the last range).  Texts are shuffled
once, compressed.

Defined results: null and empty texts have no paragraph and a zero vector; two
zero vectors are alike (1.0), a zero vector and another are not (0.0); null doc_ids come first; rows that share a doc_id
follow each other by a digest of their texts; a single document is its own successor; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatekit.llm.common import ship_package, shuffle_partitions, table

LANES = 64
SPREAD = 4          # identity lanes one paragraph fills, blocks of count lanes
COUNTS = 512        # the error of a squared norm is about sqrt(2 / COUNTS) of it
UNIT = 16           # bytes of a unit on average, a power of two
CHUNK = 1 << 20     # bytes hashed together
ROWS = 256          # documents hashed together
RANGES_EACH = 2     # id ranges per shuffle partition


def paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p]


_BYTE = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), "<u8")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def units(paras: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph number, 64-bit hash) of each unit.  A unit ends after four
    bytes of one paragraph whose hash is 0 modulo ``UNIT``, and with the
    paragraph; no unit is a line end alone."""
    size = np.array([len(p) + 1 for p in paras], np.int64)
    arr = np.frombuffer(b"\n".join(paras) + b"\n", np.uint8)
    first = np.cumsum(size) - size
    w = arr.astype(np.uint32)
    code = (w[:-3] << np.uint32(24) | w[1:-2] << np.uint32(16) | w[2:-1] << np.uint32(8) | w[3:])
    end = np.zeros(len(arr), bool)
    end[3:] = (code * np.uint32(0x9E3779B1)) >> np.uint32(16) & np.uint32(UNIT - 1) == 0
    for k in range(3):
        at = first + k
        end[at[at < len(arr)]] = False
    end[:-1] &= arr[1:] != 10
    end[first + size - 1] = True
    last = np.flatnonzero(end)
    start = np.concatenate(([0], last[:-1] + 1))
    length = last - start + 1
    within = np.arange(len(arr)) - np.repeat(start, length)
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(length.max() - 1, _STEP))), dtype=np.uint64)
    h = np.add.reduceat(_BYTE[arr] * power[within], start)
    for _ in range(2):
        h = (h ^ h >> np.uint64(33)) * _MIX
    return np.repeat(np.arange(len(paras)), np.diff(np.searchsorted(start, [*first, len(arr)]))), h ^ h >> np.uint64(33)


def vectors(lists: list[list[str]]) -> np.ndarray:
    """One fingerprint (row of uint32 lanes: identity, then counts) per list of
    paragraphs."""
    out = np.zeros((len(lists), LANES + COUNTS), np.uint32)
    paras = [p.encode("utf-8", "surrogateescape") for ps in lists for p in ps]
    if not paras:
        return out
    h = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=5 * SPREAD).digest() for p in paras),
                      np.uint8).reshape(-1, 5 * SPREAD)
    row = np.repeat(np.arange(len(lists)), [len(ps) for ps in lists])
    value = np.ascontiguousarray(h[:, SPREAD:]).view("<u4")
    np.add.at(out, (row[:, None], h[:, :SPREAD] % LANES), value)
    piece = np.cumsum([len(p) for p in paras]) // CHUNK
    cut = np.flatnonzero((np.diff(piece) != 0) | (np.diff(row // ROWS) != 0)) + 1
    block = COUNTS // SPREAD
    for a, b in zip([0, *cut], [*cut, len(paras)]):
        para, u = units(paras[a:b])
        base, n = row[a], row[b - 1] - row[a] + 1
        at = (row[a:b][para] - base) * COUNTS
        total = np.zeros(n * COUNTS)
        for k in range(SPREAD):
            part = u >> np.uint64(16 * k)
            lane = (part >> np.uint64(1)) % np.uint64(block)
            total += np.bincount(at + k * block + lane.astype(np.int64),
                                 weights=1.0 - 2.0 * (part & np.uint64(1)), minlength=n * COUNTS)
        out[base:base + n, LANES:] += total.astype(np.int64).astype(np.uint32).reshape(n, COUNTS)
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of both documents' paragraphs together (insertion)."""
    return a + b


def remove(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of ``a`` without the paragraphs of ``b`` (deletion)."""
    return a - b


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the units in common, row by row: 1 less the squared norm of the
    difference over the squared norms of both, from the count lanes, at least 0.
    The same fingerprint gives 1."""
    def norm(v: np.ndarray) -> np.ndarray:
        return np.square(v[..., LANES:].astype(np.int32).astype(float)).sum(axis=-1)
    apart = norm(a - b) / np.maximum(norm(a) + norm(b), 1)
    return np.where((a == b).all(axis=-1), 1.0, np.maximum(1 - apart, 0.0))


def _place(doc_id, digest: int) -> tuple:
    """The order of rows: null ids first, equal ids by text digest."""
    return (False, digest) if doc_id is None else (True, doc_id, digest)


def _send(bounds: list[tuple]):
    """Compressed texts with their range; the first of a range goes to the
    range before it too (``halo``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        n = max(len(bounds), 1)
        for batch in batches:
            ids, digest = batch.column("doc_id"), batch.column("h")
            place = [_place(i, k) for i, k in zip(ids.to_pylist(), digest.to_pylist())]
            at = np.array([max(bisect_right(bounds, p) - 1, 0) for p in place], np.int64)
            extra = np.array([i for i, p in enumerate(place) if p == bounds[at[i]]], np.int64)
            z = [zip_.compress(x.as_py() or b"") for x in batch.column("body")]
            rows = np.concatenate((np.arange(len(z)), extra))
            where = np.concatenate((at, (at[extra] - 1) % n))
            halo = np.arange(len(rows)) >= len(z)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where.astype(np.int32)), pa.array(halo), ids.take(take), digest.take(take),
                 pa.array([z[i] for i in rows], pa.binary())],
                names=["piece", "halo", "doc_id", "h", "z"])
    return run


def _text(z: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogateescape")


def edited_text(text: str, following: str) -> str:
    """The last quarter replaced by as many first code points of the next."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def _judged(own: list, text: list[str], after: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """The result rows of documents and their successors."""
    edited = [edited_text(t, x) for t, x in zip(text, after)]
    at = {t: i for i, t in enumerate(dict.fromkeys([*text, *after]))}    # a successor is most often a text too
    v = vectors([paragraphs(t) for t in at])
    a, x = (v[[at[t] for t in ts]] for ts in (text, after))
    e = vectors([paragraphs(t) for t in edited])
    return pa.RecordBatch.from_arrays(
        [pa.array(own, kind), pa.array([len(t) for t in text], pa.int64()),
         pa.array([hashlib.sha256(t.encode("utf-8", "surrogateescape")).hexdigest() for t in edited],
                  pa.string()),
         pa.array([r.astype(">u4").tobytes().hex() for r in a], pa.string()),
         pa.array([r.astype(">u4").tobytes().hex() for r in e], pa.string()),
         pa.array(likeness(a, e)), pa.array(likeness(a, x))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece, halo and id: each row meets the one after it."""
    held = None        # (piece, halo, doc_id, text) whose successor is to come
    own, text, after, size, kind = [], [], [], 0, pa.null()
    for batch in batches:
        kind = batch.column("doc_id").type
        for piece, halo, doc, z in zip(*[batch.column(c) for c in ("piece", "halo", "doc_id", "z")]):
            now = (piece.as_py(), halo.as_py(), doc.as_py(), None)
            if held is not None and held[:2] == now[:2] == (now[0], True):
                continue                               # a further halo row
            now = (*now[:3], _text(z.as_py()))
            if held is not None and held[0] == now[0] and not held[1]:
                own.append(held[2])
                text.append(held[3])
                after.append(now[3])
                size += len(held[3])
                if len(own) == ROWS or size >= CHUNK:
                    yield _judged(own, text, after, kind)
                    own, text, after, size = [], [], [], 0
            held = now
    if own:
        yield _judged(own, text, after, kind)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex of the lanes) of each row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                v = vectors([paragraphs(t or "") for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x.astype(">u4").tobytes().hex() for x in v], pa.string())],
                    names=["doc_id", "fingerprint"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fingerprint string")


def successor_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"),
                      F.col(text_col).cast("binary").alias("body"))
    ranges = RANGES_EACH * shuffle_partitions(spark)
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    # the digest splits rows without an id, or with one id, over ranges
    firsts = (src.select("doc_id", "h").repartitionByRange(ranges, *order)
              .groupBy(F.spark_partition_id()).agg(
                  F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("b")).select("b.doc_id", "b.h").collect())
    bounds = sorted(_place(r["doc_id"], r["h"]) for r in firsts)    # at most `ranges` places
    sent = src.mapInArrow(_send(bounds), f"piece int, halo boolean, doc_id {kind}, h long, z binary")
    runs = sent.repartition(shuffle_partitions(spark), "piece").sortWithinPartitions("piece", "halo", *order)
    return runs.mapInArrow(_compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                     "edited_fingerprint string, near_edited double, near_next double")


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return successor_pairs(table(spark, sf_dir, "documents"))
