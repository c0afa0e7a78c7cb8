"""Token ids as binary files in Simple-8b, a word-aligned code.

A 64-bit word holds a selector (4 bits) and as many ids as fit the rest: 60 of 1
bit, 30 of 2, ... 1 of 60.  Selector ``ESCAPE`` says that the whole next word is
one id.  Ids are coded greedily in blocks of ``BLOCK``; a block begins with a word
of its own, and the file's foot holds the first word of each, so any range of ids
is decoded from its blocks alone, and a block's words are decoded selector by
selector with numpy.

A file, little-endian: magic; the words; the foot (first word of each block; id
count of each document, in the same code; keys of the documents as UTF-8 byte
counts, -1 for null, and bytes; CRC-32 of the words and of the foot so far); the
tail ``TAIL``.

Documents are range-partitioned and sorted by id, so that file after file holds
them in ascending order; a task starts another file at ``FILE_IDS`` ids and names
files after its attempt, and only files of attempts that Spark commits are in the
index.  Files go to the shared folder (``spark.checkpoint.dir``).  With a
tokenizer that drops spaces and line ends, texts are tokenized in pieces cut there, so
that memory grows with the longest run without any and not with the text, and each
worker gives a run that repeats to the tokenizer once; with others, text by text.

Defined results: a null text is empty and has the end id alone; null ids come
first; rows with equal ids stand in the order of a hash of their texts, equal rows
are interchangeable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatekit.llm.common import Scratch, arrow_batches, running, ship_package, shuffle_partitions, table
from slatekit.llm.warc import file_system

# FIXED VALUES of the code: ids in a word by selector; each takes 60 // count bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
MAGIC = b"S8BIDS01"
TAIL = struct.Struct("<QQQIII")     # ids, words, documents, blocks, foot bytes, CRC-32 of the foot

BLOCK = 4096             # ids of one block
BUFFER = 256 * BLOCK     # ids coded at a time
FILE_IDS = 1 << 22       # ids of one file, about
PIECE = 1 << 22          # characters of a text tokenized at a time, about
BATCH = 1 << 21          # characters tokenized at once, about
WORDS = 1 << 18          # distinct words a worker remembers, about
END_ID = 2
ENCODE = 1 << 12         # words in one call of the tokenizer
JOINED = 64              # words in one text of a call
MARK = "\x01"            # stands after each of them
SPACE = re.compile("[ \n]")

INDEX = "part int, seq int, file string, docs long, ids long"


def _ids_to_a_word() -> tuple[np.ndarray, np.ndarray]:
    """By bit width of an id, and by room left in a block: the most ids that a
    word may hold."""
    bits, room = np.arange(65), np.arange(max(COUNTS) + 1)
    fits = np.array([[c * b <= 60 for c in COUNTS] for b in bits])
    by_width = np.where(fits.any(axis=1), np.array(COUNTS)[fits.argmax(axis=1)], 1)
    by_room = np.array([max([c for c in COUNTS if c <= r], default=1) for r in room])
    return by_width.astype(np.int8), by_room.astype(np.int8)


BY_WIDTH, BY_ROOM = _ids_to_a_word()
SMALL = 1 << 16
BY_SMALL = BY_WIDTH[np.frexp(np.arange(SMALL, dtype=np.float64))[1]]


def _most(ids: np.ndarray) -> np.ndarray:
    if int(ids.max()) < SMALL:
        return BY_SMALL[ids]
    # rounding moves a width only where a word holds one id either way
    return BY_WIDTH[np.frexp(ids.astype(np.float64))[1].clip(max=64)]


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of ids that begin a block."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = _most(ids)                 # over the ids of a window, of the most that each allows
    step = np.ones(n, np.int8)         # ids of the word that begins here
    held = 1
    for count in sorted(COUNTS)[1:]:
        shift = count - held           # at most `held`, so two windows cover the longer one
        if len(least) <= shift:
            break
        least, held = np.minimum(least[:-shift], least[shift:]), count
        fits = least >= count
        if not fits.any() and not (least > 1).any():
            break
        step[:len(least)][fits] = count
    firsts = np.arange(0, n, block)
    ends = np.minimum(firsts + block, n)
    near = (ends[:, None] - np.arange(1, len(BY_ROOM))).ravel()
    rooms = np.tile(BY_ROOM[1:], len(ends))[near >= np.repeat(firsts, len(BY_ROOM) - 1)]
    near = near[near >= np.repeat(firsts, len(BY_ROOM) - 1)]
    step[near] = np.minimum(step[near], rooms)
    begins, at = np.zeros(n, bool), firsts        # all blocks are walked side by side
    while len(at):
        begins[at] = True
        at = at + step[at]
        live = at < ends
        if not live.all():
            at, ends = at[live], ends[live]
    starts = np.flatnonzero(begins)
    counts = step[starts]
    big = (counts == 1) & (ids[starts] >> np.uint64(60) != 0)
    place = np.arange(len(starts)) + np.cumsum(big) - big      # an escape takes two words
    words = np.zeros(len(starts) + int(big.sum()), np.uint64)
    for selector, count in enumerate(COUNTS):
        mine = np.flatnonzero((counts == count) & ~big)
        if len(mine):
            at, word = starts[mine], np.full(len(mine), selector << 60, np.uint64)
            for k in range(count):
                word |= ids[at + k] << np.uint64(k * (60 // count))
            words[place[mine]] = word
    words[place[big]] = np.uint64(ESCAPE << 60)
    words[place[big] + 1] = ids[starts[big]]
    return words, place[starts % block == 0].astype(np.int64)


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    escape, raw = np.zeros(len(words), bool), -1
    for at in np.flatnonzero(selector == ESCAPE).tolist():
        if at != raw:                                          # not itself an escaped id
            escape[at], raw = True, at + 1
    held = ~escape
    literal = np.flatnonzero(escape) + 1
    size = np.zeros(len(words), np.int64)
    size[held] = np.array([*COUNTS, 0, 1])[selector[held]]
    size[literal] = 1
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    held[literal] = False
    for k, count in enumerate(COUNTS):
        mine = np.flatnonzero(held & (selector == k))
        if len(mine):
            bits = 60 // count
            shift = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[first[mine][:, None] + np.arange(count)] = (words[mine][:, None] >> shift) & np.uint64((1 << bits) - 1)
    out[first[literal]] = words[literal]
    return out


class IdWriter:
    """Writes documents' ids into one file."""

    def __init__(self, out):
        self.out, self.ids, self.words, self.crc = out, 0, 0, 0
        self.wait: list[np.ndarray] = []
        self.waiting = 0
        self.firsts: list[np.ndarray] = []
        self.counts: list[int] = []
        self.keys: list[bytes | None] = []
        out.write(MAGIC)

    def begin(self, key: str | None) -> None:
        self.keys.append(None if key is None else key.encode())
        self.counts.append(0)

    def add(self, ids: np.ndarray) -> None:
        """More ids of the document begun last."""
        self.wait.append(ids)
        self.waiting += len(ids)
        self.counts[-1] += len(ids)
        self.ids += len(ids)
        if self.waiting >= BUFFER:
            self.flush(self.waiting - self.waiting % BLOCK)

    def flush(self, n: int) -> None:
        """Code the first ``n`` waiting ids."""
        held = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32)
        words, firsts = encode(held[:n])
        data = words.astype("<u8").tobytes()
        self.out.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.firsts.append(firsts + self.words)
        self.words += len(words)
        self.wait, self.waiting = [held[n:]], len(held) - n

    def close(self) -> None:
        self.flush(self.waiting)
        firsts = np.concatenate(self.firsts)
        counts, _ = encode(np.array(self.counts, np.uint64))
        sizes = np.array([-1 if k is None else len(k) for k in self.keys], "<i4")
        foot = b"".join([firsts.astype("<u8").tobytes(), struct.pack("<I", len(counts)), counts.astype("<u8").tobytes(),
                         sizes.tobytes(), *[k or b"" for k in self.keys], struct.pack("<I", self.crc)])
        self.out.write(foot + TAIL.pack(self.ids, self.words, len(self.keys), len(firsts), len(foot), zlib.crc32(foot)))
        self.out.close()


class IdFile:
    """Reads a file of ids: its documents, any range of its ids."""

    def __init__(self, f):
        self.f = f
        end = f.seek(0, os.SEEK_END)
        f.seek(end - TAIL.size)
        self.ids, self.words, n, blocks, size, crc = TAIL.unpack(f.read(TAIL.size))
        f.seek(end - TAIL.size - size)
        foot = f.read(size)
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC or zlib.crc32(foot) != crc:
            raise ValueError("not a whole file of ids")
        self.firsts = np.append(np.frombuffer(foot, "<u8", blocks).astype(np.int64), self.words)
        at = 8 * blocks
        held = struct.unpack_from("<I", foot, at)[0]
        self.counts = decode(np.frombuffer(foot, "<u8", held, at + 4)).astype(np.int64)
        at += 4 + 8 * held
        sizes = np.frombuffer(foot, "<i4", n, at)
        at += 4 * n
        self.keys: list[str | None] = []
        for k in sizes.tolist():
            self.keys.append(None if k < 0 else foot[at:at + k].decode())
            at += max(k, 0)
        self.crc = struct.unpack_from("<I", foot, at)[0]

    def blocks(self, a: int, b: int) -> np.ndarray:
        """The ids of blocks ``a`` to ``b`` (exclusive)."""
        self.f.seek(len(MAGIC) + 8 * int(self.firsts[a]))
        n = int(self.firsts[b] - self.firsts[a])
        return decode(np.frombuffer(self.f.read(8 * n), "<u8"))

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` (exclusive)."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        a = start // BLOCK
        return self.blocks(a, -(-stop // BLOCK))[start - a * BLOCK:stop - a * BLOCK]

    def documents(self) -> Iterator[tuple[str | None, int, int, int]]:
        """(key, first id, ids, CRC-32 of the ids as 32-bit integers) of each
        document, decoding ``BUFFER`` ids at a time."""
        at, base, held = 0, 0, b""
        for key, n in zip(self.keys, self.counts.tolist()):
            crc, i, end = 0, at, at + n
            while i < end:
                if i >= base + len(held) // 4:
                    base = i // BLOCK * BLOCK
                    stop = min(base // BLOCK + BUFFER // BLOCK, len(self.firsts) - 1)
                    held = self.blocks(base // BLOCK, stop).astype("<u4").tobytes()
                part = held[4 * (i - base):4 * (end - base)]
                crc = zlib.crc32(part, crc)
                i += len(part) // 4
            yield key, at, n, crc
            at = end


def pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` cut before spaces and line ends, each piece of ``size``
    characters or up to the next one."""
    out, at = [], 0
    while len(text) - at > size and (cut := SPACE.search(text, at + size)):
        out.append(text[at:cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


class Words(dict):
    """Number of each remembered word (a run without spaces and line ends), and the
    words' ids end to end.  Where the tokenizer drops white
    space and joins nothing across it (``apart``), a text's ids are those of its
    words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        one, two, mark = self.texts(["ab", "cd.", MARK])
        self.apart = self.texts(["ab cd.", " ab\ncd. ", "  ab \n\n cd.\n"]) == [one + two] * 3
        marked = self.texts([f"ab {MARK} cd. {MARK}", f"{MARK} ab.  {MARK}"])
        self.mark = mark[0] if len(mark) == 1 and marked == [one + mark + two + mark, mark + self.texts(["ab."])[0] + mark] else None
        spec = json.loads(self.tokenizer.to_str())
        steps = spec["normalizer"] or {}
        self.folds = any(x["type"] == "Lowercase" for x in steps.get("normalizers", [steps]) if "type" in x)
        self.special = [x["content"].lower() for x in spec["added_tokens"]]
        self.size = np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def texts(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words end to end, and how many each has.  Words go to the
        tokenizer ``JOINED`` at a time, a mark of one id after each; where other
        marks come back than went in (a word has one), word by word."""
        flat, sizes = [], []
        for k in range(0, len(words), ENCODE):
            part = words[k:k + ENCODE]
            if self.mark is not None:
                joined = [f" {MARK} ".join([*part[i:i + JOINED], ""]) for i in range(0, len(part), JOINED)]
                ids = np.fromiter(chain.from_iterable(self.texts(joined)), np.uint32)
                marks = np.flatnonzero(ids == self.mark)
                if len(marks) == len(part):
                    flat.append(np.delete(ids, marks))
                    sizes.append(np.diff(marks, prepend=-1) - 1)
                    continue
            got = self.texts(part)
            flat.append(np.fromiter(chain.from_iterable(got), np.uint32))
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        return np.concatenate(flat), np.concatenate(sizes)

    def trim(self, most: int) -> None:
        """Forget all but the ``most`` words found in the most pieces of text."""
        keep = np.sort(np.argsort(-self.hits, kind="stable")[:most])
        names = list(self)
        self.flat = self.ids(keep)
        self.size, self.hits = self.size[keep], self.hits[keep] // 2
        self.first = np.cumsum(self.size) - self.size
        self.clear()
        self.update((names[k], n) for n, k in enumerate(keep.tolist()))

    def numbers(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """The numbers of distinct words found so many times; new ones are
        tokenized."""
        out = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            new = [words[k] for k in fresh.tolist()]
            out[fresh] = np.arange(len(self), len(self) + len(new))
            self.update(zip(new, out[fresh].tolist()))
            flat, size = self.encoded(new)
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])
            self.first = np.cumsum(self.size) - self.size
            self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.hits[out] += counts
        return out

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        end = np.cumsum(size)
        at = np.repeat(self.first[numbers] - (end - size), size)
        return self.flat[at + np.arange(len(at))]

    def folded(self, texts: pa.Array) -> pa.Array:
        """A-Z lowered, where the tokenizer does so itself and no special token
        could be meant: fewer words differ."""
        if not self.folds:
            return texts
        low = pc.ascii_lower(texts)
        for token in self.special:
            low = pc.if_else(pc.match_substring(low, token), texts, low)
        return low

    def texts_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        on = gc.isenabled()
        gc.disable()                   # lists of numbers have no cycles to look for
        try:
            return self._texts_ids(texts)
        finally:
            if on:
                gc.enable()

    def _texts_ids(self, texts: list[str]) -> list[np.ndarray]:
        whole = self.folded(pa.array(texts, pa.large_string()))
        words = pc.split_pattern(pc.replace_substring(whole, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        # by numpy, which makes strings faster than `to_pylist`
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = self.numbers(distinct, np.bincount(at, minlength=len(coded.dictionary)))[at]
        size = np.concatenate([[0], np.cumsum(self.size[numbers])])
        cut = size[words.offsets.to_numpy()]
        out = np.split(self.ids(numbers), cut[1:-1])
        if len(self) > WORDS:
            self.trim(WORDS // 2)
        return out


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def token_ids(path: str, texts: Iterator[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, ids) for the pieces of each text in turn."""
    words = words_of(path)
    if not words.apart:
        for k, text in enumerate(texts):
            yield k, np.array(words.texts([text])[0], np.uint32)
        return
    wait: list[tuple[int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        for p in pieces(text):
            wait.append((k, p))
            size += len(p)
            if size >= BATCH:
                yield from zip([n for n, _ in wait], words.texts_ids([t for _, t in wait]))
                wait, size = [], 0
    if wait:
        yield from zip([n for n, _ in wait], words.texts_ids([t for _, t in wait]))


def _write(folder: str, path: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        task = TaskContext.get()
        writer, seq = None, 0

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId()], pa.int32()), pa.array([seq - 1], pa.int32()), pa.array([f"{folder}/{name}"]),
                 pa.array([len(writer.keys)], pa.int64()), pa.array([writer.ids], pa.int64())],
                names=["part", "seq", "file", "docs", "ids"])
        last = np.array([end_id], np.uint32)
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text")
            now = -1
            for k, ids in token_ids(path, (t.as_py() for t in texts)):
                if k != now:
                    if now >= 0:
                        writer.add(last)
                    if writer is not None and writer.ids >= file_ids:
                        yield done()
                        writer = None
                    if writer is None:
                        name = f"ids-{task.taskAttemptId():010d}-{seq:05d}.s8b"
                        writer, seq = IdWriter(fs.open_output_stream(f"{base}/{name}", compression=None)), seq + 1
                    writer.begin(keys[k])
                    now = k
                writer.add(ids)
            if now >= 0:
                writer.add(last)
        if writer is not None:
            yield done()
    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document of the named files."""
    names = ["key", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
            fs, path = file_system(file)
            rows: list[tuple] = []
            with fs.open_input_file(path) as f:
                for key, start, n, crc in IdFile(f).documents():
                    rows.append((key, base + start, n, crc))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                                             names=names)


def write_ids(docs: DataFrame, path: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files and returns their index in order (part, seq, file,
    docs, ids)."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = scratch.path("ids")
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the row number splits repeated rows over tasks
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.withColumns({"_h": order[1], "_n": order[2]})
    rows = rows.repartitionByRange(shuffle_partitions(spark), order[0], "_h", "_n").sortWithinPartitions(order[0], "_h", "_n")
    with arrow_batches(spark):
        return scratch.write(rows.select("key", "text").mapInArrow(_write(folder, path, end_id, file_ids), INDEX), "index")


def read_ids(index: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the indexed
    files; ``start`` counts the ids of all files before."""
    spark = index.sparkSession
    placed = running(index, [], ["part", "seq"], {"end": F.col("ids")}, scratch, "ranged")
    files = placed.select("file", (F.col("end") - F.col("ids")).alias("base"))
    # a file name is few bytes, which says nothing of the work
    return files.repartition(4 * shuffle_partitions(spark), "file").mapInArrow(
        _read, "key string, start long, n_tokens long, ids_crc32 long")


def op11_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "ids")
    out = read_ids(write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), scratch), scratch)
    return out.select(F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "start", "n_tokens", "ids_crc32")
