"""Secret scans: base patterns, and a linear-chain CRF that tags tokens as
secret begin, inside or outside.

Features of a token are its shape (length, classes of characters, changes
between letters and digits, hexadecimal or not), its neighbours (the two words
before it and the one after, hashed into buckets whose weights are learned; a name
such as ``password`` before it, an assignment sign or a quote around it) and its
file (whether the file holds such names, how dense its digits are).  The CRF is
trained on windows from a bounded sample: the ``SAMPLE`` files of lowest hash
with a base match and as many without, and of each file the ``SPANS`` labelled
spans of lowest hash over the whole file, or ``PLAIN`` tokens where there is none.
Windows are cut in tasks; only they reach the driver.  Labels come from the base
patterns, and every training window is also shown with its neighbour features hidden, so that
shape alone counts too.  All tokens of all texts are scored and decoded by
Viterbi.

Defined results: null and empty texts have no span; without any base match in
the table there is nothing to learn from and the method adds no span; spans of
the method that touch a base span are not repeated; repeated rows are scanned
alike; a null doc_id stays null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatekit.llm.common import Scratch, ship_package, table
from slatekit.llm.crf import BEGIN, INSIDE, OUTSIDE, CRF, train, viterbi

SAMPLE = 300            # training files with a base match, and as many without
SPANS = 8               # labelled spans of a training file that are shown
PLAIN = 2               # tokens shown of a training file without a label
WINDOW = 12             # tokens on either side of a span in training
CHUNK = 1 << 20         # bytes scored together

# FIXED VALUES: base patterns (ASCII, on UTF-8 bytes) and their least lengths.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
# Names that announce a secret, lower case.
NAMES = (b"password", b"passwd", b"pwd", b"passphrase", b"secret", b"token", b"apikey", b"api_key",
         b"key", b"auth", b"authorization", b"bearer", b"credential", b"credentials", b"private_key",
         b"access_key", b"secret_key", b"client_secret")

_TOKEN = np.array([not (b <= 32 or chr(b) in "\"'`:=,;()[]{}<>|!?&") for b in range(256)])
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64)
_R = 0x9E3779B97F4A7C15
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW.get("n", 0) < n:
        for name, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[name] = np.multiply.accumulate(p)
        _POW["n"] = n
    return _POW["up"], _POW["down"]


def _hash(word: bytes) -> int:
    return sum(int(_BYTE[b]) * pow(_R, i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)


_NAME_HASHES = np.array(sorted(_hash(w) for w in NAMES), np.uint64)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, by start and kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


SHAPES = 26                 # binary features
WORDS = 3                   # neighbouring words: one and two before, one after
BUCKETS = 128               # of a neighbouring word; 0: none, or hidden
FEATURES = SHAPES + WORDS
CONTEXT = (slice(14, 22), slice(SHAPES, FEATURES))     # neighbour features


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, features) of the tokens of a few texts; starts and
    ends are byte offsets in the document."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    arr = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(arr)
    is_tok = _TOKEN[arr]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_tok, [False])).astype(np.int8)))
    s, e = edge[::2], edge[1::2]

    def upto(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(n + 1, np.int32)
        np.cumsum(mask, out=c[1:])
        return c

    kind = _KIND[arr]
    digit, upper, lower = (upto(kind == k) for k in (3, 2, 1))
    hexa = upto(_HEX[arr])
    turn = upto(np.concatenate(([False], (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0))))
    sign, quote = upto((arr == 58) | (arr == 61)), upto((arr == 34) | (arr == 39) | (arr == 96))
    up, down = _powers(n)
    roll = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[arr]] * up[:n], out=roll[1:])
    word = (roll[e] - roll[s]) * down[s]
    name = np.isin(word, _NAME_HASHES)
    doc = np.searchsorted(begin, s, "right") - 1

    length = e - s
    d, u, lo = digit[e] - digit[s], upper[e] - upper[s], lower[e] - lower[s]
    hx, tn = hexa[e] - hexa[s], turn[e] - np.where(s > 0, turn[np.minimum(s + 1, n)], 0)
    other = length - d - u - lo
    m = len(s)
    same = np.zeros(m, bool)
    same[1:] = doc[1:] == doc[:-1]
    prev = np.zeros(m, np.int64)
    prev[1:] = e[:-1]
    prev = np.where(same, prev, begin[doc] if m else prev)
    after = np.full(m, 0, np.int64)
    after[:-1] = s[1:]
    same_next = np.zeros(m, bool)
    same_next[:-1] = same[1:]
    after = np.where(same_next, after, (begin + size)[doc] if m else after)
    back = lambda x, k: np.concatenate((np.zeros(k, bool), x[:-k]))[:m] if m >= k else np.zeros(m, bool)
    name1 = back(name, 1) & same
    name2 = back(name, 2) & same & back(same, 1)
    signed = sign[s] > sign[prev]
    quoted, closed = quote[s] > quote[prev], quote[after] > quote[e]
    tight = np.zeros(m, bool)
    tight[1:] = same[1:] & (s[1:] - e[:-1] == 1)
    named = np.bincount(doc[name], minlength=len(texts)) > 0
    dense = (digit[begin + size] - digit[begin]) * 20 > np.maximum(size, 1)
    signs = (sign[begin + size] - sign[begin]) * 50 > np.maximum(size, 1)
    f = np.empty((m, FEATURES), np.uint8)
    cols = [
        np.ones(m, bool), length < 4, (length >= 4) & (length < 8), (length >= 8) & (length < 16),
        (length >= 16) & (length < 28), length >= 28, d == 0, (d > 0) & (d * 4 < length), d * 4 >= length,
        (d == length), (u > 0) & (lo > 0) & (d > 0), (hx == length) & (d > 0) & (lo > 0), tn >= 4, other > 1,
        name1, name2, signed, signed & name1, signed & (name1 | name2), quoted, quoted & closed, tight,
        named[doc], dense[doc], signs[doc], (tn >= 4) & (length >= 12)]
    for k, c in enumerate(cols):
        f[:, k] = c
    bucket = ((word * np.uint64(_R) >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.uint8)
    near = f[:, SHAPES:]
    near[:] = 0
    near[1:, 0] = np.where(same[1:], bucket[:-1], 0)
    near[2:, 1] = np.where(same[2:] & same[1:-1], bucket[:-2], 0)
    near[:-1, 2] = np.where(same[1:], bucket[1:], 0)
    return doc, s - begin[doc], e - begin[doc], f


def cut_windows(text: bytes, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of the tokens around the training spans of a file,
    labelled by the base patterns."""
    _, s, e, f = tokens([text])
    y = np.full(len(s), OUTSIDE, np.int8)
    for a, kind, b in base_spans(text):
        if kind == 0:
            a = b - len(ASSIGN.match(text, a).group(2))
        hit = np.flatnonzero((s < b) & (e > a))
        y[hit] = INSIDE
        y[hit[:1]] = BEGIN
    own = np.flatnonzero(y == BEGIN)
    at = own if len(own) else np.arange(len(s))
    salt = hashlib.blake2b(text, digest_size=8, salt=seed.to_bytes(8, "little")).digest()
    h = (s[at].astype(np.uint64) ^ np.frombuffer(salt, "<u8")) * np.uint64(_R)
    h = (h ^ h >> np.uint64(32)) * np.uint64(_R)
    some = at[np.argsort(h ^ h >> np.uint64(32), kind="stable")[:SPANS if len(own) else PLAIN]]
    return [(f[max(0, c - WINDOW):c + WINDOW + 1], y[max(0, c - WINDOW):c + WINDOW + 1]) for c in some]


def fit(texts: list[bytes], seed: int = 3) -> CRF | None:
    """Train on texts labelled by the base patterns; None without a label."""
    return fit_windows([w for text in texts for w in cut_windows(text, seed)])


def fit_windows(cut: list[tuple[np.ndarray, np.ndarray]]) -> CRF | None:
    """The same on the windows cut from them, in any order."""
    if not any((y == BEGIN).any() for _, y in cut):
        return None
    windows: list[tuple[np.ndarray, np.ndarray]] = []
    for f, y in sorted(cut, key=lambda w: (w[0].tobytes(), w[1].tobytes())):
        bare = f.copy()
        for part in CONTEXT:
            bare[:, part] = 0
        windows += [(f, y), (bare, y)]
    t = 2 * WINDOW + 1
    x = np.zeros((len(windows), t, FEATURES), np.uint8)
    y = np.full((len(windows), t), OUTSIDE, np.int64)
    for i, (f, lab) in enumerate(windows):
        x[i, :len(f)], y[i, :len(lab)] = f, lab
    return train(x, y, np.array([len(f) for f, _ in windows]), words=WORDS, buckets=BUCKETS)


def tagged(model: CRF | None, texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Byte spans the CRF tags in each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if model is None:
        return out
    doc, s, e, f = tokens(texts)
    lab = viterbi(model, model.scores(f), doc)
    for i in np.flatnonzero(lab != OUTSIDE).tolist():
        d, spans = int(doc[i]), out[int(doc[i])]
        end = int(e[i])
        while end > s[i] + 1 and texts[d][end - 1] in b".!?":
            end -= 1
        if lab[i] == INSIDE and spans and i and lab[i - 1] != OUTSIDE and doc[i - 1] == d:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((int(s[i]), end))
    return out


def apart(extra: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans (start, end) that touch none of ``base`` (by start): of those
    that begin before a span's end, the farthest end is before its start."""
    if not extra or not base:
        return extra
    starts, ends = np.array([x for x, _, _ in base]), np.maximum.accumulate([y for _, _, y in base])
    a, b = np.array(extra).T
    before = np.searchsorted(starts, b, "left")
    touches = (before > 0) & (ends[np.maximum(before - 1, 0)] > a)
    return [x for x, t in zip(extra, touches.tolist()) if not t]


def spans_of(model: CRF | None, texts: list[bytes]) -> list[list[tuple[int, str, int]]]:
    """(start, kind, end) in code points, base spans and those of the CRF, by
    start and kind."""
    out = []
    for text, extra in zip(texts, tagged(model, texts)):
        base = base_spans(text)
        found = sorted(base + [(a, 3, b) for a, b in apart(extra, base)])
        if found:
            points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
            found = [(int(points[a]), k, int(points[b])) for a, k, b in found]
        out.append([(a, (*KINDS, "crf")[k], b) for a, k, b in found])
    return out


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            size = pc.binary_length(batch.column("body")).fill_null(0).to_numpy(zero_copy_only=False)
            cut = np.cumsum(size) // CHUNK
            for c in np.unique(cut):
                a, b = np.searchsorted(cut, [c, c + 1])
                part = batch.slice(a, b - a)
                texts = [t or b"" for t in part.column("body").to_pylist()]
                found = spans_of(crf, texts)
                base = [[x for x in row if x[1] != "crf"] for row in found]
                join = lambda row: ",".join(f"{k}:{x}:{y}" for x, k, y in row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"),
                     *[pa.array([sum(x[1] == k for x in row) for row in base], pa.int64()) for k in KINDS],
                     pa.array([hashlib.sha256(join(row).encode()).hexdigest() for row in base], pa.string()),
                     pa.array([join(row) for row in found], pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cut = [w for text in batch.column("body").to_pylist() for w in cut_windows(text or b"")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f.tobytes() for f, _ in cut], pa.binary()), pa.array([y.tobytes() for _, y in cut], pa.binary())],
            names=["f", "y"])


def training_windows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of the bounded sample: files of lowest hash with and without a
    base match; at most 2 * ``sample`` * ``SPANS`` windows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hit = F.rlike(text, F.lit(
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}")) \
        | F.rlike(text, F.lit("AKIA[A-Z0-9]{16}|[0-9a-f]{24}"))
    # only hashes travel: the patterns run once, and the texts of the chosen
    # hashes are fetched afterwards
    marks = Scratch(docs.sparkSession, "secrets").write(
        docs.select(F.xxhash64("text").alias("at"), hit.alias("hit")), "marks")
    chosen = []
    for want in (F.col("hit"), ~F.col("hit")):
        chosen += [r["at"] for r in marks.where(want).select("at").distinct().orderBy("at").limit(sample).collect()]
    if not chosen:
        return []
    texts = docs.where(F.xxhash64("text").isin(chosen)).select(F.col("text").cast("binary").alias("body")).distinct()
    return [(np.frombuffer(r["f"], np.uint8).reshape(-1, FEATURES), np.frombuffer(r["y"], np.int8))
            for r in texts.mapInArrow(_cut, "f binary, y binary").collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex,
    base_sha256, spans."""
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = spark.sparkContext.broadcast(fit_windows(training_windows(src)))
    kind = docs.schema[id_col].dataType.simpleString()
    return src.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(
        _scan(model), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, "
                      "spans string")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
