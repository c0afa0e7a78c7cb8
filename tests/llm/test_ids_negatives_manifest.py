"""Token ids as files, hard negatives and the Merkle manifest: brute force,
round trips and edge rows."""
import hashlib
import io
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from slatekit.llm import hardneg, merkle, neardup, wordpack
from slatekit.llm.common import BATCH_BYTES, Scratch, arrow_batches, table
from tests.conftest import SF_SMALL
from tests.llm.test_edges import ROWS, SCHEMA

PATH = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- token ids
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2 ** 64 - 1),
                          st.just(15 << 60)), max_size=300), st.sampled_from([1, 7, 64, 4096]))
def test_words_round_trip(ids, block):
    words, firsts = wordpack.encode(np.array(ids, np.uint64), block)
    assert wordpack.decode(words).tolist() == ids
    assert len(firsts) == -(-len(ids) // block)
    for k, at in enumerate(firsts.tolist()):
        end = firsts[k + 1] if k + 1 < len(firsts) else len(words)
        assert wordpack.decode(words[at:end]).tolist() == ids[k * block:(k + 1) * block]


def test_words_are_packed():
    assert len(wordpack.encode(np.zeros(4080, np.uint64))[0]) == 4080 // 60
    assert len(wordpack.encode(np.full(4080, 1000, np.uint64))[0]) == 4080 // 6


class Kept(io.BytesIO):
    def close(self):
        pass


def test_file_round_trip_and_ranges():
    rng = np.random.default_rng(5)
    docs = [(f"k{i}", rng.integers(0, 50000, n)) for i, n in enumerate([0, 1, 5000, 0, 300000, 4096])] + [(None, np.array([2]))]
    f = Kept()
    w = wordpack.IdWriter(f)
    for key, ids in docs:
        w.begin(key)
        for part in np.array_split(ids, 3):
            w.add(part.astype(np.uint32))
    w.close()
    all_ids = np.concatenate([ids for _, ids in docs])
    r = wordpack.IdFile(f)
    start = 0
    for (key, ids), got in zip(docs, r.documents()):
        assert got == (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)
    for a, b in ((0, 0), (0, 1), (4095, 4097), (5000, 300001), (len(all_ids) - 1, len(all_ids))):
        assert r.range(a, b).tolist() == all_ids[a:b].tolist()
    broken = bytearray(f.getvalue())
    broken[-wordpack.TAIL.size - 3] ^= 1
    with pytest.raises(ValueError):
        wordpack.IdFile(io.BytesIO(bytes(broken)))


def test_pieces_tokenize_like_the_whole():
    tok = Tokenizer.from_file(PATH)
    for text in ("Ünï don't  stop\n\n'tis 12345 <|endoftext|> é ́ ΣΑΣ. " * 40, "x" * 500, "", " ", "a\n" * 300):
        for size in (1, 7, 50):
            parts = wordpack.pieces(text, size)
            assert "".join(parts) == text
            assert [i for p in parts for i in tok.encode(p, add_special_tokens=False).ids] == tok.encode(text, add_special_tokens=False).ids


def test_words_give_the_ids_of_the_text():
    texts = ["Ünï don't  stop\n\n'tis 12345 <|endoftext|> é ́ ΣΑΣ. a\tb\x0bc d\u3000e " * 40, "", " ", "\n \n", "x" * 400, "a  b", None,
             "A<|EndOfText|>B <|endoftext|>C <|ENDOFTEXT|>", "ÀÉ ABC Ω İI <|EndOf"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tok = Tokenizer.from_file(path)
        assert wordpack.words_of(path).apart == (name == "word_bpe_49k.json")
        for _ in range(2):
            got = {}
            for k, ids in wordpack.token_ids(path, (t or "" for t in texts)):
                got.setdefault(k, []).extend(ids.tolist())
            assert [got[k] for k in range(len(texts))] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(wordpack, "WORDS", 3)
    monkeypatch.setattr(wordpack, "BATCH", 5)
    monkeypatch.setattr(wordpack, "PIECE", 4)
    monkeypatch.setattr(wordpack, "ENCODE", 2)
    wordpack.words_of.cache_clear()
    tok, texts = Tokenizer.from_file(PATH), ["one two three four five", "six one seven two", "one"] * 3
    got = {}
    for k, ids in wordpack.token_ids(PATH, iter(texts)):
        got.setdefault(k, []).extend(ids.tolist())
        assert len(wordpack.words_of(PATH)) <= 3
    assert [got[k] for k in range(len(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_joined_by_marks_have_their_own_ids():
    words = wordpack.Words(PATH)
    assert words.mark is not None
    calls = []
    real = words.texts
    words.texts = lambda texts: calls.append(len(texts)) or real(texts)
    plain = ["Ünï", "don't", "", "x%%", "12.5", "é", "ΣΑΣ."] * 40
    for more in ([], ["a\x01b"], ["\x01"]):                # a word with the mark: word by word
        calls.clear()
        flat, size = words.encoded(plain + more)
        want = [words.tokenizer.encode(w, add_special_tokens=False).ids for w in plain + more]
        assert size.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])
        assert calls == [-(-len(plain + more) // wordpack.JOINED)] + [len(plain + more)] * bool(more)


def test_arrow_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 300, numPartitions=1).selectExpr("repeat('x', 1000) AS t").mapInArrow(sizes, "n long")
    with arrow_batches(spark, 20_000):
        got = [r["n"] for r in rows.collect()]
        with arrow_batches(spark, 40_000):
            assert spark.conf.get(name) == "20000"
    assert len(got) >= 10 and max(got) < 40_000 and spark.conf.get(name) == before


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    """Near-duplicate sets and token ids of texts larger together than a batch."""
    seen, kind = [], type(spark.range(1))
    real = kind.mapInArrow

    def kept(self, *args, **kw):
        seen.append(self.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
        return real(self, *args, **kw)
    monkeypatch.setattr(kind, "mapInArrow", kept)
    docs = spark.createDataFrame([(i, "a b c d e f" + f" w{i // 2}" * 9) for i in range(8)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(8)}
    wordpack.write_ids(docs, PATH, Scratch(spark, "small-batches"))
    assert len(seen) >= 4 and {int(x) for x in seen} == {BATCH_BYTES}


def brute_ids(rows):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_ids_against_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect())
    got = sorted(map(tuple, wordpack.op11_token_ids(spark, SF_SMALL).collect()))
    assert got == brute_ids(rows)


def test_token_ids_edge_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for file_ids in (1, wordpack.FILE_IDS):
        scratch = Scratch(spark, "ids-test")
        index = wordpack.write_ids(docs, PATH, scratch, file_ids=file_ids)
        if file_ids == 1:
            assert index.count() == len(ROWS)
        got = sorted(map(tuple, wordpack.read_ids(index, scratch).collect()), key=lambda r: r[1])
        assert [None, "1", "1", "2", "3", "4", "5", "6", "7", "7"] == [r[0] for r in got]
        ends = np.cumsum([r[2] for r in got])
        assert [r[1] for r in got] == [0, *ends[:-1]]
        texts = sorted((str(r[0]), brute_ids([(None, r[1])])[0][2:]) for r in ROWS)
        assert sorted((str(r[0]), r[2:]) for r in got) == texts
        assert [r[2] for r in got if r[0] in ("2", "3", "4")] == [1, 1, 1]
    scratch = Scratch(spark, "ids-test")
    assert wordpack.read_ids(wordpack.write_ids(docs.limit(0), PATH, scratch), scratch).collect() == []
    scratch = Scratch(spark, "ids-test")
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text", "h AS key", "size AS _h", "lang AS id")
    assert {r["key"] for r in wordpack.read_ids(wordpack.write_ids(named, PATH, scratch), scratch).collect()} == \
        {None, *[f"d{i}" for i in range(1, 8)]}


# ----------------------------------------------------------- hard negatives
def test_threshold_join_finds_every_pair():
    rng = np.random.default_rng(6)
    for dims, n in ((64, 400), (5, 300), (1, 50), (0, 3)):
        x = np.floor(rng.normal(size=(n, dims)) * 256)
        x[: n // 3] = x[0]                                    # copies
        if dims > 1:
            x[5, 0], x[n - 1, 1] = 2.0 ** 40, -(2.0 ** 70)    # beyond what floats keep exact
        a = x[::7]
        for least in (np.full(len(a), -hardneg.FAR), np.full(len(a), 50000), rng.integers(-20000, 90000, len(a))):
            got = sorted((int(i), int(j), int(s)) for p in hardneg.threshold_join(a, least, x) for i, j, s in zip(*p))
            want = [(i, j, s) for i in range(len(a)) for j in range(n)
                    if (s := hardneg.long_score(a[i], x[j])) >= least[i]]
            assert got == want


def test_index_omits_covered_dimensions():
    x = np.array([[200.0, 3, 2, 1], [1, 2, 200, 3]])
    assert [p for p in hardneg.threshold_join(x[:1], np.array([30000]), x)][-1][1].tolist() == [0]


def brute_negatives(rows, anchors):
    rows = [(r, i, lab, [math.floor(256 * v) for v in vec]) for r, (i, lab, vec) in enumerate(rows)
            if lab is not None and vec is not None and all(v is not None and math.isfinite(v) for v in vec)]
    dot = lambda p, q: sum(a * b for a, b in zip(p, q))
    order = lambda t: (-t[0], t[1] is None, t[1], t[2])
    out = []
    for r, i, lab, vec in rows:
        if i is None or i % anchors:
            continue
        near = sorted(((dot(vec, v), j, k) for k, j, other, v in rows if other == lab and k != r), key=order)[:5]
        for s, j, _ in near:
            bad = sorted(((t, m, k) for k, m, other, v in rows if other != lab
                          and 30 * s <= 100 * (t := dot(vec, v)) <= 90 * s), key=order)[:10]
            out += [(i, j, n + 1, m, s, t) for n, (t, m, _) in enumerate(bad)]
    return sorted(out, key=str)


def test_hard_negatives_edge_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 4)), rng.normal(size=6).round(2).tolist()) for i in range(120)]
    rows += [(200 + i, 1, rows[0][2]) for i in range(40)]                     # a hot vector
    rows += [(7, None, [1.0] * 6), (10, 2, None), (20, 1, [float("nan")] * 6), (30, 1, [float("inf")] * 6), (40, 2, [1.0, None]),
             (None, 2, [0.5] * 6), (None, 1, [0.5] * 6), (50, 3, []), (60, 3, [0.25, 0.5]), (70, 2, [0.0] * 6), (80, 2, [1e-3] * 6),
             (0, 1, rows[0][2]), (0, 1, rows[0][2]), (90, 9, [1.0] * 6)]
    schema = "vec_id long, label int, embedding array<double>, r long, a string, score int"
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], schema)
    got = [tuple(r) for r in hardneg.mine(df, df.vec_id % 10 == 0).collect()]
    assert sorted(got, key=str) == brute_negatives(rows, 10)
    assert hardneg.mine(df.limit(0), df.vec_id % 10 == 0).collect() == []
    assert hardneg.mine(df, df.vec_id > 10 ** 6).collect() == []
    named = df.selectExpr("concat('v', vec_id) AS vec_id", "concat('l', label) AS label", "embedding")
    assert len(hardneg.mine(named, named.vec_id.endswith("0")).collect()) == len(got)


def test_long_vectors_in_small_parts(spark):
    """Blocks and slices of a few rows each give the same result."""
    rng = np.random.default_rng(13)
    rows = [(i, i % 3, rng.normal(size=6000).round(3).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert hardneg.VALUES // 6000 > 40 > hardneg.VALUES // 126000
    got = [tuple(r) for r in hardneg.mine(df, df.vec_id % 10 == 0).collect()]
    wide = df.selectExpr("vec_id", "label", "concat(embedding, array_repeat(0f, 120000)) AS embedding")
    assert sorted(map(tuple, hardneg.mine(wide, wide.vec_id % 10 == 0).collect())) == sorted(got) and got


def test_windows_of_a_larger_table_fill_below_the_sample(spark):
    vectors = table(spark, "/root/testdata/check_s", "embeddings")           # more rows than the sample
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/check_s/embeddings.parquet/*.parquet')")
    assert vectors.count() > hardneg.SAMPLE
    got = sorted(map(tuple, hardneg.op12_hard_negatives(spark, "/root/testdata/check_s").collect()))
    assert got == sorted(con.execute(hardneg.SQL).fetchall())


# ---------------------------------------------------------- Merkle manifest
def brute_manifest(rows):
    sha = lambda *p: hashlib.sha256("".join(p).encode()).hexdigest()
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def climb(levels, at, digest):
        proof = ""
        for row in levels[:-1]:
            run = row[at // 2 * 2:at // 2 * 2 + 2]
            proof += "".join(d for k, d in enumerate(run) if k != at % 2)
            run[at % 2] = digest
            digest, at = sha(*run), at // 2
        return proof, digest
    by = {}
    for doc_id, text, lang, source, n, *_ in rows:
        fields = lambda m: sha(*map(one, (doc_id, source, lang, m, text)))  # noqa: B023,E731
        hit = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        by.setdefault(lang, []).append((doc_id is not None, doc_id or 0, fields(n), fields(n + 1) if hit else fields(n), doc_id))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: tree([r[2] for r in sorted(by[v])]) for v in langs}
    crown = tree([trees[v][-1][0] for v in langs])
    out = []
    for k, v in enumerate(langs):
        for at, (_, _, leaf, found, doc_id) in enumerate(sorted(by[v])):
            low, digest = climb(trees[v], at, found)
            high, digest = climb(crown, k, digest)
            out.append((doc_id, leaf, trees[v][-1][0], crown[-1][0], sha(low, high), digest, digest == crown[-1][0]))
    return sorted(out, key=str)


def changed(docs):
    from pyspark.sql import functions as F
    hit = F.crc32(docs.doc_id.cast("string").cast("binary")) % 7 == 0
    return F.when(hit & docs.n_chars.isNotNull(), merkle.leaf(merkle.FIELDS, {"n_chars": F.col("n_chars") + 1}))


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest_edge_rows(spark, levels):
    rows = ROWS + [(100 + i, f"text {i}", ["en", "", "=", "ü", "z"][i % 5], None, i, None, None) for i in range(60)] + [(999, "x", "lone", "s", 1, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"h": "grp", "size": "idx"})
    got = merkle.manifest(docs, tampered=changed(docs), levels=levels)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == brute_manifest([tuple(r) for r in docs.collect()])
    assert {r[-1] for r in rows} == {True, False}


def test_manifest_of_nothing_and_of_one_row(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert merkle.manifest(docs.limit(0)).collect() == []
    one = merkle.manifest(docs.where("doc_id = 2")).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"]
    assert one["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_fold_resumes_the_state_before_a_slot():
    p = merkle.Parent(["a" * 64, "b" * 64, "c" * 64])
    for slot in range(3):
        assert p.fold(slot, p.children[slot]) == p.digest
        other = [*p.children]
        other[slot] = "d" * 64
        assert p.fold(slot, "d" * 64) == merkle.Parent(other).digest
