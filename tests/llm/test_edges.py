"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns with clashing names, for every operator; parts of the methods alone."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slatekit.llm import (crf, decontam, fingerprint, fmindex, langid, licenses, mixing, neardup, pii, secret_scan,
                          sharding)
from tests.conftest import SF_SMALL

LONG = "the of and word number nine " * 4000
ROWS = [(1, "The first text of all, said and done.", "en", "s", 1, "h", "n"), (1, "The first text of all, said and done.", "en", "s", 1, "h", "n"),
        (2, None, None, None, None, None, None), (3, "", "en", "s", 0, "", ""), (4, " \t\n", "en", "t", 3, "h", "n"),
        (5, LONG, "en", "s", len(LONG), "h", "n"), (6, LONG, "en", None, len(LONG), "h", "n"),
        (None, "The first text of all, said and done.", "en", "s", 1, "h", "n"), (7, "other words under the mit license here", "de", "t", 5, "h", "n"),
        (7, "the same id and another text altogether", "de", "t", 5, "h", "n")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size string"
BENCH = "item_id long, text string"


def label(docs):
    return langid.identify(langid.document_rows(docs), *langid.train(langid.labelled(docs)))


def bench(spark):
    return spark.createDataFrame([(1, "other words under the mit"), (2, None), (3, "..."), (3, "and another text"), (None, "text of all")], BENCH)


OPERATORS = {
    "near": neardup.near_duplicates, "language": label, "shard": sharding.shard, "mix": mixing.mix,
    "secrets": secret_scan.scan, "pii": pii.scan, "fingerprints": fingerprint.successor_pairs, "licenses": licenses.scan,
    "decontamination": lambda d: decontam.digest_columns(decontam.scan(d, bench(d.sparkSession)))}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_table(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = OPERATORS[name](docs).collect()
    assert len(got) == len(ROWS)
    assert OPERATORS[name](docs.limit(0)).collect() == []
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    if name == "near":
        assert {r["component_id"] for r in by[5] + by[6]} == {5} and by[None][0]["component_id"] is None
        assert by[2][0]["n_shingles"] == by[3][0]["n_shingles"] == by[4][0]["n_shingles"] == 0
        assert all(by[d][0]["kept"] for d in (2, 3, 4)) and not by[6][0]["kept"] and by[1][1]["kept"]
    if name == "language":
        assert not any(r["accepted"] for d in (2, 3, 4) for r in by[d])
    if name == "shard":
        assert by[2][0]["size"] == 8 and by[2][0]["text_crc32"] == 0 and by[5][0]["shard"] == by[6][0]["shard"]
    if name == "mix":
        assert by[2][0]["size"] == 0 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    if name == "licenses":
        assert sorted(r["base_labels"] for r in by[7]) == ["", "mit"]
    if name == "decontamination":
        assert by[2][0]["n_words"] == 0 and sorted(r["n_hit"] for r in by[7]) == [3, 5]
        assert by[1][0]["n_hit"] == 3 and by[1][0]["n_items"] == 0        # the item has no id


def test_many_benchmark_blocks_agree(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    one = decontam.scan(docs, bench(spark))
    many = decontam.scan(docs, bench(spark), block_words=3)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_pipeline_stages(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = corpus_pipeline.language_id(spark, docs, SF_SMALL)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 5, 6, 7, None}
    one = corpus_pipeline.near_dedup(spark, docs, SF_SMALL)
    ids = [r["doc_id"] for r in one.collect()]
    assert one.columns == docs.columns and sorted(i for i in ids if i) == [1, 2, 3, 4, 5, 7] and None in ids
    mixed = corpus_pipeline.mix_sources(spark, docs, SF_SMALL)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert corpus_pipeline.shard_mix(spark, docs.limit(0), SF_SMALL).collect() == []


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert {r["doc_id"] for r in out} <= {*docs} and {r["shard"] for r in out} <= {*range(24)}
    items = [decontam.words_of(r["text"].encode()) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 10]) for w in items for i in range(len(w) - 9)}
    for r in out:
        w = decontam.words_of(docs[r["doc_id"]].encode())
        assert not any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9))


def test_fm_index_against_scan():
    rng = np.random.default_rng(1)
    for sigma in (1, 3, 40):
        text = rng.integers(0, sigma + 1, 600)
        text[-1] = 0
        text[100:130], text[300:330] = 1, 1
        index = fmindex.FMIndex(text, sigma)
        for m in (1, 2, 5):
            pats = rng.integers(1, sigma + 1, (40, m))
            lo, hi = index.search(pats)
            for p, a, b in zip(pats, lo, hi):
                want = [i for i in range(len(text) - m + 1) if (text[i:i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for n in (1, 4, 6):
        model = crf.CRF(np.zeros((1, 3)), rng.normal(size=(3, 3)))
        e = rng.normal(size=(2 * n, 3)) * 2
        e[::3, 2] += 30                       # leads that end a stretch
        chain = np.repeat([0, 1], n)
        got = crf.viterbi(model, e, chain)
        for c in (0, 1):
            own = e[chain == c]
            score = lambda p: sum(own[i, y] for i, y in enumerate(p)) + sum(model.move[a, b] for a, b in zip(p, p[1:]))  # noqa: E731,B023
            assert tuple(got[chain == c]) == max(itertools.product(range(3), repeat=n), key=score)


def test_training_windows_from_the_whole_file(spark):
    text = "plain words here password = hunter2a\n" * secret_scan.SPANS + f"more words {'0a1b' * 10} here\n" * 200
    cut = secret_scan.cut_windows(text.encode())
    assert len(cut) == secret_scan.SPANS and all(len(w) <= 2 * secret_scan.WINDOW + 1 for w, _ in cut)
    assert any(w[y == crf.BEGIN][:, 5].any() for w, y in cut)        # a long one, behind the first SPANS
    docs = spark.createDataFrame([(1, text), (2, None), (3, "plain words only in this file")], "doc_id long, text string")
    got = secret_scan.training_windows(docs)
    assert len(got) == secret_scan.SPANS + secret_scan.PLAIN
    want = cut + secret_scan.cut_windows(b"plain words only in this file")
    assert sorted((a.tobytes(), b.tobytes()) for a, b in got) == sorted((a.tobytes(), b.tobytes()) for a, b in want)


def test_spans_apart_from_others():
    rng = np.random.default_rng(9)
    for _ in range(200):
        extra = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 60, 6), rng.integers(1, 12, 6))]
        base = sorted((int(a), 0, int(a + n)) for a, n in zip(rng.integers(0, 60, 5), rng.integers(1, 30, 5)))
        assert secret_scan.apart(extra, base) == [(a, b) for a, b in extra if not any(a < y and x < b for x, _, y in base)]
    assert secret_scan.apart([(1, 2)], []) == [(1, 2)] and secret_scan.apart([], [(1, 0, 2)]) == []


def test_crf_learns_neighbouring_words():
    """A word that no list holds announces the secrets: only its weights tell."""
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("aeinrst"), rng.integers(3, 8)))
    code = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) + str(rng.integers(0, 10))
    line = lambda before: " ".join([*[word() for _ in range(12)], before, code(), *[word() for _ in range(12)]])
    files = [line("zugangscode").encode() for _ in range(60)] + [line(word()).encode() for _ in range(60)]
    cut = []
    for k, text in enumerate(files):
        _, _, _, f = secret_scan.tokens([text])
        y = np.full(len(f), crf.OUTSIDE, np.int8)
        if k < 60:
            y[13] = crf.BEGIN
        cut.append((f, y))
    x, y = np.array([f for f, _ in cut]), np.array([v for _, v in cut], np.int64)
    model = crf.train(x, y, np.full(len(cut), 26), words=secret_scan.WORDS, buckets=secret_scan.BUCKETS)
    new = [line("zugangscode").encode() for _ in range(20)] + [line(word()).encode() for _ in range(20)]
    got = [len(s) for s in secret_scan.tagged(model, new)]
    assert sum(got[:20]) >= 18 and sum(got[20:]) <= 1


def test_crf_finds_held_out_and_unlisted_secrets():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeinrst"), rng.integers(2, 9)))
    code = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    clean = [" ".join(word() for _ in range(60)) for _ in range(60)]
    secret = [" ".join([*[word() for _ in range(20)], f'token = "{code()}"', *[word() for _ in range(20)]]) for _ in range(60)]
    model = secret_scan.fit([t.encode() for t in clean[:30] + secret[:30]])
    unlisted = [t.replace('token = "', 'pwd = "').upper() for t in secret[30:]]      # no base pattern matches
    assert not any(secret_scan.base_spans(t.encode()) for t in unlisted)
    hit = sum(bool(s) for s in secret_scan.tagged(model, [t.encode() for t in unlisted]))
    false = sum(bool(s) for s in secret_scan.tagged(model, [t.encode() for t in clean[30:]]))
    assert hit >= 27 and false == 0
    assert secret_scan.fit([b"nothing here"]) is None


CLASHING = ["_b", "_B_", "_at", "_k", "_whole", "_rest", "_n", "_cut", "_row", "_text", "_piece", "_p", "same", "h2",
            "kept", "component_id", "id", "grp", "n_words", "spans", "key", "cum", "a.b"]


def test_stages_keep_clashing_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    more = docs.select("*", *[F.concat_ws("-", F.lit(c), F.col("doc_id")).alias(c) for c in CLASHING])
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "near_dedup", "decontamination", "mixing"):
        plain = sorted(map(tuple, stages[name](spark, docs, SF_SMALL).collect()), key=str)
        out = stages[name](spark, more, SF_SMALL)
        assert out.columns == more.columns
        rows = sorted((tuple(r) for r in out.collect()), key=str)
        assert sorted((r[:len(docs.columns)] for r in rows), key=str) == plain, name
        assert all(r[len(docs.columns):] == tuple(c if r[0] is None else f"{c}-{r[0]}" for c in CLASHING) for r in rows)
    assert len(corpus_pipeline.shard_mix(spark, more, SF_SMALL).collect()) == len(ROWS)
