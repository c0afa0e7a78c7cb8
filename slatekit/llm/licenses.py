"""License scans by a positional index of rare tokens, in SQL functions only.

Templates are short license notices and texts, and the base phrases.  The words of
all templates are weighed by their document frequency over the whole table
(inverse document frequency); each template is indexed under its ``RARE``
highest-IDF words (a base phrase under ``RARE_BASE``) with their positions.

A file first looks up which indexed words it has: only files that have
``LEAST`` of some template's weight go on (all of it for a base phrase), and of
copies one.  Every hit of such a text then votes for the relative position of text
and template.  An alignment that gathers ``LEAST`` of the weight names the license
if the template's mandatory key phrase stands in the text; one of a base phrase
counts if the phrase stands there word by word.

Texts are split into words once, those that go on a second time.

Defined results: null and empty texts have no words and no label, score 0; equal
texts are judged alike; a null doc_id stays null; alignments of a template count
once for its label, the highest score is given; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatekit.llm.common import Scratch, ascii_lower, bucket, in_buckets, table

RARE, RARE_BASE = 4, 2
LEAST = 0.75
SALTS = 16               # parts of the rows of one text that has a license

# FIXED VALUES: words end at ASCII other than letters and digits.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# FIXED VALUES: base phrases and labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Templates of the method: label, mandatory key phrase, text.
TEMPLATES = (
    ("agpl-3", "gnu affero general public license",
     "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2", "apache license", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "gnu general public license",
     "this work is licensed under the gnu general public license version 3"),
    ("isc", "for any purpose with or without fee",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted"),
    ("lgpl", "gnu lesser general public license",
     "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction"),
    ("mpl-2", "mozilla public license",
     "subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("unlicense", "free and unencumbered software",
     "this is free and unencumbered software released into the public domain"),
)


def words_col(text: str | Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


# Every indexed template: its words and how many of them are looked up.
ENTRIES = tuple((text.split(), RARE) for _, _, text in TEMPLATES) + tuple((p.split(), RARE_BASE) for p, _ in BASE)
INDEX = ("word", "entry", "at", "idf", "full")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_words(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def rare_index(files: DataFrame) -> list[tuple[str, int, int, float, float]]:
    """(word, entry, at, idf, full): each entry's highest-IDF words with their
    positions; ``full`` is the weight of an exact occurrence.  ``files`` has the
    distinct template words of each file (``present``)."""
    n = files.count()
    counts = files.select(F.explode("present").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    df = {r["word"]: r["df"] for r in counts.collect()}           # at most one row per template word
    rows = []
    for e, (seq, most) in enumerate(ENTRIES):
        weight = {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) + 1e-6 for w in seq}
        rare = sorted(weight, key=lambda w: (-weight[w], w))[:most]
        full = sum(weight[w] for w in seq if w in rare)
        rows += [(w, e, i, weight[w], full) for i, w in enumerate(seq) if w in rare]
    return rows


def least(entry: int) -> float:
    """The share of its weight that an entry needs."""
    return LEAST if entry < len(TEMPLATES) else 1 - 1e-9


def candidates(index: list[tuple], present: Column) -> Column:
    """The entries that a file with these words may hold."""
    out = []
    for e in range(len(ENTRIES)):
        own = [r for r in index if r[1] == e]
        got = sum((F.when(F.array_contains(present, w), F.lit(idf)).otherwise(0.0) for w, _, _, idf, _ in own), F.lit(0.0))
        out.append(F.when(got >= least(e) * own[0][4] - 1e-9, F.lit(e)))
    return F.array_compact(F.array(*out))


def alignments(texts: DataFrame, index: list[tuple]) -> DataFrame:
    """(key, al): the alignments (entry, off, score) of each text (key, words,
    entries), by votes of the looked-up words for relative positions."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(INDEX, r)]) for r in index])
    table_ = texts.sparkSession.range(1).select(F.inline(rows))       # a few rows for each entry
    hits = (texts.select("key", "entries", F.posexplode("words").alias("p", "word")).join(F.broadcast(table_), "word")
            .where(F.array_contains("entries", F.col("entry"))))
    votes = hits.groupBy("key", "entry", (F.col("p") - F.col("at")).alias("off")).agg(
        (F.sum("idf") / F.first("full")).alias("share"))
    need = F.when(F.col("entry") < len(TEMPLATES), F.lit(LEAST)).otherwise(F.lit(least(len(TEMPLATES))))
    score = F.least(F.lit(1.0), F.round("share", 6))
    return votes.where(score >= need).groupBy("key").agg(
        F.collect_list(F.struct("entry", "off", score.alias("score"))).alias("al"))


def judged(words: Column, al: Column) -> Column:
    """A text's labels by the method, their score, and the starts of each base
    phrase: alignments whose key phrase, or whole phrase, is there."""
    labels, keys = literal_words([x for x, _, _ in TEMPLATES]), literal_words([f" {k} " for _, k, _ in TEMPLATES])
    z = F.struct(words.alias("w"), al.alias("al"),
                 F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("norm"))

    def of(z: Column) -> Column:
        named = F.filter(z["al"], lambda x: (x["entry"] < len(TEMPLATES)) & F.contains(z["norm"], F.get(keys, x["entry"])))

        def places(i: int) -> Column:
            seq = BASE[i][0].split()
            here = F.filter(z["al"], lambda x: (x["entry"] == len(TEMPLATES) + i) & (x["off"] >= 0) & (
                F.slice(z["w"], F.greatest(x["off"], F.lit(0)) + 1, F.lit(len(seq))) == literal_words(seq)))
            return F.transform(here, lambda x: x["off"])
        return F.struct(F.transform(named, lambda x: F.get(labels, x["entry"])).alias("more"),
                        F.array_max(F.transform(named, lambda x: x["score"])).alias("score"),
                        *[places(i).alias(f"s{i}") for i in range(len(BASE))])
    return let(z, of)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score."""
    scratch = Scratch(docs.sparkSession, "licenses")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(text.cast("binary")).alias("key")
    known = literal_words(sorted({w for seq, _ in ENTRIES for w in seq}))
    files = scratch.write(docs.select(F.col(id_col).alias("doc_id"), key, words_col(text).alias("words")).select(
        "doc_id", "key", F.size("words").cast("long").alias("n_words"),
        F.array_intersect("words", known).alias("present")), "files")
    index = rare_index(files)
    cand = scratch.write(files.select("key", candidates(index, F.col("present")).alias("entries"))
                         .where(F.size("entries") > 0).dropDuplicates(["key"]), "candidates")

    # one text of each candidate: copies are combined before they are moved
    some = docs.select(key, text.alias("text")).withColumn("_b", bucket("key"))
    some = some.join(F.broadcast(in_buckets(cand, "key")), "_b", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    texts = scratch.write(some.join(cand, "key").select("key", "entries", words_col("text").alias("words")), "texts")
    found = texts.join(alignments(texts, index), "key").select("key", judged(F.col("words"), F.col("al")).alias("j"))
    found = scratch.write(found.select("key", "j.*"), "found")

    # rows of texts without a license pass without a shuffle, the others are salted
    tagged = files.drop("present").withColumn("_b", bucket("key"))
    marks = F.broadcast(in_buckets(found, "key"))
    salted = tagged.join(marks, "_b", "left_semi").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    none = [F.array().cast("array<string>").alias("more"), F.lit(None).cast("double").alias("score"),
            *[F.array().cast("array<int>").alias(f"s{i}") for i in range(len(BASE))]]
    cols = ["doc_id", "n_words", "more", "score", *[f"s{i}" for i in range(len(BASE))]]
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    out = tagged.join(marks, "_b", "left_anti").select("doc_id", "n_words", *none).unionByName(
        salted.join(spread, ["key", "salt"], "left").select(*cols).select(
            "doc_id", "n_words", empty("more", "array<string>"), "score",
            *[empty(f"s{i}", "array<int>") for i in range(len(BASE))]))
    starts = F.concat(*[f"s{i}" for i in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"s{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, "more")).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
