"""Language identification by Bayesian evidence fusion.

Text likelihoods come from hashed byte trigrams, counted over all documents that
declare a language (grouped counts, one pass).  They are fused with the declared
markup language, and with a prior of the host that is smoothed hierarchically:
host towards registered domain towards address suffix towards the whole table.
Priors and the reliability of declarations are grouped sums of the text
posteriors over all rows, each row judged without its own share.  ``und`` stands
for text that no language explains better than random trigrams.

A row is rejected if its text has no letters, if ``und`` wins, or if the best
posterior is below ``LEAST``.

Defined results: null and empty texts and texts without letters are ``und`` and
rejected; a null or empty declaration is no evidence; null hosts are one host;
every label but ``und`` that a document bears is a language, however few bear it;
without any labelled document everything is ``und``; repeated rows are judged
alike but for their own share; a null id stays null; an empty table gives no rows;
other columns are ignored by ``identify`` and kept by ``keep_languages``.

The model keeps of each language only the trigrams it has, so a rare language is
a small one.  Counts are held for ``BLOCK`` languages at a time and scores for
``CELLS`` rows x languages; the work grows with the rows times the languages.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatekit.llm.common import Scratch, drop_ids, free_name, row_key, ship_package, table

BITS = 14               # hash bits of a trigram
SMOOTH = 0.5
TEMPER = 0.25           # weight of a trigram's log likelihood: trigrams overlap
UNKNOWN = 0.01          # prior of und
PULL = 20.0             # rows that a parent's prior is worth
DECLARED_PULL = 5.0
LEAST = 0.5
CHUNK = 2 << 20         # bytes scored together
BLOCK = 128             # languages counted together
CELLS = 1 << 20         # rows x languages scored together

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed trigram): A-Z folded, what is not a letter is one
    space; trigrams do not cross texts."""
    size = np.array([len(t) + 2 for t in texts], np.int64)
    arr = _FOLD[np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    keep = np.ones(len(arr), bool)
    keep[1:] = (arr[1:] != 32) | (arr[:-1] != 32) | (doc[1:] != doc[:-1])
    arr, doc = arr[keep].astype(np.uint32), doc[keep]
    code = (arr[:-2] << np.uint32(16) | arr[1:-1] << np.uint32(8) | arr[2:]) * np.uint32(0x9E3779B1)
    inside = doc[:-2] == doc[2:]
    return doc[:-2][inside], (code[inside] >> np.uint32(32 - BITS)).astype(np.int32)


def _chunks(batch: pa.RecordBatch, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    size = pc.binary_length(batch.column("body")).fill_null(0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(size) // CHUNK
    for c in np.unique(cut):
        a, b = np.searchsorted(cut, [c, c + 1])
        for i in range(a, b, rows):
            yield batch.slice(i, min(rows, b - i))


def _count(langs: list[str]):
    def flush(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        code = [np.flatnonzero(x) for x in total.values()]
        lang = np.repeat(np.array([*total], np.int32), [len(c) for c in code])
        return pa.RecordBatch.from_arrays(
            [pa.array(lang), pa.array(np.concatenate(code).astype(np.int32)),
             pa.array(np.concatenate([x[c] for x, c in zip(total.values(), code)]))], names=["lang", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        at = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            for part in _chunks(batch):
                lab = np.array([at[x] for x in part.column("lang").to_pylist()], np.int64)
                doc, code = trigrams([t or b"" for t in part.column("body").to_pylist()])
                some, lab = np.unique(lab, return_inverse=True)
                lab = lab[doc]
                for k in range(0, len(some), BLOCK):
                    block = some[k:k + BLOCK]
                    own = slice(None) if len(some) <= BLOCK else (lab >= k) & (lab < k + BLOCK)
                    new = np.bincount(lab[own] - k << BITS | code[own], minlength=len(block) << BITS)
                    if len(total.keys() | {*block.tolist()}) > BLOCK and total:
                        yield flush(total)
                        total = {}
                    for x, c in zip(block.tolist(), new.reshape(len(block), -1)):
                        total[x] = total[x] + c if x in total else c.copy()
        if total:
            yield flush(total)
    return run


Model = list[tuple[float, np.ndarray, np.ndarray]]     # of each language: log likelihood of
#                                                        other trigrams, its trigrams, theirs


def train(labelled: DataFrame) -> tuple[list[str], Model]:
    """Languages (sorted, then ``und``) and their log likelihoods of trigrams;
    ``labelled`` has body and lang."""
    ship_package(labelled.sparkSession)
    labelled = labelled.where("lang IS NOT NULL AND lang <> '' AND lang <> 'und'")
    langs = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    codes, counts = [array("i") for _ in langs], [array("q") for _ in langs]
    rows = labelled.select("body", "lang").mapInArrow(
        _count(langs), "lang int, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    for r in rows.toLocalIterator():        # at most the distinct trigrams of each language
        codes[r["lang"]].append(r["code"])
        counts[r["lang"]].append(r["n"])
    model = []
    for code, count in zip(codes, counts):
        n = np.array(count, np.float64)
        whole = np.log(n.sum() + SMOOTH * (1 << BITS))
        model.append((np.log(SMOOTH) - whole, np.array(code, np.int32), np.log(n + SMOOTH) - whole))
    return [*langs, "und"], [*model, (-BITS * np.log(2), np.zeros(0, np.int32), np.zeros(0))]


def _dense(model: Model) -> Iterator[np.ndarray]:
    """The log likelihood of every trigram, language by language."""
    for other, code, logp in model:
        out = np.full(1 << BITS, other)
        out[code] = logp
        yield out


def _likelihood(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = model.value
        for batch in batches:
            for part in _chunks(batch, max(1, CELLS // len(logp))):
                n = part.num_rows
                doc, code = trigrams([t or b"" for t in part.column("body").to_pylist()])
                ll = np.stack([np.bincount(doc, weights=p[code], minlength=n) for p in _dense(logp)], axis=1) * TEMPER
                num = np.bincount(doc, minlength=n)
                prior = np.full(len(logp), np.log((1 - UNKNOWN) / max(1, len(logp) - 1)))
                prior[-1] = np.log(UNKNOWN)
                post = np.exp(ll - ll.max(axis=1, keepdims=True) + prior)
                post /= post.sum(axis=1, keepdims=True)
                ends = np.arange(n + 1, dtype=np.int32) * len(logp)
                cols = {c: part.column(c) for c in part.schema.names if c != "body"}
                cols["n_trigrams"] = pa.array(num.astype(np.int64))
                cols["ll"] = pa.ListArray.from_arrays(ends, (ll - ll.max(axis=1, keepdims=True)).ravel())
                cols["p"] = pa.ListArray.from_arrays(ends, np.round(post, 9).ravel())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def domain_of(host: Column) -> Column:
    """Last two labels of a host name."""
    return F.array_join(F.slice(F.split(host, r"\."), F.greatest(
        F.lit(1), F.size(F.split(host, r"\.")) - 1), 2), ".")


def identify(rows: DataFrame, langs: list[str], logp: Model) -> DataFrame:
    """One row per row of ``rows`` (id, body, declared, host, suffix): id,
    declared, host, text_lang, lang, posterior, accepted."""
    spark = rows.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "langid")
    n = len(langs)
    src = rows.select(
        "id", "body", F.lower(F.when(F.col("declared") != "", F.col("declared"))).alias("declared"),
        F.lower(F.coalesce("host", F.lit(""))).alias("host"), F.lower(F.coalesce("suffix", F.lit(""))).alias("suffix"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = scratch.write(src.mapInArrow(
        _likelihood(spark.sparkContext.broadcast(logp)),
        f"id {kind}, declared string, host string, suffix string, n_trigrams long, ll array<double>, "
        "p array<double>"), "scored").withColumn("domain", domain_of(F.col("host")))
    full = scored.where("n_trigrams > 0")

    def sums(*by: str) -> DataFrame:
        """Sum of text posteriors and rows of each group, rounded so that the
        order of addition does not show."""
        each = full.select(*by, F.posexplode(F.concat(F.array(F.lit(1.0)), "p")).alias("at", "v")).where("v > 0")
        each = each.groupBy(*by, "at").agg(F.round(F.sum("v"), 6).alias("v"))
        got = each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
        return got.select(
            *by, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("c"),
            F.try_element_at("m", F.lit(0)).cast("long").alias("n"))

    def pulled(c: Column, m: Column, parent: Column, pull: float) -> Column:
        return F.zip_with(c, parent, lambda x, q: (F.greatest(x, F.lit(0.0)) + F.lit(pull) * q) / (m + F.lit(pull)))

    whole = sums().first()
    total = max(float(whole["n"] or 0), 1.0)
    base = [(float(x or 0.0) + 1.0 / n) / (total + 1.0) for x in (whole["c"] or [0.0] * n)]
    glob = F.array(*[F.lit(x) for x in base])
    suf = sums("suffix").select("suffix", pulled(F.col("c"), F.col("n"), glob, PULL).alias("qs"))
    dom = sums("domain", "suffix").join(suf, "suffix").select(
        "domain", "suffix", pulled(F.col("c"), F.col("n"), F.col("qs"), PULL).alias("qd"))
    hst = scratch.write(sums("host", "domain", "suffix").join(dom, ["domain", "suffix"]).select(
        "host", "suffix", F.col("c").alias("hc"), F.col("n").alias("hn"), "qd"), "hosts")
    dec = scratch.write(sums("declared").where("declared IS NOT NULL").select(
        "declared", F.col("c").alias("dc"), F.col("n").alias("dn")), "declared")

    j = full.join(hst, ["host", "suffix"]).join(dec, "declared", "left")
    own = F.zip_with("hc", "p", lambda x, q: x - q)                # without the row itself
    prior = pulled(own, F.col("hn") - 1, F.col("qd"), PULL)
    share = (F.col("dn") - 1 + 1e-3) / F.lit(total)
    said = F.zip_with(F.zip_with("dc", "p", lambda x, q: F.greatest(x - q, F.lit(0.0))),
                      F.array(*[F.lit(x * total) for x in base]),
                      lambda x, m: (x + F.lit(DECLARED_PULL) * share) / (m + F.lit(DECLARED_PULL)))
    said = F.coalesce(said, F.array_repeat(F.lit(1.0), n))
    raw = F.zip_with(F.zip_with("ll", prior, lambda x, q: x + F.log(F.greatest(q, F.lit(1e-12)))), said,
                     lambda x, q: x + F.log(F.greatest(q, F.lit(1e-12))))
    j = j.withColumn("raw", raw).withColumn("top", F.array_max("raw"))
    j = j.withColumn("all", F.aggregate("raw", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    cols = ["id", "declared", "host", "text_lang", "lang", "posterior", "accepted"]
    known = j.select("id", "declared", "host", best(F.col("p")).alias("text_lang"), best(F.col("raw")).alias("lang"),
                     F.round(F.lit(1.0) / F.col("all"), 6).alias("posterior"))
    known = known.withColumn("accepted", (F.col("lang") != "und") & (F.col("posterior") >= LEAST))
    none = scored.where("n_trigrams = 0").select(
        "id", "declared", "host", F.lit("und").alias("text_lang"), F.lit("und").alias("lang"),
        F.lit(1.0).alias("posterior"), F.lit(False).alias("accepted"))
    return known.select(*cols).unionByName(none.select(*cols))


def document_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents as evidence: their source is the host, lang the declaration."""
    return docs.select(F.col(id_col).alias("id"), F.col("text").cast("binary").alias("body"),
                       F.col("lang").alias("declared"), F.col("source").alias("host"),
                       F.lit("").alias("suffix"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as evidence: text between tags, the html element's language, the
    host and the last label of the address."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.select(
        F.col("page_id").alias("id"), text.cast("binary").alias("body"),
        F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1).alias("declared"),
        host.alias("host"), F.element_at(F.split(host, r"\."), -1).alias("suffix"))


def labelled(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("body"), F.lower("lang").alias("lang"))


def keep_languages(docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted."""
    k = free_name(docs, "_k")
    keyed = docs.withColumn(k, row_key("doc_id", "text", "lang", "source"))
    found = identify(document_rows(keyed, k), *train(labelled(docs)))
    bad = Scratch(docs.sparkSession, "rejected").write(found.where(~F.col("accepted")).select(
        F.col("id").alias(k)), "ids")
    return drop_ids(keyed, bad, k).drop(k)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(document_rows(docs), *train(labelled(docs))).withColumnRenamed("id", "doc_id")


def page_language_id(spark, sf_dir: str) -> DataFrame:
    """The same for raw pages, with markup, address suffix and hosts."""
    return identify(page_rows(table(spark, sf_dir, "pages")),
                    *train(labelled(table(spark, sf_dir, "documents")))).withColumnRenamed("id", "page_id")
