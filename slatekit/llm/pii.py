"""PII by bootstrapped contextual extraction, in SQL functions only.

Base patterns give the seed entities.  Instances are the tokens that hold a digit
or ``@``, and the runs of several tokens of digits (cards and phones with
spaces).  An instance's lexical patterns are the word before it, the two words
before it, the word after it, its shape (letters and digits collapsed) and its
form (an address, a dotted quad, so many digits).  Patterns and instances form a
graph.  Instances that hold a whole base match are seeds (1.0); tokens that are a
part of one are not instances.  Each round scores a
pattern by the mean score of its distinct instances, shrunk towards 0 by
``SHRINK`` instances, and an instance by the mean score of its patterns; seeds
keep 1.0.  After ``ROUNDS`` rounds, patterns of at least ``TRUST`` that at least
``SUPPORT`` seeds confirm are trusted, and an unseen instance is an identifier
where its shape or form and one of its neighbourhoods are trusted; of these, one
that lies inside another is left to it.

Edges are counted before they are joined (distinct pattern-instance pairs), so
frequent words cost one row per distinct pair, and joins on a pattern are salted
by the instance, as a few forms hold most instances.  Those joins are shuffled: a
table of patterns of a few megabytes, as the planner measures it, is many times that
with its salts, and the driver would hold it whole.  Positions are summed in
blocks of ``BLOCK`` matches, so the work follows the length of a text.

Defined results: null and empty texts have no span; a neighbour at a text's end
is the empty word; spans of the method that touch a base span are not repeated;
rows that share doc_id and text are judged alike; a null doc_id stays null; ties
cannot arise (patterns are trusted by value); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatekit.llm.common import Scratch, ascii_lower, shuffled_joins, table

ROUNDS = 3
SHRINK = 1.0
TRUST = 0.75
SUPPORT = 3
BLOCK = 256              # matches whose positions are summed together
SPAN = 4096              # code points of a piece in which base spans are looked up
SALTS = 16

KINDS = ("email", "ip", "card", "phone")
# FIXED VALUES: the base patterns, written so that no start is tried twice: a
# run of local-part characters is tried from its start (or from the end of the
# match before it), and repeated parts give nothing back.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@"
         r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
RUN = (r"(?<!\S)[+(]?[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+)+"
       r"(?=[\"')\]}>,;:!?]*(?:\s|$))")               # several tokens of digits
LAST_TWO = r"(?<!\S)(\S++\s++\S++)\s*+$"
LAST, FIRST = r"(?<!\S)(\S++)\s*+$", r"^\s*+(\S++)"       # words of the text between tokens

EMPTY = "array<struct<s:int,e:int,m:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(sizes: Column) -> Column:
    """(s, e, m) of each (g, n, m): a gap of g code points, then a match m of n.
    Lengths are summed inside blocks, then block by block."""
    def inside(block: Column) -> Column:
        return F.aggregate(
            block, F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("out")),
            lambda acc, z: F.struct(
                (acc["at"] + z["g"] + z["n"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + z["g"]).alias("s"), (acc["at"] + z["g"] + z["n"]).alias("e"),
                    z["m"].alias("m")))).alias("out")))

    def shifted(blocks: Column) -> Column:
        starts = F.aggregate(
            blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"),
                                    F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda x, at: F.transform(x["out"], lambda y: F.struct(
            (y["s"] + at).alias("s"), (y["e"] + at).alias("e"), y["m"].alias("m")))))

    last = F.floor((F.greatest(F.size(sizes), F.lit(1)) - 1) / BLOCK).cast("int")
    return let(F.transform(F.sequence(F.lit(0), last), lambda b: inside(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))), shifted)


def matches(text: Column, pattern: str, when: Column) -> Column:
    """(s, e, m) of the leftmost non-overlapping matches, code points: the text
    between matches and the matches themselves give the positions."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(gaps, m, lambda g, x: F.struct(F.length(g).alias("g"), F.length(x).alias("n"), x.alias("m")))
    whole = let(F.filter(sizes, lambda z: z["m"].isNotNull()), positions)
    return F.when(when, whole).otherwise(F.array().cast(EMPTY))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(num: Column) -> Column:
    """Every second digit from the right doubled; digit sums divide by ten."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(num)), F.lit(0),
        lambda acc, i: acc + F.when(
            (F.length(num) - i) % 2 == 1,
            F.lit(2) * digit(num, i) - F.when(digit(num, i) > 4, 9).otherwise(0)).otherwise(digit(num, i)))
    return total % 10 == 0


def digit(num: Column, i: Column) -> Column:
    return F.ascii(F.substring(num, i, F.lit(1))) - 48


def ip_parts(m: Column) -> Column:
    """Every part at most 255, whatever zeros lead it."""
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | (
        (F.length(part(p)) == 3) & (part(p) <= "255")))


def base_matches(text: Column) -> list[Column]:
    """Spans of each kind in KINDS."""
    email = matches(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]"))), lambda x: ip_parts(x["m"]))
    card = F.filter(
        F.filter(matches(text, CARD, F.rlike(text, F.lit(r"(?:[0-9][\x20-]?){15}[0-9]"))),
                 lambda x: F.length(digits(x["m"])).between(16, 19)),
        lambda x: luhn(digits(x["m"])))
    phone = F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))),
                     lambda x: F.length(digits(x["m"])).between(8, 15))
    return [email, ip, card, phone]


def shape(token: Column) -> Column:
    """Letters and digits collapsed: a run of digits keeps its length."""
    t = F.regexp_replace(token, "[a-z]+", "a")
    t = F.regexp_replace(t, "[A-Z]+", "A")
    t = F.regexp_replace(t, r"[^\x00-\x7F]+", "u")
    return F.regexp_replace(t, "[0-9]", "9")


def form(token: Column) -> Column:
    """What kind of identifier the token could be, however it is written."""
    n = F.length(digits(token))
    return (F.when(F.contains(token, F.lit("@")), F.lit("at"))
            .when(F.rlike(token, F.lit(r"^[0-9]+(?:\.[0-9]+){3}$")), F.lit("quad"))
            .when(F.rlike(token, F.lit(r"^[+(]*[0-9][0-9\x20().-]*$")),
                  F.when(n < 8, F.concat(F.lit("digits"), n)).when(n < 16, F.lit("phone"))
                  .when(n < 20, F.lit("card")).otherwise(F.lit("long")))
            .otherwise(shape(token)))


def _found(texts: DataFrame, pattern: str, when: Column) -> DataFrame:
    """Tokens of a pattern, without edge punctuation: doc_id, h, s, e, token,
    left, right, two (words before), seed."""
    text = F.col("text")

    def word(gap: Column, pattern: str, next_token: Column) -> Column:
        """The nearest word of the text between tokens, or else the next token."""
        w = F.regexp_extract(gap, pattern, 1)
        return ascii_lower(F.when(w != "", w).otherwise(F.coalesce(next_token, F.lit(""))))

    def entry(z: Column) -> Callable[[Column, Column], Column]:
        def of(x: Column, i: Column) -> Column:
            lead = F.length(F.regexp_extract(x["m"], r"^[\"'(\[{<|*#$%&]*", 0))
            core = F.regexp_replace(x["m"], r"^[\"'(\[{<|*#$%&]+|[\"')\]}>|*#$%&.,;:!?]+$", "")
            return F.struct(
                (x["s"] + lead).alias("s"), (x["s"] + lead + F.length(core)).alias("e"), core.alias("token"),
                word(F.get(z["gap"], i), LAST, F.get(z["tok"], i - 1)["m"]).alias("left"),
                word(F.get(z["gap"], i + 1), FIRST, F.get(z["tok"], i + 1)["m"]).alias("right"),
                ascii_lower(F.regexp_extract(F.get(z["gap"], i), LAST_TWO, 1)).alias("two"))
        return of

    def judged(near: Column) -> Callable[[Column], Column]:
        def of(y: Column) -> Column:
            first = F.floor(y["s"] / SPAN).cast("int")
            here = F.slice(near, first + 1, F.floor((y["e"] - 1) / SPAN).cast("int") - first + 1)
            meets = F.filter(F.flatten(here), lambda b: (b["s"] < y["e"]) & (b["e"] > y["s"]))
            whole = F.exists(meets, lambda b: (b["s"] >= y["s"]) & (b["e"] <= y["e"]))
            return F.struct(*[y[c].alias(c) for c in ("s", "e", "token", "left", "right", "two")], whole.alias("seed"),
                            (~whole & (F.size(meets) > 0)).alias("part"))
        return of

    def pieces(z: Column) -> Column:
        """Base spans by piece of the text, so that a token meets only those nearby."""
        return F.transform(F.sequence(F.lit(0), F.floor(z["len"] / SPAN).cast("int")), lambda b: F.filter(
            z["base"], lambda x: (x["s"] < (b + 1) * SPAN) & (x["e"] > b * SPAN)))

    # computed once a text: inside a lambda a column would be once an element
    parts = F.struct(matches(text, pattern, F.lit(True)).alias("tok"), F.split(text, pattern, -1).alias("gap"),
                     F.col("base").alias("base"), F.length(text).alias("len"))
    found = let(parts, lambda z: let(pieces(z), lambda near: F.filter(F.transform(
        F.filter(F.transform(z["tok"], entry(z)), lambda y: F.length(y["token"]) > 0), judged(near)),
        lambda y: ~y["part"])))
    return texts.where(when).select("doc_id", "h", F.explode(found).alias("x")).select("doc_id", "h", "x.*").drop("part")


def instances(texts: DataFrame) -> DataFrame:
    """Tokens with a digit or ``@``."""
    return _found(texts, TOKEN, F.rlike("text", F.lit("[0-9@]")))


def runs(texts: DataFrame) -> DataFrame:
    """Runs of several tokens of digits, as one instance each."""
    return _found(texts, RUN, F.rlike("text", F.lit(r"[0-9]\S*\x20[(]?[0-9]")))


def forms() -> Column:
    """An instance's own patterns."""
    token = F.col("token")
    return F.array(F.concat(F.lit("S:"), shape(token)), F.concat(F.lit("F:"), form(token)))


def neighbourhoods() -> Column:
    """The patterns of its place; no two words, no such pattern."""
    return F.array_compact(F.array(F.concat(F.lit("L:"), "left"), F.concat(F.lit("R:"), "right"),
                                   F.when(F.col("two") != "", F.concat(F.lit("B:"), "two"))))


SALT = "salt"


def salted(df: DataFrame) -> DataFrame:
    """The side of a pattern join that holds instances."""
    return df.withColumn(SALT, F.pmod(F.xxhash64("token"), F.lit(SALTS)).cast("int"))


def spread(patterns: DataFrame) -> DataFrame:
    """The side with one row a pattern, for every salt."""
    return patterns.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def bootstrap(occ: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """Trusted patterns (pattern) after ``rounds`` of scoring the graph."""
    edges = scratch.write(salted(occ.select("token", "seed", F.explode(F.concat(forms(), neighbourhoods())).alias("pattern"))
                                 .groupBy("token", "pattern").agg(F.max("seed").alias("here"))), "edges")
    seeds = edges.groupBy("token").agg(F.max("here").alias("seed"))
    score = scratch.write(seeds.select("token", "seed", F.col("seed").cast("double").alias("score")), "tokens-0")
    patterns = None
    for k in range(1, rounds + 1):
        patterns = scratch.write(
            edges.join(score, "token").groupBy("pattern").agg(
                F.round(F.sum("score") / (F.count(F.lit(1)) + F.lit(SHRINK)), 6).alias("ps"),
                F.sum(F.col("seed").cast("int")).alias("seeds")), f"patterns-{k}")
        if k < rounds:
            mean = edges.join(spread(patterns), ["pattern", SALT]).groupBy("token").agg(F.round(F.avg("ps"), 6).alias("mean"))
            score = scratch.write(score.select("token", "seed").join(mean, "token").select(
                "token", "seed", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("mean")).alias("score")),
                f"tokens-{k}")
    return patterns.where((F.col("ps") >= TRUST) & (F.col("seeds") >= SUPPORT)).select("pattern")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans."""
    scratch = Scratch(docs.sparkSession, "pii")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                        F.xxhash64(text_col).alias("h"))
    kinds = base_matches(F.col("text"))

    def labelled(k: int):
        return lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"))

    with_base = texts.select("doc_id", "text", "h", F.concat(*[
        F.transform(m, labelled(k)) for k, m in enumerate(kinds)]).alias("base"))
    base = scratch.write(with_base.select("doc_id", "h", "base"), "base")
    occ = scratch.write(instances(with_base).unionByName(runs(with_base)).distinct(), "occurrences")
    with shuffled_joins(docs.sparkSession):
        good = scratch.write(bootstrap(occ, scratch), "trusted")

        trusted, keys = spread(good), ["pattern", SALT]
        unseen = salted(occ.where(~F.col("seed")))
        own = unseen.withColumn("pattern", F.explode(forms())).join(trusted, keys, "left_semi").drop("pattern").distinct()
        near = own.withColumn("pattern", F.explode(neighbourhoods())).join(trusted, keys, "left_semi")
        more = near.select("doc_id", "h", F.struct(F.lit(len(KINDS)).alias("k"), "s", "e").alias("x")).distinct()
        # longest first among those that begin together; one inside the one before goes
        more = more.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct(
            F.col("x.s").alias("s"), (-F.col("x.e")).alias("d"), F.col("x.k").alias("k")))).alias("more"))
        far = F.aggregate("more", F.struct(F.lit(-1).alias("to"), F.array().cast("array<struct<k:int,s:int,e:int>>").alias("out")),
                          lambda acc, y: F.when(-y["d"] <= acc["to"], acc).otherwise(F.struct(
                              (-y["d"]).alias("to"), F.concat(acc["out"], F.array(F.struct(
                                  y["k"].alias("k"), y["s"].alias("s"), (-y["d"]).alias("e")))).alias("out"))),
                          lambda acc: acc["out"])
        more = scratch.write(more.select("doc_id", "h", far.alias("more")), "more")
    more = more.withColumnsRenamed({"doc_id": "_d", "h": "_h"}).hint("merge")       # short rows on both sides

    names = F.array(*[F.lit(k) for k in (*KINDS, "found")])
    text_of = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    out = base.join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("h").eqNullSafe(F.col("_h")), "left")
    spans = F.concat("base", F.coalesce("more", F.array().cast("array<struct<k:int,s:int,e:int>>")))
    return out.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"), text_of(spans).alias("spans"))


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
