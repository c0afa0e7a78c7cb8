"""Scalar and array expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatekit.config import DEFAULT_SEED

_TWO53 = 9007199254740992.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used.  A fold
    over nothing: a transform of one element would copy what ``body`` returns."""
    return F.aggregate(F.array(), value, lambda v, _: v, body)


def hash60(*keys: str | Column, seed: str = DEFAULT_SEED) -> Column:
    """Deterministic 60-bit unsigned hash of ``seed`` and keys: the first 15 hex
    digits of md5(seed|k1|k2...) as bigint, wide enough that ``hash % n`` reaches
    every index of any table.  Same value in DuckDB via
    ('0x' || substr(md5(...), 1, 15))::bigint."""
    parts = [F.lit(seed)] + [col(k).cast("string") for k in keys]
    return hash60_text(F.concat_ws("|", *parts))


def hash60_text(text: Column) -> Column:
    """``hash60`` of the joined seed and keys."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform01(*keys: str | Column, seed: str = DEFAULT_SEED) -> Column:
    """Uniform number in [0, 1): the upper 53 bits of the hash of the keys, so
    the division is exact and never rounds up to 1."""
    return F.shiftright(hash60(*keys, seed=seed), 7) / F.lit(_TWO53)


def score_bucket(score: str | Column) -> Column:
    """round(score * 10) with round-half-to-even, as Python's round()."""
    return F.rint(col(score) * 10).cast("int")


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def pad_right(arr: str | Column, n: int, fill: Column) -> Column:
    """First ``n`` elements of ``arr``, right-padded with ``fill`` to length n."""
    return F.slice(F.concat(col(arr), F.array_repeat(fill, n)), 1, n)


def tail(arr: str | Column, n: int) -> Column:
    """Last ``n`` elements (all if shorter).  ``slice(a, -n, n)`` returns []
    when n > size, so the start is computed explicitly."""
    a = col(arr)
    return F.slice(a, F.greatest(F.size(a) - F.lit(n), F.lit(0)) + 1, n)


def zero_step(width: int, kind: str = "int") -> Column:
    z = F.lit(0).cast(kind) if kind != "string" else F.lit("0")
    return F.array(*[z for _ in range(width)])


def seq_mask(length: str | Column, n: int) -> Column:
    """0/1 mask of length n with ones for positions < length."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.when(i < col(length), F.lit(1)).otherwise(F.lit(0)))


def round6(c: str | Column) -> Column:
    return F.round(col(c).cast("double"), 6)


def categories(n_cate: int | str | Column) -> Column:
    """The category indices 0 .. n_cate - 1."""
    n = F.lit(n_cate) if isinstance(n_cate, int) else col(n_cate)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
