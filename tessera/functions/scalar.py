"""Scalar functions whose semantics differ from Spark's built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(c: Column) -> Column:
    """Characters of the string form, as bigint."""
    return F.char_length(c.cast("string")).cast("bigint")


def substr(s: Column, start: int, size: int | None = None) -> Column:
    """1-based; negative counts from the end; start 0 is the place before the first character."""
    if size is not None and size < 0:
        raise ValueError("SUBSTR length must not be negative")
    if start == 0:
        return F.substring(s, 1, 2**31 - 1 if size is None else max(size - 1, 0))
    return F.substring(s, start, 2**31 - 1 if size is None else size)


def round_half_away(c: Column) -> Column:
    return F.round(c)


def like(c: Column, pattern: str) -> Column:
    """LIKE without an escape character: a backslash is literal."""
    return F.like(c, F.lit(pattern), F.lit("\x01"))


def text_of(c: Column, dtype: str) -> Column:
    """String form used by CONCAT and casts: doubles without a trailing `.0` or exponent."""
    if dtype != "double":
        return c.cast("string")
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, F.floor(c).cast("string")).otherwise(c.cast("string"))


def int_divide(a: Column, b: Column) -> Column:
    """Integer division truncates toward zero and raises on a zero divisor."""
    return F.call_function("div", a, b)


def simple_case(subject: Column, pairs: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """CASE x WHEN v …: null-safe, so WHEN NULL matches a null subject."""
    out = None
    for value, result in pairs:
        out = F.when(subject.eqNullSafe(value), result) if out is None else out.when(subject.eqNullSafe(value), result)
    return out if default is None else out.otherwise(default)
