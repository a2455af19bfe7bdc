"""Relational operators as thin, declarative wrappers; Catalyst picks the physical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, condition: Column) -> DataFrame:
    """Keep rows whose condition is true; integers are truthy."""
    kind = df.select(condition).schema[0].dataType.typeName()
    return df.where(condition != 0 if kind in ("byte", "short", "integer", "long") else condition)


def top_n(df: DataFrame, *order: Column, limit: int | None, offset: int = 0) -> DataFrame:
    """ORDER BY … LIMIT … OFFSET: TakeOrderedAndProject, no full sort of the input."""
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def set_op(left: DataFrame, right: DataFrame, op: str, every: bool = False) -> DataFrame:
    """UNION, INTERSECT, EXCEPT [ALL]; arity and types must agree, names come from the left."""
    if [f.dataType for f in left.schema] != [f.dataType for f in right.schema]:
        raise ValueError("Set operation inputs must have the same number and types of columns")
    right = right.toDF(*left.columns)
    return {
        ("union", False): lambda: left.union(right).distinct(),
        ("union", True): lambda: left.union(right),
        ("intersect", False): lambda: left.intersect(right),
        ("intersect", True): lambda: left.intersectAll(right),
        ("except", False): lambda: left.subtract(right),
        ("except", True): lambda: left.exceptAll(right),
    }[op, every]()


def sum_promoting(c: Column) -> Column:
    """SUM of integers that falls back to double beyond 64 bits instead of failing."""
    total = F.sum(c.cast("decimal(38,0)"))
    fits = total.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    return F.when(fits, total.cast("string")).otherwise(total.cast("double").cast("string"))
