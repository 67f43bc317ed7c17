"""Column builders. Everything stays an expression that Catalyst folds, pushes down and compiles."""

from __future__ import annotations

import datetime
from functools import reduce
from typing import Any, Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

LiteralMode = Literal["narrow", "sql"]


def as_column(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def type_of(df: DataFrame, x: Any) -> T.DataType:
    """The type an operand has over `df`; Python atoms have the smallest type that holds them."""
    if isinstance(x, Column):
        return df.select(x.alias("x")).schema[0].dataType
    if isinstance(x, bool):
        return T.BooleanType()
    if isinstance(x, int):
        return T.IntegerType() if -(2**31) <= x < 2**31 else T.LongType()
    return T.DoubleType() if isinstance(x, float) else T.StringType()


def integral(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def narrow_literal(value: Any, to: T.DataType) -> Any:
    """A numeric literal as the compared column's type holds it: cut towards zero for whole-number columns."""
    return int(value) if integral(to) and isinstance(value, float) else value


def plus(*xs: Any) -> Column:
    return reduce(lambda a, b: a + b, map(as_column, xs))


def times(*xs: Any) -> Column:
    return reduce(lambda a, b: a * b, map(as_column, xs))


def minus(*xs: Any) -> Column:
    return reduce(lambda a, b: a - b, map(as_column, xs))


def divide(df: DataFrame, *xs: Any) -> Column:
    """Left fold; whole numbers divide towards zero and keep the wider operand's type. A zero divisor is an error."""

    def step(a, b):
        (ca, ta), (cb, tb) = a, b
        if integral(ta) and integral(tb):
            wide = T.LongType() if T.LongType() in (ta, tb) else T.IntegerType()
            return F.call_function("div", ca, cb).cast(wide), wide
        return ca / cb, T.DoubleType()

    return reduce(step, [(as_column(x), type_of(df, x)) for x in xs])[0]


def compare(df: DataFrame, op: str, a: Any, b: Any, mode: LiteralMode = "narrow") -> Column:
    """`greater` or `equal`; under `narrow` a literal is first cut to the other side's type, under `sql` it is not."""
    if mode == "narrow":
        if isinstance(a, Column) and not isinstance(b, Column):
            b = narrow_literal(b, type_of(df, a))
        elif isinstance(b, Column) and not isinstance(a, Column):
            a = narrow_literal(a, type_of(df, b))
    a, b = as_column(a), as_column(b)
    return a > b if op == "greater" else a == b


def greater(df: DataFrame, a: Any, b: Any, mode: LiteralMode = "narrow") -> Column:
    return compare(df, "greater", a, b, mode)


def equal(df: DataFrame, a: Any, b: Any, mode: LiteralMode = "narrow") -> Column:
    return compare(df, "equal", a, b, mode)


def and_(*preds: Column) -> Column:
    if len(preds) < 2:
        raise ValueError("And needs two predicates or more")
    return reduce(lambda a, b: a & b, preds)


def date_days(text: str) -> int:
    """Days since 1970-01-01 of a YYYY-MM-DD date."""
    return (datetime.date.fromisoformat(text) - datetime.date(1970, 1, 1)).days


def date_object(text: str) -> Column:
    return F.lit(datetime.date.fromisoformat(text))


def year_exact(c: Column, days: bool = False) -> Column:
    """Calendar year of a date, timestamp or (days=True) day number."""
    return F.year(F.date_from_unix_date(c.cast("int")) if days else c)


def year_approx(days: Column) -> Column:
    """A linear formula over day numbers, off by one for some days around New Year; for compatibility only.

    Fixed values of the formula: offset 719563.285 and 365.265 days a year.
    """
    return ((days.cast("double") + F.lit(719563.285)) / F.lit(365.265)).cast("int")


def string_contains(c: Column, part: str) -> Column:
    return c.contains(part)


def string_join(*xs: Any) -> Column:
    return F.concat(*map(as_column, xs))


def interpolate(y: Column, order: Column, *partition: Column) -> Column:
    """`y`, or the mean of its two neighbours by `order` where it is null. Give `partition` keys for anything large."""
    w = Window.partitionBy(*partition).orderBy(order)
    return F.coalesce(y, (F.lag(y).over(w) + F.lead(y).over(w)) / 2)
