"""Relational operators, DataFrame in and DataFrame out.

Physical choices are left to the planner: filters and column choice reach the scan, aggregates combine before the shuffle,
and joins become broadcast, hash or merge joins by measured size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str) -> Column:
    """A column by its name, whatever signs are in it."""
    return df[quoted(name)]


AGGREGATES = {"Min": F.min, "Max": F.max, "Sum": F.sum, "Count": F.count, "Avg": F.avg}


def select(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; a null counts as false."""
    return df.filter(predicate)


def project(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Named expressions in the given order; a string is a column name."""
    return df.select(*[(F.col(quoted(c)) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def group(df: DataFrame, keys: Sequence[str | Column], aggregates: Mapping[str, Column]) -> DataFrame:
    """Keys, then aggregates. Without keys: one row, also over no rows (null sums, count 0)."""
    aggs = [c.alias(n) for n, c in aggregates.items()]
    if not keys:
        return df.agg(*aggs)
    return df.groupBy(*keys).agg(*aggs)


def join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], hint: str | None = None) -> DataFrame:
    """Inner equi-join on one key or several. Columns of the left, then those of the right whose names are new (the left's win)."""
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("a join needs as many keys on either side")
    tmp = {c: f"__r_{i}" for i, c in enumerate(right.columns)}
    r = right.select(*[column(right, c).alias(n) for c, n in tmp.items()])
    r = r.hint(hint) if hint else r
    on = None
    for a, b in zip(left_keys, right_keys, strict=True):
        c = column(left, a) == r[tmp[b]]
        on = c if on is None else on & c
    new = [c for c in right.columns if c not in left.columns]
    return left.join(r, on, "inner").select(*[column(left, c) for c in left.columns], *[r[tmp[c]].alias(c) for c in new])


def partitioned_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner equi-join on a whole-number key in the partitioned style: both sides dealt by key, and joined part by part.

    The sides are co-partitioned by the exchange; empty, small and skewed parts are left to adaptive execution, and so is the
    choice by measured size of a hash join (a part's table in memory) or a merge join (which spills): see `get_spark`.
    """
    return join(left, right, [left_key], [right_key])


def partition(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """The rows dealt by key, so that joins and groups on it need no exchange; without `parts` adaptive execution sizes them."""
    return df.repartition(parts, column(df, key)) if parts else df.repartition(column(df, key))


def semi_reduce(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of the left whose key occurs on the right: what is left of the left side once parts without partner are gone."""
    r = right.select(column(right, right_key).alias("__k"))
    return left.join(r, column(left, left_key) == r["__k"], "left_semi")


def order(df: DataFrame, by: Sequence[tuple[str, bool]]) -> DataFrame:
    """Sorted by (column, descending) pairs."""
    return df.orderBy(*[F.desc(quoted(c)) if d else F.asc(quoted(c)) for c, d in by])


def top(df: DataFrame, by: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """The first n rows of that order; each task keeps only n."""
    return order(df, by).limit(n)


#: Stretches of the order that `interpolate` cuts a relation into.
STRETCHES = 256


def interpolate(df: DataFrame, value: str, by: str, name: str, stretches: int = STRETCHES) -> DataFrame:
    """All rows with `name`: the value, or the mean of its two neighbours in the order `by` where it is null; null at either end.

    The order is cut into stretches at quantiles, so that no task holds more than one of them; what lies next to a stretch is the
    nearest end of the stretches before and after it. `by` is a number, date or timestamp; other types are ordered in one task.
    Rows without an order come first, and rows of the same place in it are neighbours in any order.
    """
    v, o = F.col(quoted(value)), F.col(quoted(by))
    kind = df.schema[by].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        place = F.col(quoted(by)).cast("timestamp").cast("double")
    elif isinstance(kind, T.NumericType):
        place = o.cast("double")
    else:
        w = Window.orderBy(o)
        return df.withColumn(name, F.coalesce(v, (F.lag(v).over(w) + F.lead(v).over(w)) / 2))
    cuts = df.select(place.alias("p")).stat.approxQuantile("p", [i / stretches for i in range(1, stretches)], 1 / (4 * stretches))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))] or [F.lit(0.0)]), lambda c: c < place))
    d = df.withColumn("__s", F.when(place.isNull(), -1).otherwise(at))
    w = Window.partitionBy("__s").orderBy(o)
    ends = d.groupBy(F.col("__s").alias("__e")).agg(F.min_by(F.struct(v.alias("x")), F.struct(o.alias("o"))).alias("a"), F.max_by(F.struct(v.alias("x")), F.struct(o.alias("o"))).alias("b"))
    u = Window.orderBy("__e")  # one row a stretch
    ends = ends.select("__e", F.lag("b").over(u)["x"].alias("__before"), F.lead("a").over(u)["x"].alias("__after")).hint("broadcast")
    d = d.withColumns({"__i": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy("__s")), "__lag": F.lag(v).over(w), "__lead": F.lead(v).over(w)})
    d = d.join(ends, F.col("__s") == F.col("__e"))
    before = F.when(F.col("__i") == 1, F.col("__before")).otherwise(F.col("__lag"))
    after = F.when(F.col("__i") == F.col("__n"), F.col("__after")).otherwise(F.col("__lead"))
    return d.select(*[F.col(quoted(c)) for c in df.columns], F.coalesce(v, (before + after) / 2).alias(name))
