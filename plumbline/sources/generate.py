"""Generated columns for trials, made where they are used: any number of rows, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, low: int, high: int, row: str = "id") -> Column:
    """Whole numbers from low to high, both included, from a hash of the row number."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(row)), F.lit(high - low + 1)) + low).cast("long")


def unique(n: int, seed: int, row: str = "id") -> Column:
    """A permutation of 0 .. n-1 over rows 0 .. n-1: an affine map whose factor has no divisor in common with n."""
    from math import gcd

    a = 2 * seed + 6_364_136_223 % max(n, 2) | 1
    while gcd(a, n) != 1:
        a += 2
    return ((F.col(row).cast("decimal(38,0)") * (a % max(n, 1)) + seed) % max(n, 1)).cast("long")


def of_cardinality(k: int, seed: int, row: str = "id") -> Column:
    """k distinct values, each of them present from k rows on."""
    return F.when(F.col(row) < k, F.col(row)).otherwise(uniform(seed, 0, k - 1, row)).cast("long")


def rows(spark: SparkSession, n: int, columns: dict[str, Column]) -> DataFrame:
    return spark.range(n).select(*[c.alias(name) for name, c in columns.items()])
