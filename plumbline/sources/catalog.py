"""Parquet tables in, Parquet out, and relations built from literal columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, lazily; filters and column choice reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: Sequence[str] = TABLES) -> None:
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


def save(df: DataFrame, path: str, *keys: str) -> None:
    """Write as Parquet, in folders by `keys` if given."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*keys) if keys else w).parquet(path)


def spark_type(values: Sequence) -> T.DataType:
    """The type of a literal column: bool, int (bigint if a value needs it), double or string."""
    if all(isinstance(v, bool) for v in values) and values:
        return T.BooleanType()
    if all(isinstance(v, int) for v in values):
        return T.IntegerType() if all(-(2**31) <= v < 2**31 for v in values) else T.LongType()
    if all(isinstance(v, (int, float)) for v in values):
        return T.DoubleType()
    if all(isinstance(v, str) for v in values):
        return T.StringType()
    raise TypeError(f"unsupported column values: {list(values)[:3]}")


def table_literal(spark: SparkSession, columns: dict[str, Sequence], types: dict[str, str] | None = None) -> DataFrame:
    """A relation from named columns of one length; `types` overrides the inferred Spark type names."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    fields = [T.StructField(n, spark_type(v)) for n, v in columns.items()]
    cast = [float if isinstance(f.dataType, T.DoubleType) else (lambda x: x) for f in fields]
    rows = [tuple(c(x) for c, x in zip(cast, r, strict=True)) for r in zip(*columns.values(), strict=True)]
    df = spark.createDataFrame(rows, T.StructType(fields))
    return df.withColumns({k: F.col(k).cast(v) for k, v in (types or {}).items()}) if types else df
