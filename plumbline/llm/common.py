"""Shared ground: reliable intermediate tables, code shipping, tolerant column access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: White space that separates words in the row contracts: space, tab to carriage return.
SPACE = " \t\n\v\f\r"
_shipped: set[str] = set()
#: The paths made in the block of `scratch` that this thread is in.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Lists the paths that are made inside, by this thread alone, for `remove`."""
    paths: list[str] = []
    before = _made.set(paths)
    try:
        yield paths
    finally:
        _made.reset(before)


def noted(path: str) -> str:
    paths = _made.get()
    if paths is not None:
        paths.append(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return noted(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def file_system(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete what is at these paths."""
    for path in paths:
        fs, p = file_system(spark, path)
        fs.delete(p, True)


def at_exit(spark: SparkSession, path: str) -> None:
    """Let the file system delete what is at `path` when the application ends."""
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)


def table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and is computed once."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, like: DataFrame) -> DataFrame:
    """`df` in at most twice the parts that a scan of the written table `like` has, or two a core where that is more.

    For tables of keys and numbers made out of `like` by shuffles: their parts grow with the data, and not with the number of
    shuffle partitions, which may be far more than there is to write. Each file costs an executor that writes to a local file
    system three processes, started to set modes.
    """
    n = max(like._jdf.queryExecution().toRdd().getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(2 * n)


def scans_files(df: DataFrame) -> bool:
    """Whether the rows come straight from files, filtered or not, so that each has a file and a row number there."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    outputs = df._jdf.queryExecution().analyzed().metadataOutput()
    return plan.nodeName().startswith("LogicalRelation") and any(outputs.apply(i).name() == "_metadata" for i in range(outputs.size()))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python tasks can import it wherever the driver runs from."""
    key = spark.sparkContext.applicationId
    if key in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "plumbline_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(key)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file: under `folder`, or where the installed package keeps it (resolved where it is used)."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def quoted(name: str) -> str:
    """A column name as it must be written, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def same(df: DataFrame) -> list:
    """The columns of df as they are."""
    return [F.col(quoted(c)) for c in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until no column of df has one of them."""
    taken, end = {c.lower() for c in df.columns}, ""
    while any((n + end).lower() in taken for n in names):
        end += "_"
    return [n + end for n in names]


def crc_mod(c, m: int):
    """crc32 of the value as text, modulo m; null counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def text_of(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))


def small(df: DataFrame, most: int) -> DataFrame:
    """A written table, for sending to every task if it is counted to have no more than `most` rows; else as it is."""
    return df.hint("broadcast") if df.limit(most + 1).count() <= most else df


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())
