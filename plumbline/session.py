"""Session defaults and scoped configuration."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "plumbline", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under; on a cluster pass your own session instead."""
    n = os.cpu_count() if cores == "*" else int(cores)
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        # a join whose parts are all measured to be small is a hash join; others are sorted and merged, and can spill
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, named in spark.checkpoint.dir. Only a local master, all in one process, may do without it."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = os.path.join(tempfile.gettempdir(), "checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


@contextmanager
def scoped_conf(spark: SparkSession, conf: dict[str, str]):
    """Set Spark options for a block and put the old values back."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_conf(spark: SparkSession, conf: dict[str, str]) -> SparkSession:
    """A session beside this one, with its options and these: what is planned in it keeps them, and the other never sees them."""
    other = spark.newSession()
    for k, v in {**spark.conf.getAll, **conf}.items():
        if other.conf.isModifiable(k):
            other.conf.set(k, v)
    return other


def moved(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The same relation, planned by that session."""
    if df.sparkSession is spark:
        return df
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed()), spark)
