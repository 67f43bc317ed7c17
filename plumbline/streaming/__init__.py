"""Running the relational operators over a growing folder of Parquet files.

The operators take streaming DataFrames as they are: select and project are stateless, group keeps one state row a key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import shared_dir


def read_growing(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A stream of the Parquet file or folder at `path`; the pattern lets either be named."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(df: DataFrame, path: str | None = None, checkpoint: str | None = None, mode: str = "complete") -> DataFrame:
    """Take in all that has arrived, then stop; the result is a Parquet table at `path`, by default in the shared folder.

    Under "complete" each step writes the whole result anew, under "append" or "update" what it adds. Nothing is held by the driver.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.mode("ignore").parquet(path)
    put = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)
    w = df.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True)
    (w.option("checkpointLocation", checkpoint) if checkpoint else w).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
