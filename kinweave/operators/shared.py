"""Tables between steps in the shared checkpoint folder, and joins by the size of a side."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to so many rows, after they have been counted.
BROADCAST_ROWS = 500_000


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # One process: its warehouse folder is shared by all there is.
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
    return base.rstrip("/")


def settle(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write `df` to the folder in spark.checkpoint.dir and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{_base(spark)}/link/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._link_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a settled table that nothing will read again."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._link_path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows, else as it is (a shuffled join follows)."""
    return F.broadcast(df) if df.count() <= limit else df
