"""What depends on the cluster: the shared folder for checkpoints, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints below spark.checkpoint.dir; a folder of our own only where that is unset on a local master."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: smaller than a checkpoint, and readers take only the columns that they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows; else Spark shuffles it. It is counted: give it tables that are written or cheap."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
