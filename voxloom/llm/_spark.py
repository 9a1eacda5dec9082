"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python task holds as numpy arrays at a time.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with marks behind it until no column of `df` has the name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints below spark.checkpoint.dir, which all executors share.

    A folder of our own is set only where that setting is missing on a local master, as in tests.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, read back. Unlike a checkpoint it is planned by its own size: in loops of joins, the sizes that checkpoints
    hand on from the plans before them multiply until the planner does nothing but multiply them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if it holds at most `rows` rows; else unchanged, so that Spark shuffles it. It is counted: give it tables that are written or cheap."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` with about `limit` bytes of the column `text` each, one row at least."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(text)).to_pylist()]
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run `fn` over Arrow slices of bounded size; its batches become the rows of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                yield from fn(part)

    return df.mapInArrow(run, schema)
