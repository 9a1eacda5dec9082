"""Tables that are replaced as a whole while others read them.

A table's folder holds a folder for each version and, in `_current`, an empty file for each version that is whole; its name is the
version's number and folder. A new version is written first and then named by creating that file, one call
that either has happened or has not. Readers take the file with the highest number, so that they find a whole table at each moment, and a writer that
dies before leaves only a folder that no file names. Old versions stay while readers may hold them.

There is one writer at a time. Of two that name a version of the same number, the greater folder name counts.
"""

from __future__ import annotations

import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

CURRENT, DATA = "_current", "_data"


def system_of(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path, and a function that makes paths below it."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    base = path.rstrip("/")
    return make(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda *parts: make("/".join((base, *parts)))


def versions(spark: SparkSession, path: str) -> list[tuple[int, str, int]]:
    """Number, folder and time (in milliseconds) of each whole version, in order."""
    system, at = system_of(spark, path)
    if not system.exists(at(CURRENT)):
        return []
    found = []
    for status in system.listStatus(at(CURRENT)):
        number, _, folder = status.getPath().getName().partition(".")
        if number.isdigit():
            found.append((int(number), folder, status.getModificationTime()))
    return sorted(found)


def replace_table(df: DataFrame, path: str, keep: int = 2, keep_sec: float = 3600.0) -> int:
    """The rows of `df`, which may come from the table itself, as its next version; the version's number.

    Versions older than the last `keep`, and named over `keep_sec` seconds ago, go.
    """
    spark = df.sparkSession
    system, at = system_of(spark, path)
    folder = uuid.uuid4().hex
    df.write.parquet(f"{path.rstrip('/')}/{DATA}/{folder}")
    known = versions(spark, path)
    number = known[-1][0] + 1 if known else 0
    system.mkdirs(at(CURRENT))
    system.create(at(CURRENT, f"{number:012d}.{folder}"), False).close()
    for old, name, named in known[: max(0, len(known) + 1 - keep)]:
        if named < (time.time() - keep_sec) * 1000:
            system.delete(at(CURRENT, f"{old:012d}.{name}"), False)
            system.delete(at(DATA, name), True)
    return number


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of a table, or one by its number; a folder without versions is read as it is."""
    known = versions(spark, path)
    if not known and version is None:
        return spark.read.parquet(path)
    wanted = [folder for number, folder, _ in known if version is None or number == version]
    if not wanted:
        raise ValueError(f"{path} has no version {version}")
    return spark.read.parquet(f"{path.rstrip('/')}/{DATA}/{wanted[-1]}")
