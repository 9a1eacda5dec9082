"""Stable hashes: all randomness is a function of a row's key and a seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _prefix(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")


def hash01(key: Column | str) -> Column:
    """The first 32 bits of the md5 as a number from 0 to 1, both included."""
    return _prefix(key).cast("double") / F.lit(4294967295.0)


def hash_bucket(key: Column | str, n: int) -> Column:
    return (_prefix(key) % max(1, n)).cast("int")


def keyed_seed(*parts: Column | str) -> Column:
    """A 64-bit seed for the stream of a row."""
    return F.xxhash64(*parts)


def uniform(key: Column, salt: str, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    """A number between `low` and `high` that depends on the key and the salt alone."""
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return low + (high - low) * hash01(F.concat(key.cast("string"), F.lit(f"__{salt}")))


def split_by_hash(x: Column, train: float, val: float) -> Column:
    return F.when(x < train, "train").when(x < train + val, "val").otherwise("test")
