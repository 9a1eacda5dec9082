"""Bounded training samples, drawn by hashes of keys, so that they are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of `df` at most: those whose hashed key falls below the share that `rows` are of all."""
    share = min(1.0, rows / max(1, df.count()))
    return df if share >= 1 else df.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < int(share * 1_000_000))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """`docs` with `label`, for a hash sample of about `rows` labelled ids at most.

    Labels that are null do not count; of several labels of an id the largest does. Of several
    rows of an id the least is taken, so that the sample stays bounded.
    """
    own = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    own = hash_sample(own, "doc_id", rows)
    docs = docs.drop(label).join(F.broadcast(own), "doc_id")
    rest = [c for c in docs.columns if c not in ("doc_id", label)]
    return docs.groupBy("doc_id", label).agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", label, "row.*")
