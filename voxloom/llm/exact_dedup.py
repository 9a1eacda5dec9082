"""Exact deduplication against a persistent index of digests, in DataFrame operations alone.

Texts are equal when they are the same after each run of white space became one space. The
SHA-256 of that text is their digest. The index is a table of one row for each digest seen:
which row keeps it, bucketed by the digest and sorted by it inside the buckets. A delivery of
new rows is reduced to one row for each of its digests, anti-joined with the index by
sort-merge, and what is left is appended. The index is not shuffled for that join, as its
buckets are the join's partitions; a delivery moves as digests, never as texts.

The row with the least id of a delivery stays; a digest that the index has from an earlier
delivery is kept by the row that brought it then. Deliveries in the order of ids, then, keep the
least id of all. `add` may be run again after a lost run: what is in the index is not added twice.

Hot groups: copies are counted and their least id is found with partial sums before any shuffle;
decisions meet rows by a join of two written tables, whose hot digests Spark splits.

Null texts count as empty. Null ids come after all others; among rows of one digest that have the
same id, exactly one stays. Repeated rows, then, are copies like all others. Empty tables give empty
results and leave the index as it was. Other columns are carried by `drop_copies`, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm._spark import checkpoint, unused

#: Fixed value: white space whose runs count as one space.
SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class DigestIndex:
    """An index that this session has opened: its folder, the name it has in the catalog, and its buckets."""

    path: str
    name: str
    buckets: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)


def digest_of(text: Column | str) -> Column:
    """The 32 bytes of a text's digest."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256))


def open_index(spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None) -> DigestIndex:
    """The index in a folder that the driver and all executors share; a new one where there is none.

    A new one has as many buckets as the session's shuffles have partitions, unless `buckets` says otherwise;
    an old one is read with its own number, which stands beside it.
    """
    try:
        buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")
    name = f"digests_{uuid.uuid4().hex}"
    spark.sql(
        f"create table {name} (digest binary, keep_id {id_type}, delivery string, row bigint) using parquet"
        f" clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}/digests'"
    )
    return DigestIndex(path, name, buckets)


def digests(docs: DataFrame, delivery: Column | str = "", key: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `digest`, the name of the `delivery`, and a number `row` for each row of `docs`, written once."""
    name = F.lit(delivery) if isinstance(delivery, str) else delivery
    rows = docs.select(F.col(key).alias("id"), digest_of(text).alias("digest"), name.cast("string").alias("delivery"))
    return checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))


def add(index: DigestIndex, rows: DataFrame) -> None:
    """Append the digests of a delivery (as `digests` gives it) that the index does not have, each with its least row.

    The least rows are written first: Spark would else join before it groups, and shuffle every copy.
    """
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "delivery", "row")
    first = checkpoint(rows.groupBy("digest").agg(F.min(order).alias("first")))
    fresh = first.join(index.table(rows.sparkSession).hint("merge"), "digest", "left_anti")
    fresh = fresh.select("digest", F.col("first.id").alias("keep_id"), F.col("first.delivery").alias("delivery"), F.col("first.row").alias("row"))
    fresh.repartition(index.buckets, "digest").write.mode("append").format("parquet").bucketBy(index.buckets, "digest").sortBy("digest").saveAsTable(index.name)


def groups(index: DigestIndex, rows: DataFrame) -> DataFrame:
    """For each digest of `rows`: how often they have it, and which row keeps it."""
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    keeps = index.table(rows.sparkSession).select("digest", "keep_id", F.col("delivery").alias("keep_delivery"), F.col("row").alias("keep_row"))
    return sizes.join(keeps.hint("merge"), "digest")


def decisions(index: DigestIndex, rows: DataFrame) -> DataFrame:
    """For each row of the deliveries in `rows`: `id`, `keep_id`, `group_size`, `kept` and `text_sha256`."""
    found = rows.join(checkpoint(groups(index, rows)), "digest")
    kept = (F.col("delivery") == F.col("keep_delivery")) & (F.col("row") == F.col("keep_row"))
    return found.select("id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, index: DigestIndex, delivery: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of a new delivery that stay, with all their columns, after its digests were added to the index.

    Rows that share both id and digest are one row of this result, the first that Spark meets.
    """
    rows = digests(docs, delivery, key, text)
    add(index, rows)
    keeps = index.table(docs.sparkSession).filter(F.col("delivery") == delivery)
    digest, keep_digest, keep_id = unused(docs, "digest", "keep_digest", "keep_id")
    keeps = keeps.select(F.col("digest").alias(keep_digest), F.col("keep_id").alias(keep_id))
    own = docs.withColumn(digest, digest_of(F.col(f"`{text}`")))
    kept = own.join(keeps, (F.col(digest) == F.col(keep_digest)) & F.col(f"`{key}`").eqNullSafe(F.col(keep_id)), "left_semi")
    return kept.dropDuplicates([digest, key]).drop(digest)
