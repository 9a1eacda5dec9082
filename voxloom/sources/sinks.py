"""Writers of manifests, results, shards, reports and score lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.hashing import hash_bucket
from voxloom.plans.cluster import checkpoint
from voxloom.sources.versions import read_table as read_table
from voxloom.sources.versions import replace_table as replace_table


def write_manifest(df: DataFrame, jsonl: str, tsv: str) -> None:
    """The manifest as JSON lines, and its paths and texts as a table with a header; both from one checkpointed table."""
    rows = checkpoint(df)
    rows.write.mode("overwrite").json(jsonl)
    rows.select("audio_path", F.regexp_replace("text", r"[\t\r\n]+", " ").alias("text")).write.mode("overwrite").option("header", True).option("sep", "\t").csv(tsv)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_by_split_mix(df: DataFrame, root: str) -> None:
    df.write.mode("overwrite").partitionBy("split", "mix_type").json(root)


def write_supervision_text(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(" ", "seg_id", "text").alias("value")).write.mode("overwrite").text(path)


def write_shards(df: DataFrame, shards: int, root: str, key: str = "utt_id") -> DataFrame:
    """A folder for each shard by hash, and the rows of each."""
    sharded = df.withColumn("shard", hash_bucket(key, shards))
    sharded.write.mode("overwrite").partitionBy("shard").json(root)
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"))


def recog_lines(df: DataFrame, key: str = "id") -> DataFrame:
    """`id:\tref=` and `id:\thyp=` lines, sorted by id."""
    both = F.array(F.struct(F.lit("ref").alias("k"), F.col("ref").alias("v")), F.struct(F.lit("hyp").alias("k"), F.col("hyp").alias("v")))
    rows = df.select(key, F.posexplode(both).alias("place", "x")).orderBy(key, "place")
    return rows.select(F.concat(F.col(key).cast("string"), F.lit(":\t"), F.col("x.k"), F.lit("="), F.coalesce("x.v", F.lit(""))).alias("value"))


def write_recogs(df: DataFrame, path: str, key: str = "id") -> None:
    recog_lines(df, key).write.mode("overwrite").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A report of one row as JSON."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def rewrite_text_field(df: DataFrame, field: str, new: str, path: str, kind: str = "jsonl", key: str = "key") -> None:
    """Rows with one field replaced by the column `new`, as JSON lines, or as keys and texts between tabs."""
    out = df.withColumn(field, F.col(new))
    if kind == "jsonl":
        (out if new == field else out.drop(new)).write.mode("overwrite").json(path)
    else:
        out.select(F.concat_ws("\t", key, field).alias("value")).write.mode("overwrite").text(path)


def write_per_utt_scores(df: DataFrame, path: str, key: str = "id") -> None:
    """Scores as JSON lines, and the transcripts to read."""
    rows = checkpoint(df)
    rows.write.mode("overwrite").json(f"{path}/scores")
    line = F.format_string("%s\terrors=%d\tref=%s\thyp=%s", F.col(key).cast("string"), F.col("errors").cast("int"), F.to_json("ref_per_speaker"), F.to_json("hyp_per_speaker"))
    rows.orderBy(key).select(line.alias("value")).write.mode("overwrite").text(f"{path}/transcripts")
