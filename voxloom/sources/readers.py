"""Readers of manifests, transcripts, vocabularies, listings and ledgers, all with fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions.names import split_from_filename
from voxloom.operators.relational import by_priority, dedupe
from voxloom.schemas import CUT, LEDGER, MANIFEST, MIX_METADATA, conform


def read_manifest(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """JSON lines; rows without text or dataset and broken lines go."""
    rows = spark.read.schema(MANIFEST).option("mode", "PERMISSIVE").json(path)
    return rows.filter((F.trim("text") != "") & (F.trim("dataset") != ""))


def read_cuts(spark: SparkSession, folder: str, mixes: Sequence[str], variants: Sequence[str], partitions: int = 0) -> DataFrame:
    """Cuts of all `train.{mix}.cuts_{variant}.jsonl.gz` that there are; packed files are one partition each, so they are dealt out."""
    glob = f"train.{{{','.join(mixes)}}}.cuts_{{{','.join(variants)}}}.jsonl*"
    rows = spark.read.schema(CUT).option("pathGlobFilter", glob).json(folder).withColumn("file", F.col("_metadata.file_name"))
    return rows.repartition(partitions) if partitions else rows


def read_tsv_transcript(spark: SparkSession, path: str) -> DataFrame:
    """`utt_id` and `text` split at the first tab; lines without either go. `file` and `line` name the place where that is known."""
    lines = read_lines(spark, path)
    parts = F.split("value", "\t", 2)
    rows = lines.select("file", "line", F.trim(F.get(parts, 0)).alias("utt_id"), F.trim(F.get(parts, 1)).alias("text"))
    return rows.filter((F.col("utt_id") != "") & (F.col("text") != ""))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their numbers from 0, bad ones included.

    Files are read in splits. A line's number is its place in its split, which starts at a known byte, and the lines of the splits before it.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", r"\r\z", "").alias("value"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_place")
    )
    sizes = rows.groupBy("_path", "_start").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_path", "_start", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(sizes, ["_path", "_start"]).select("file", (F.col("_place") - F.col("_first") + F.col("_before")).cast("int").alias("line"), "value")


def read_parquet_audio(spark: SparkSession, path: str, text_column: str) -> DataFrame:
    """Paths and texts of audio shards, without the bytes, with the row number in each file; rows without either go."""
    rows = spark.read.parquet(path).select(F.col("audio.path").alias("source_audio_path"), F.col(text_column).alias("text"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row"))
    return rows.filter(F.col("source_audio_path").isNotNull() & (F.trim("text") != ""))


def read_segments_csv(spark: SparkSession, path: str, schema, required: Sequence[str] = ()) -> DataFrame:
    """A table with a header; required columns must be there, other missing ones are null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    return conform(rows, schema)


def read_keyed_text(spark: SparkSession, path: str, kind: str = "auto") -> DataFrame:
    """`key` and `text` from tab-separated or JSON lines; a line without a key is called by its number."""
    if kind == "auto":
        kind = "jsonl" if path.endswith((".jsonl", ".json", ".jsonl.gz")) else "tsv"
    lines = read_lines(spark, path).filter(F.trim("value") != "")
    if kind == "jsonl":
        j = F.from_json("value", "utt_id string, id string, key string, text string")
        key, text = F.coalesce(j["utt_id"], j["id"], j["key"]), j["text"]
    else:
        parts = F.split("value", "\t", 2)
        key, text = F.when(F.size(parts) == 2, F.trim(F.get(parts, 0))), F.element_at(parts, -1)
    return lines.select(F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("line_"), F.col("line") + 1)).alias("key"), F.coalesce(text, F.lit("")).alias("text"), "line")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary from `token id` lines, or from the list `tokens` of a configuration in JSON."""
    if path.endswith(".json"):
        return spark.read.schema("tokens array<string>").option("multiLine", True).json(path).select(F.posexplode("tokens").alias("id", "token")).select("token", "id")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(F.regexp_extract("value", r"^(.*)\s+(\d+)\s*$", 1).alias("token"), F.regexp_extract("value", r"(\d+)\s*$", 1).try_cast("int").alias("id")).filter("id is not null")


def read_pipe_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Fields between bars, trimmed; lines that start with a semicolon are comments."""
    rows = spark.read.text(path).filter(~F.ltrim("value").startswith(";") & (F.trim("value") != ""))
    parts = F.split("value", r"\s*\|\s*", len(columns))
    return rows.select(*[F.trim(F.get(parts, i)).alias(c) for i, c in enumerate(columns)])


def read_paren_transcripts(spark: SparkSession, path: str, prefer: str = ".dot", other: str = ".ptx") -> DataFrame:
    """`utt_id` and `text` from lines like `text (utt)`; of both kinds of files the preferred one counts."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_name"))
    rows = lines.select("file", F.regexp_extract("value", r"\(([^()\s]+)\)\s*$", 1).alias("utt_id"), F.trim(F.regexp_replace("value", r"\(([^()\s]+)\)\s*$", "")).alias("text")).filter("utt_id <> ''")
    return by_priority([rows.filter(F.col("file").endswith(prefer)).drop("file"), rows.filter(F.col("file").endswith(other)).drop("file")], "utt_id")


def read_index_list(spark: SparkSession, path: str, skip: Sequence[str] = ()) -> DataFrame:
    """`disk` and `path` from lines like `11_1_1:wsj0/x.wv1`; comments and skipped folders go, and disk ids use dashes."""
    rows = spark.read.text(path).filter(~F.ltrim("value").startswith(";") & F.contains("value", F.lit(":")))
    parts = F.split(F.trim("value"), r"\s*:\s*", 2)
    found = rows.select(F.regexp_replace(F.regexp_replace(F.get(parts, 0), "_", "-"), r"-(\d+)$", ".$1").alias("disk"), F.regexp_replace(F.get(parts, 1), "^/+", "").alias("path"))
    for folder in skip:
        found = found.filter(~F.contains("path", F.lit(folder)))
    return found


def read_speaker_info(spark: SparkSession, path: str) -> DataFrame:
    """`speaker` and `gender` from white-space tables in many files, the first of each speaker."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.ltrim("value").startswith(";")).select(F.lower(F.get(parts, 0)).alias("speaker"), F.lower(F.get(parts, 1)).alias("g"))
    rows = rows.select("speaker", F.when(F.col("g").startswith("m"), "male").when(F.col("g").startswith("f"), "female").alias("gender")).filter("gender is not null")
    return dedupe(rows, ["speaker"], ["gender"], "first")


def list_audio(spark: SparkSession, root: str, kinds: Sequence[str] = ("wav", "flac", "mp3")) -> DataFrame:
    """Paths and sizes of audio files below a folder; their bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin(*kinds))


def read_mix_metadata(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Metadata of mixtures, one file each, and the files that cannot be read."""
    rows = spark.read.schema(MIX_METADATA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    rows = rows.withColumn("file", F.input_file_name())
    bad = F.col("_corrupt_record").isNotNull() | F.col("mix_id").isNull()
    return rows.filter(~bad).drop("_corrupt_record"), rows.filter(bad).select("file")


def read_sidecar_text(spark: SparkSession, folder: str) -> DataFrame:
    """Audio paths with the text of the file of the same name."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("stem"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))
    audio = list_audio(spark, folder, ("wav",)).select(F.col("path").alias("audio_path"), stem(F.col("path")).alias("stem"))
    plain = lambda df: df.withColumn("stem", F.regexp_replace("stem", r"^file:/+", "/"))
    return plain(audio).join(plain(texts), "stem").select("audio_path", "text")


def read_prompts_gz(spark: SparkSession, path: str) -> DataFrame:
    """`utt_id`, `text` and the split from the file's name, of `id text` lines."""
    parts = F.split(F.trim("value"), " ", 2)
    rows = spark.read.text(path).withColumn("split", split_from_filename(F.col("_metadata.file_name"), "train", anywhere=True))
    return rows.select(F.get(parts, 0).alias("utt_id"), F.trim(F.get(parts, 1)).alias("text"), "split").filter("text <> ''")


def read_urls(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct links of a column, in the order in which they first stand."""
    rows = spark.read.option("header", True).csv(path)
    if column not in rows.columns:
        raise ValueError(f"missing column: {column}")
    numbered = rows.select(F.trim(column).alias("url"), F.monotonically_increasing_id().alias("place")).filter("url <> ''")
    return dedupe(numbered, ["url"], ["place"], "first")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").schema(LEDGER).csv(path)


def pick_text_column(df: DataFrame, names: Sequence[str] = ("text", "transcription", "transcript", "sentence")) -> DataFrame:
    """`text` from the first of the columns that has a value."""
    have = [n for n in names if n in df.columns]
    return df.withColumn("text", F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in have]))
