"""WAV bytes: header probe, normalization to mono 16-bit, and frame energies, a batch job over rows of bytes."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.plans.cluster import checkpoint

FRAME_SEC, HOP_SEC = 0.03, 0.01


#: Chunks before the samples that a header is searched through.
MOST_CHUNKS = 64


def unsigned(data: Column, at: Column, size: int) -> Column:
    """The whole number of `size` bytes from byte `at` on, the least byte first; null where there are fewer."""
    digits = F.hex(F.substring(data, at + 1, F.lit(size)))
    turned = F.concat(*[F.substring(digits, F.lit(2 * k + 1), F.lit(2)) for k in reversed(range(size))])
    return F.when(F.length(digits) == 2 * size, F.conv(turned, 16, 10).cast("bigint"))


def probe_wav(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Frames, rate, channels, seconds, or the error, of each file, from its header: chunks are walked from one to the next up to that of the samples."""
    data, none = F.col(content), F.lit(None).cast("bigint")
    tag = lambda at: F.substring(data, at + 1, F.lit(4)).cast("string")
    start = F.struct(F.lit(12).cast("bigint").alias("at"), none.alias("channels"), none.alias("rate"), none.alias("align"), none.alias("bytes"))

    def step(s: Column, _: Column) -> Column:
        size, at = unsigned(data, s["at"] + 4, 4), s["at"]
        over = s["bytes"].isNotNull() | size.isNull()
        is_format, is_data = tag(at) == "fmt ", tag(at) == "data"
        field = lambda name, place, width: F.when(~over & is_format, unsigned(data, at + 8 + place, width)).otherwise(s[name]).alias(name)
        return F.struct(
            F.when(over | is_data, at).otherwise(at + 8 + size + size % 2).alias("at"), field("channels", 2, 2), field("rate", 4, 4), field("align", 12, 2), F.when(~over & is_data, size).otherwise(s["bytes"]).alias("bytes")
        )

    found = df.select(F.col(path).alias("path"), F.aggregate(F.sequence(F.lit(1), F.lit(MOST_CHUNKS)), start, step).alias("h"), ((tag(F.lit(0)) == "RIFF") & (tag(F.lit(8)) == "WAVE")).alias("is_wave"))
    h = F.col("h")
    error = (
        F.when(~F.coalesce("is_wave", F.lit(False)), "no WAV file").when(h["rate"].isNull() | h["align"].isNull(), "no format").when(h["bytes"].isNull(), "no samples").when((h["rate"] == 0) | (h["align"] == 0) | (h["channels"] == 0), "bad format")
    )
    found = found.withColumn("error", error)
    fine = lambda c: F.when(F.col("error").isNull(), c)
    frames = F.floor(h["bytes"] / h["align"])
    return found.select("path", fine(frames).alias("frames"), fine(h["rate"].cast("int")).alias("rate"), fine(h["channels"].cast("int")).alias("channels"), fine(frames / h["rate"]).alias("duration_sec"), "error")


def samples_of(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1, and their rate."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(1), rate


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    if rate == to or not len(x):
        return x
    n = max(1, round(len(x) * to / rate))
    return np.interp(np.arange(n) * (rate / to), np.arange(len(x)), x).astype(np.float32)


def to_wav(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def normalize_audio(df: DataFrame, rate: int = 16000, path: str = "path", content: str = "content") -> DataFrame:
    """Each file as mono 16-bit WAV of the rate, its samples, or the error."""

    def convert(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for p, data in zip(pdf[path], pdf[content]):
                try:
                    x = resampled(*samples_of(data), rate)
                    rows.append((p, to_wav(x, rate), len(x), None))
                except Exception as e:
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "wav", "num_samples", "error"]).astype({"num_samples": "Int64"})

    return df.select(path, content).mapInPandas(convert, "path string, wav binary, num_samples long, error string")


def frame_energy(df: DataFrame, path: str = "path", content: str = "content", frame: float = FRAME_SEC, hop: float = HOP_SEC) -> DataFrame:
    """The mean square of each frame, at its middle; files that are no WAV have no frames."""

    def energies(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for p, data in zip(pdf[path], pdf[content]):
                try:
                    x, rate = samples_of(data)
                except Exception:
                    continue
                size, step = int(frame * rate), int(hop * rate)
                if len(x) >= size:
                    sums = np.concatenate([[0], np.cumsum(x.astype(np.float64) ** 2)])
                    at = np.arange(0, len(x) - size + 1, step)
                    yield pd.DataFrame({"src": p, "at_sec": (at + size // 2) / rate, "energy": (sums[at + size] - sums[at]) / size})

    return df.select(path, content).mapInPandas(energies, "src string, at_sec double, energy double")


def extract_shards(rows: DataFrame, dataset: str, split: str, rate: int = 16000) -> tuple[DataFrame, DataFrame]:
    """Manifest rows, with their WAV bytes, of shard rows (`source_file`, `source_row`, `source_audio_path`, `audio_bytes`, `text`), and the failures of each shard."""
    from voxloom.functions.names import row_utt_id, wav_name
    from voxloom.functions.text import upper_text

    named = rows.withColumn("utt_id", row_utt_id(F.lit(dataset), F.lit(split), F.coalesce(F.regexp_extract("source_file", r"(\d+)", 1).try_cast("int"), F.lit(0)), "source_row"))
    audio = normalize_audio(named.select(F.col("utt_id").alias("path"), F.col("audio_bytes").alias("content")), rate).withColumnRenamed("path", "utt_id")
    both = named.drop("audio_bytes").join(audio, "utt_id")
    good = both.filter("error is null").select("utt_id", F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), wav_name("source_audio_path", "utt_id").alias("audio_path"), upper_text("text").alias("text"), "source_file", "source_row", "num_samples", "wav")
    state = both.groupBy("source_file").agg(F.count("*").alias("rows"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return good, state


LEDGER = "source_file string, rows bigint, failed bigint"


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The finished shards below `root`; none where there is no ledger."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{root}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def finish(state: DataFrame, root: str) -> None:
    """Note shards as finished, after their rows are written."""
    state.coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def extract_shards_to(rows: DataFrame, root: str, dataset: str, split: str, rate: int = 16000, at_once: int = 64, most: int | None = None) -> DataFrame:
    """`extract_shards` of all shards that the ledger below `root` does not have, about `at_once` in a round, `most` shards at most; the ledger then.

    A round writes the rows of its shards, a folder for each, and then notes the shards. A run that dies before leaves rows of shards that are not noted: `extracted` does
    not read them, and the next run writes their folders anew, so that each row is there once.
    """
    spark = rows.sparkSession
    todo = rows.select("source_file").distinct().join(ledger(spark, root).select("source_file"), "source_file", "left_anti")
    todo = checkpoint(todo.orderBy("source_file").limit(most) if most is not None else todo)
    parts = -(-todo.count() // at_once)
    for i in range(parts):
        own = todo.filter(F.pmod(F.xxhash64("source_file"), F.lit(parts)) == i)
        good, state = extract_shards(rows.join(own, "source_file", "left_semi"), dataset, split, rate)
        good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(f"{root}/rows")
        finish(state, root)
    return ledger(spark, root)


def extracted(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the shards that are noted as finished."""
    rows = spark.read.option("recursiveFileLookup", False).parquet(f"{root}/rows")
    return rows.withColumn("source_file", F.col("source_file").cast("string")).join(ledger(spark, root).select("source_file"), "source_file", "left_semi")
