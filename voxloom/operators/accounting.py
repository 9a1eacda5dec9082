"""Hours, acceptance, funnels, histograms and other counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.text import safe_time


def hours(df: DataFrame, mode: str = "auto") -> DataFrame:
    """Rows, unique rows, duplicates, bad durations and hours: in all, by dataset, and by dataset and split.

    The key is utt_id, else the path; `mode` "utt_id" keeps every row without an id, "none" every row.
    """
    uid, path = F.nullif(F.trim("utt_id"), F.lit("")), F.nullif(F.trim("audio_path"), F.lit(""))
    own = F.concat(F.lit("row:"), F.monotonically_increasing_id().cast("string"))
    if mode == "none":
        key = own
    elif mode == "utt_id":
        key = F.coalesce(F.concat(F.lit("utt:"), uid), own)
    else:
        key = F.coalesce(F.concat(F.lit("utt:"), uid), F.concat(F.lit("path:"), path), own)
    keyed = df.select("dataset", "split", key.alias("key"), safe_time("duration_sec", -1.0).alias("sec"))
    unique = keyed.groupBy("key").agg(F.min(F.struct("dataset", "split", "sec")).alias("r"), F.count("*").alias("n"))
    rows = unique.select("r.*", "n").withColumn("good", F.col("sec") > 0)
    out = rows.rollup("dataset", "split").agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("unique_rows"),
        (F.sum("n") - F.count("*")).alias("duplicates"),
        F.count_if(~F.col("good")).alias("bad"),
        F.round(F.sum(F.when(F.col("good"), F.col("sec")).otherwise(0.0)) / 3600, 6).alias("hours"),
        F.grouping_id().cast("int").alias("level"),
    )
    return out


def funnel(stages: Mapping[str, DataFrame], column: str = "duration_sec") -> DataFrame:
    """Rows and hours of each stage of the pipeline, in its order; what is no number counts as 0."""
    tagged = [t.select(F.lit(i).alias("place"), F.lit(name).alias("stage"), F.coalesce(F.col(column).try_cast("double"), F.lit(0.0)).alias("sec")) for i, (name, t) in enumerate(stages.items())]
    return reduce(DataFrame.union, tagged).groupBy("place", "stage").agg(F.count("*").alias("rows"), F.round(F.sum("sec") / 3600, 6).alias("hours"))


def acceptance(df: DataFrame, combined: DataFrame) -> DataFrame:
    """Segments, accepted, combined, and rates of both."""
    one = df.agg(F.count("*").alias("segments"), F.count_if("accepted").alias("accepted"))
    two = combined.agg(F.count("*").alias("combined"))
    rate = lambda c: F.round(100 * F.col(c) / F.greatest("segments", F.lit(1)), 6)
    return one.join(F.broadcast(two)).withColumns({"accept_rate": rate("accepted"), "combined_rate": rate("combined")})


def reason_counts(df: DataFrame, n: int = 20, column: str = "decision_reason") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), column).limit(n)


def pool_summary(df: DataFrame) -> DataFrame:
    """Rows of each pool by split, and the mixtures that they suggest."""
    found = df.groupBy("pool").pivot("split", ["train", "val", "test"]).count().na.fill(0)
    size = F.when(F.col("pool") == "single", 1).when(F.col("pool") == "overlap2", 2).otherwise(3)
    return found.withColumns({f"target_{s}": F.floor(F.col(s) / size) for s in ("train", "val", "test")})


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def histogram(df: DataFrame, column: str, bin_size: float, negative: bool = False) -> DataFrame:
    """Bin centres, their probabilities, and the number of samples. Bins are cut towards zero, so those beside it have own centres."""
    x = F.col(column).cast("double")
    if not negative:
        x = F.when(F.assert_true((x >= 0) | x.isNull(), F.lit("negative samples are not allowed")).isNull(), x)
    half = F.when(x >= 0, bin_size / 2).otherwise(-bin_size / 2)
    bins = df.filter(F.col(column).isNotNull()).select(((x / bin_size).cast("bigint") * bin_size + half).alias("bin")).groupBy("bin").agg(F.count("*").alias("rows"))
    total = bins.agg(F.sum("rows").alias("n"))
    return bins.join(F.broadcast(total)).select("bin", (F.col("rows") / F.col("n")).alias("prob"), "n")


def hist_stats(h: DataFrame, bin_size: float) -> DataFrame:
    mean = h.agg(F.sum(F.col("bin") * F.col("prob")).alias("mean"))
    found = h.join(F.broadcast(mean)).groupBy("mean").agg(
        (F.min("bin") - bin_size / 2).alias("low"), (F.max("bin") + bin_size / 2).alias("high"), F.sum(F.col("prob") * F.pow(F.col("bin") - F.col("mean"), 2)).alias("variance")
    )
    return found.withColumn("sd", F.sqrt("variance"))


def hist_cdf(h: DataFrame, bin_size: float, values: Sequence[float]) -> DataFrame:
    """The distribution function at the values, linear inside a bin. Bins are bounded by the range over the bin size."""
    points = h.sparkSession.createDataFrame([(float(v),) for v in values], "value double")
    low, high = F.col("bin") - bin_size / 2, F.col("bin") + bin_size / 2
    part = F.when(F.col("value") >= high, 1.0).when(F.col("value") <= low, 0.0).otherwise((F.col("value") - low) / bin_size)
    spread = h.withColumn("value", F.explode(F.array(*[F.lit(float(v)) for v in values])))
    found = spread.groupBy("value").agg(F.round(F.sum(F.col("prob") * part), 9).alias("cdf"))
    return points.join(found, "value", "left").na.fill(0.0, ["cdf"])


def tv_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half the sum of the absolute differences of two histograms."""
    both = a.select("bin", F.col("prob").alias("p")).join(b.select("bin", F.col("prob").alias("q")), "bin", "full")
    return both.agg(F.round(F.coalesce(0.5 * F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))), F.lit(0.0)), 9).alias("distance"))


def kept_hours(df: DataFrame, thresholds: Sequence[float], column: str = "duration_sec") -> DataFrame:
    """Hours and rows that stay at each least length: one pass, a column for each threshold, then rows."""
    sums = [F.sum(F.when(F.col(column) >= t, F.col(column)).otherwise(0.0)).alias(f"s{i}") for i, t in enumerate(thresholds)]
    rows = [F.count_if(F.col(column) >= t).alias(f"n{i}") for i, t in enumerate(thresholds)]
    one = df.agg(*sums, *rows)
    items = [F.struct(F.lit(float(t)).alias("min_sec"), F.col(f"n{i}").alias("rows"), F.round(F.col(f"s{i}") / 3600, 6).alias("hours")) for i, t in enumerate(thresholds)]
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def dataset_weights(df: DataFrame, hours_of: DataFrame) -> DataFrame:
    """Each dataset's share of the hours; a dataset without hours counts as 1."""
    found = df.select("dataset").distinct().join(hours_of, "dataset", "left").withColumn("w", F.coalesce("hours", F.lit(1.0)))
    total = found.agg(F.sum("w").alias("total"))
    return found.join(F.broadcast(total)).select("dataset", F.round(F.col("w") / F.col("total"), 9).alias("weight"))


def ledger_totals(df: DataFrame) -> DataFrame:
    done = F.col("status") == "DONE"
    return df.agg(F.count_if(done).alias("done"), F.count("*").alias("entries"), F.coalesce(F.sum(F.when(done, F.col("compressed_bytes"))), F.lit(0)).alias("done_bytes"))


def is_done(df: DataFrame, names: DataFrame) -> DataFrame:
    """Whether the ledger has a finished entry for each name."""
    done = df.filter(F.col("status") == "DONE").select("name").distinct().withColumn("_done", F.lit(True))
    return names.join(done, "name", "left").withColumn("is_done", F.coalesce("_done", F.lit(False))).drop("_done")


def merged_text(df: DataFrame, key: str) -> DataFrame:
    """The texts of each mixture in order of their starts, joined by bars."""
    ordered = F.sort_array(F.collect_list(F.struct("start_sec", "utt_id", "text")))
    return df.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " | ").alias("text"))


def observation_length(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(F.col("offset") + F.col("num_samples")).alias("observation"))


def batch_audit(batches: DataFrame) -> DataFrame:
    return batches.groupBy("batch").agg(F.count("*").alias("cuts"), F.sum("duration_sec").alias("sec"), F.every(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank")).agg(
        F.count("*").alias("batches"), F.sum("cuts").alias("cuts"), F.round(F.sum("sec") / 3600, 6).alias("hours"), F.count_if("blank").alias("blank_batches")
    )


def segmentation_stats(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Regions and seconds at each stage of the segmentation."""
    tagged = [t.select(F.lit(i).alias("place"), F.lit(name).alias("stage"), F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.0)).alias("sec")) for i, (name, t) in enumerate(stages.items())]
    return reduce(DataFrame.union, tagged).groupBy("place", "stage").agg(F.count("*").alias("regions"), F.round(F.sum("sec"), 6).alias("seconds"))


def running_hours(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("hours_so_far", F.round(F.sum("duration_sec").over(upto) / 3600, 6))
