"""Error rates: by words, by speakers in their best order, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import align


def ref_hyp_join(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """Pairs of reference and hypothesis; a reference without a hypothesis raises an error."""
    both = ref.join(hyp.withColumn("_found", F.lit(True)), key, "left")
    return both.filter(F.assert_true(F.col("_found").isNotNull(), F.concat(F.lit("no hypothesis for "), F.col(key).cast("string"))).isNull()).drop("_found")


def wer(df: DataFrame, ref: str = "ref", hyp: str = "hyp", group: tuple[str, ...] = ()) -> DataFrame:
    """Errors over reference words of all rows together, in percent. Texts are scored where they are read and don't move."""
    scored = df.select(*group, F.size(ref).alias("_words"), align.edit_distance(ref, hyp).alias("_errors"))
    sums = scored.groupBy(*group).agg(F.count("*").alias("utterances"), F.sum(F.col("_errors").cast("bigint")).alias("errors"), F.sum("_words").alias("ref_words"))
    return sums.withColumn("wer", F.round(100 * F.col("errors") / F.greatest(F.lit(1), F.col("ref_words")), 6))


def wer_breakdown(df: DataFrame, ref: str = "ref", hyp: str = "hyp", group: tuple[str, ...] = ()) -> DataFrame:
    scored = df.select(*group, align.error_breakdown(ref, hyp).alias("e"))
    return scored.groupBy(*group).agg(*[F.sum(f"e.{c}").alias(c) for c in ("subs", "ins", "dels", "ref_words")])


def cpwer(df: DataFrame, ref: str = "ref_per_speaker", hyp: str = "hyp_per_speaker") -> DataFrame:
    """Rows with errors, reference words, the best order and the rate for lists of words of each speaker."""
    out = df.withColumn("_s", align.permuted_errors(ref, hyp)).select("*", "_s.*").drop("_s")
    return out.withColumn("cpwer", F.when(F.col("ref_words") > 0, F.col("errors") / F.col("ref_words")).when(F.col("errors") == 0, 0.0).otherwise(float("inf")))


def score_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("cuts"), F.sum("errors").alias("errors"), F.sum("ref_words").alias("ref_words"), F.sum("subs").alias("subs"), F.sum("ins").alias("ins"), F.sum("dels").alias("dels")
    ).withColumn("cpwer", F.round(F.col("errors") / F.greatest(F.lit(1), F.col("ref_words")), 6))
