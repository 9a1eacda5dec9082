"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import cotraining, decontaminate, exact_dedup, html_crf, language_id, lexical_search, line_quality, oracles, order_minhash, secret_scan, spelling, temperature_mix, toxicity, url_filter
from voxloom.llm._learn import fold_of
from voxloom.llm._spark import checkpoint, shared_folder, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_quality.clean_documents(docs, cleaned=False)


def op3_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.scan_secrets(docs))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    return language_id.identify(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang").filter(~held_out), held_out)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = checkpoint(table(spark, sf_dir, "documents").select("doc_id", "source", temperature_mix.words_in("text").alias("words")))
    return temperature_mix.mix(counted, tokens="words").drop("words")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return order_minhash.near_duplicates(docs).select("doc_id", "class_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out), held_out)


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, delivered to a new index in two parts: the lower half of ids, then the rest and rows without an id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    half = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    first = F.coalesce(F.col("doc_id") <= F.lit(half), F.lit(False))
    rows = exact_dedup.digests(docs, F.when(first, "first").otherwise("second"))
    index = exact_dedup.open_index(spark, f"{shared_folder(spark)}/digests-{uuid.uuid4().hex}")
    for delivery in ("first", "second"):
        exact_dedup.add(index, rows.filter(F.col("delivery") == delivery))
    return exact_dedup.decisions(index, rows).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_line_quality": op2_line_quality,
        "op3_html_crf": op3_html_crf,
        "op4_secret_scan": op4_secret_scan,
        "op5_language_id": op5_language_id,
        "op6_decontaminate": op6_decontaminate,
        "op7_temperature_mix": op7_temperature_mix,
        "op8_order_minhash": op8_order_minhash,
        "op9_toxicity": op9_toxicity,
        "op10_cotraining": op10_cotraining,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_lexical_search": op12_lexical_search,
        "op13_exact_dedup": op13_exact_dedup,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
