"""Dedupe, resume, verify, filter, choose, order and set operations on manifests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import names
from voxloom.functions import text as tx
from voxloom.functions.hashing import hash01, uniform
from voxloom.schemas import WIDE_MANIFEST, conform


def dedupe(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row for each key: the first or last by `order`, ties by all columns.

    The row is picked by an aggregate, which combines on the map side, so that a key with very many rows is no task of its own.
    """
    pick = F.max if keep == "last" else F.min
    rest = [c for c in df.columns if c not in (*key, *order)]
    whole = F.struct(*[F.col(f"`{c}`") for c in (*order, *rest)])
    found = df.groupBy(*key).agg(pick(whole).alias("_row"))
    return found.select(*[F.col(f"`{c}`") if c in key else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def prefer_variant(df: DataFrame, path: str = "path", suffix: str = "_16k") -> DataFrame:
    """One file for each stem: the one with the suffix if there is one."""
    stem = F.regexp_replace(F.col(path), r"\.[^./]*$", "")
    bare = F.regexp_replace(stem, rf"{suffix}$", "")
    found = df.withColumns({"_stem": bare, "_plain": ~stem.endswith(suffix)})
    return dedupe(found, ["_stem"], ["_plain", path], "first").drop("_stem", "_plain")


def resume(pending: DataFrame, done: DataFrame, key: Sequence[str], force: bool = False) -> DataFrame:
    """Rows whose key is not done yet; all of them if forced."""
    return pending if force else pending.join(done.select(*key).distinct(), list(key), "left_anti")


def verify_exists(df: DataFrame, listing: DataFrame, path: str = "audio_path") -> tuple[DataFrame, DataFrame]:
    """The rows whose file is listed, and the rows whose file is not."""
    listed = listing.select(F.col("path").alias(path)).distinct()
    return df.join(listed, path, "left_semi"), df.join(listed, path, "left_anti")


def by_priority(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """One row for each key, from the first table that has it."""
    ranked = [t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return dedupe(every, [key], ["_rank"], "first").drop("_rank")


def corpus_join(speakers: DataFrame, chapters: DataFrame, transcripts: DataFrame, audio: DataFrame) -> DataFrame:
    """Segments with their chapter, speaker and transcript; those without a transcript go."""
    return audio.join(transcripts, "segment").join(chapters, "chapter").join(speakers, "speaker")


def attach_by_prefix(df: DataFrame, info: DataFrame, id_column: str, length: int, key: str) -> DataFrame:
    """Columns of `info`, whose key is a prefix of the id."""
    return df.withColumn(key, F.substring(id_column, 1, length)).join(info, key, "left")


def filter_duration(df: DataFrame, low: float = 1.0, high: float = 20.0, column: str = "duration_sec", rate: int | None = None) -> DataFrame:
    seconds = F.col(column) / rate if rate else F.col(column)
    return df.filter(seconds.between(low, high))


def filter_local_wav(df: DataFrame, path: str = "audio_path") -> DataFrame:
    return df.filter(~F.contains(path, F.lit("://")) & F.lower(path).endswith(".wav"))


def filter_target(df: DataFrame, part: str, path: str = "denoised_path") -> DataFrame:
    """The first rejected row, by path, whose path has the part."""
    return df.filter(~F.col("accepted") & F.contains(path, F.lit(part))).orderBy(path).limit(1)


def row_guard(df: DataFrame, required: Sequence[str], positive: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the bad ones with the first reason against them."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    reasons = [(blank(c), f"missing {c}") for c in required]
    reasons += [(F.coalesce(F.col(c).try_cast("double"), F.lit(-1.0)) <= 0, f"invalid {c}") for c in positive]
    reason = reduce(lambda out, x: out.when(x[0], x[1]), reasons[1:], F.when(reasons[0][0], reasons[0][1]))
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def drop_pronounced_punct(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose transcript has no word for a spoken mark."""
    return df.filter(~tx.pronounced_punct(text))


def build_manifest(transcripts: DataFrame, dataset: str, split: str, root: str, listing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Wide manifest rows from `file`, `line`, `utt_id` and `text`, and the rows that are none, with the reason.

    Rows without an id or a text are bad. With `listing` (`path`), rows whose audio is not listed are missing.
    """
    good, bad = row_guard(transcripts, ["utt_id", "text"])
    path = names.audio_path_of(root, F.lit(split), "utt_id")
    rows = good.select(
        F.concat_ws("__", F.lit(dataset), F.lit(split), F.trim("utt_id")).alias("utt_id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), path.alias("audio_path"), F.trim("text").alias("text"),
        F.concat_ws("::", F.lit(dataset), F.trim("utt_id")).alias("recording_id"), F.lit(0.0).alias("start_sec"), F.col("file").alias("source_file"), F.col("line").cast("bigint").alias("source_row"), path.alias("source_audio_path"),
    )
    rejected = bad.select(F.col("file").alias("source_file"), F.col("line").cast("bigint").alias("source_row"), "reason")
    if listing is not None:
        rows, missing = verify_exists(rows, listing)
        rejected = rejected.unionByName(missing.select("source_file", "source_row", F.lit("missing audio").alias("reason")))
    return conform(rows, WIDE_MANIFEST), rejected


def manifest_from_accepted(accepted: DataFrame, dataset: str, split: str) -> DataFrame:
    """Manifest rows of accepted audio (`final_wav`, `final_text`), with ids from the path; rows without a path or a text go."""
    rows = accepted.select(F.trim("final_wav").alias("audio_path"), F.trim("final_text").alias("text")).filter("audio_path <> '' and text <> ''")
    return rows.select(names.path_utt_id(F.lit(dataset), F.lit(split), "audio_path").alias("utt_id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), "audio_path", "text")


def fail_guard(df: DataFrame, shard: str, failed: Column, share: float = 0.5, least: int = 10) -> DataFrame:
    """Shards to keep, not to prune: of at least `least` rows, more than `share` failed."""
    found = df.groupBy(shard).agg(F.count("*").alias("rows"), F.count_if(failed).alias("failed"))
    return found.filter((F.col("rows") >= least) & (F.col("failed") > share * F.col("rows")))


def select_datasets(df: DataFrame, include: Sequence[str], dataset: str = "dataset") -> DataFrame:
    return df.filter(F.col(dataset).isin(*include))


def select_candidate(df: DataFrame) -> DataFrame:
    """The output to take for `raw`: a number output where numbers were spelled and its words are kept, the main one, the strict one, else `raw`; with punctuation if that keeps the words."""
    kept = lambda c, numbers=False: F.col(c).isNotNull() & tx.words_preserved("raw", c, numbers)
    chosen = (
        F.when(tx.number_words("raw") & kept("number", True) & tx.has_digit("number"), F.struct(F.lit("number").alias("kind"), F.col("number").alias("text")))
        .when(kept("main", True), F.struct(F.lit("main").alias("kind"), F.col("main").alias("text")))
        .when(kept("strict", True), F.struct(F.lit("strict").alias("kind"), F.col("strict").alias("text")))
        .otherwise(F.struct(F.lit("raw").alias("kind"), F.col("raw").alias("text")))
    )
    df = df.withColumn("_chosen", chosen).withColumns({"kind": F.col("_chosen.kind"), "chosen": F.col("_chosen.text")}).drop("_chosen")
    better = F.col("punctuated").isNotNull() & tx.words_preserved("chosen", "punctuated") & (tx.punct_count("punctuated") > tx.punct_count("chosen"))
    return df.withColumns({"kind": F.when(better, F.concat("kind", F.lit("+punct"))).otherwise(F.col("kind")), "chosen": F.when(better, F.col("punctuated")).otherwise(F.col("chosen"))})


def quality_check(df: DataFrame) -> DataFrame:
    """Whether a mixture's overlap fits its number of speakers."""
    two = (F.col("ov2") >= 0.10) & (F.col("max_active") >= 2)
    three = (F.col("ov2") >= 0.15) & (F.col("ov3") >= 0.02) & (F.col("max_active") >= 3)
    one = F.col("ov2") == 0
    return df.withColumn("pass_all", F.when(F.col("num_speakers") <= 1, one).when(F.col("num_speakers") == 2, two).otherwise(three))


def unify_paths(df: DataFrame, accepted: DataFrame, listing: DataFrame, folder: str, path: str = "final_wav") -> DataFrame:
    """Paths rewritten into one folder, and whether each was there already, is to copy, existed under the name, or is missing."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    target = F.concat(F.lit(folder.rstrip("/") + "/"), name)
    there = accepted.select(F.col("path").alias("_target")).distinct().withColumn("_there", F.lit(True))
    listed = listing.select(F.col("path").alias(path)).distinct().withColumn("_listed", F.lit(True))
    found = df.withColumn("_target", target).join(there, "_target", "left").join(listed, path, "left")
    status = F.when(F.col(path) == F.col("_target"), "already").when(F.col("_there"), "existed").when(F.col("_listed"), "copied").otherwise("missing")
    return found.withColumn("status", status).withColumn("unified_path", F.when(F.col("status") == "missing", F.col(path)).otherwise(F.col("_target"))).drop("_target", "_there", "_listed")


def progress(expected: DataFrame, done: DataFrame) -> DataFrame:
    """Done and expected mixtures, and their percentage, for each type and split."""
    both = expected.join(done, ["mix_type", "split"], "full")
    counts = both.select("mix_type", "split", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("done", F.lit(0)).alias("done"))
    return counts.withColumn("percent", F.round(100 * F.col("done") / F.greatest("expected", F.lit(1)), 6))


def expected_mixes(df: DataFrame, shards: int | None = None, key: str = "utt_id") -> DataFrame:
    """Mixtures that pools can give: rows over speakers, rounded down for each pool, or for each shard of it."""
    size = F.when(F.col("pool") == "single", 1).when(F.col("pool") == "overlap2", 2).otherwise(3)
    groups = ["pool", "split"]
    if shards:
        from voxloom.functions.hashing import hash_bucket

        df, groups = df.withColumn("shard", hash_bucket(key, shards)), [*groups, "shard"]
    found = df.groupBy(*groups).agg(F.count("*").alias("n")).withColumn("n", F.floor(F.col("n") / size))
    return found.groupBy(F.col("pool").alias("mix_type"), "split").agg(F.sum("n").alias("expected"))


def sample_rows(df: DataFrame, k: int, seed: str = "sample", key: str = "utt_id", text: str = "text", min_tokens: int = 1) -> DataFrame:
    """k eligible rows, each set of k as likely as another."""
    return df.filter(F.size(tx.canonical_tokens(text)) >= min_tokens).orderBy(F.md5(F.concat_ws("__", F.lit(seed), F.col(key).cast("string"))), key).limit(k)


def head_per(df: DataFrame, key: str, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows of each key. Spark turns the rank limit into a limit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def longest_rejects(df: DataFrame, n: int, reason: str | None = None) -> DataFrame:
    rejected = df.filter(~F.col("accepted"))
    return (rejected.filter(F.col("decision_reason") == reason) if reason else rejected).orderBy(F.desc("duration_sec"), "denoised_path").limit(n)


def best_candidate(df: DataFrame, key: str) -> DataFrame:
    """The candidate of each key with the most speakers at once, then the most overlap."""
    rest = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(rest, F.struct("max_active", "ov3", "ov2", "candidate")).alias("best")).select(key, "best.*")


def longest_first(df: DataFrame, key: str, column: str = "duration_sec") -> DataFrame:
    return df.orderBy(F.desc(column), key)


def rank_settings(df: DataFrame) -> DataFrame:
    """Settings from the best error rate to the worst; the best is flagged."""
    best = df.agg(F.min("wer").alias("_best"))
    return df.join(F.broadcast(best)).withColumn("is_best", F.col("wer") == F.col("_best")).drop("_best").orderBy("wer", "setting")


def unknown_examples(df: DataFrame, n: int, longest: int = 280) -> DataFrame:
    return df.filter("unknown > 0").orderBy("utt_id").limit(n).select("utt_id", "unknown", F.substring("text", 1, longest).alias("text"))


def subset(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def merge_manifests(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of the manifests; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def combine(accepted: DataFrame, salvaged: DataFrame, key: str = "final_wav") -> DataFrame:
    """Both together; of a path in both the salvaged row stays."""
    both = accepted.withColumn("_source", F.lit(0)).unionByName(salvaged.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    return dedupe(both, [key], ["_source"], "last").drop("_source")


def merge_distinct(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """The rows of the tables in their order, the first of each key."""
    return by_priority(tables, key)


def weighted_interleave(tables: Sequence[DataFrame], weights: Sequence[float], key: str, seed: str = "mux") -> DataFrame:
    """All rows in an order in which tables stand by their weights: each row's place is -ln(u) / w."""
    marked = []
    for i, (t, w) in enumerate(zip(tables, weights)):
        u = F.greatest(hash01(F.concat_ws("__", F.lit(f"{seed}{i}"), F.col(key).cast("string"))), F.lit(1e-12))
        marked.append(t.withColumns({"origin": F.lit(i), "place": -F.log(u) / w}))
    return merge_manifests(marked).orderBy("place", "origin", key)


def exclude_eval(train: DataFrame, evaluation: DataFrame, separate: bool, key: str = "utt_id") -> DataFrame:
    """Training rows; evaluation rows join them only where folders are shared, and their keys never stay in training otherwise."""
    return train.join(evaluation.select(key).distinct(), key, "left_anti") if separate else train.unionByName(evaluation)


def leaked(train: DataFrame, evaluation: DataFrame, key: str = "utt_id") -> DataFrame:
    return train.join(evaluation.select(key).distinct(), key, "left_semi")


def chunk_rows(df: DataFrame, chunks: int, order: Sequence[str]) -> DataFrame:
    """Contiguous chunks of equal size (the last may be smaller), numbered from 0.

    Rows are ordered by ranges; each partition's first place is the count before it, so no task sees all rows.
    """
    numbered = global_number(df, order)
    total = df.count()
    return numbered.withColumn("chunk", F.floor((F.col("number") - 1) / max(1, -(-total // chunks))).cast("int")).drop("number")


def global_number(df: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """`name`: each row's place by `order`, from 1, by range partitions and their counts."""
    from voxloom.plans.cluster import checkpoint

    ranged = checkpoint(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, inside).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def number_rows(df: DataFrame, key: str, order: Sequence[str], name: str = "run_idx", start: int = 0) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1 + start)


def majority_rate(df: DataFrame, column: str = "sample_rate") -> DataFrame:
    """Rows with the most common rate; of several the lowest."""
    common = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(1).select(column)
    return df.join(F.broadcast(common), column, "left_semi")


def pick_by_hash(df: DataFrame, key: str, share: float, salt: str) -> DataFrame:
    return df.filter(uniform(F.col(key), salt) < share)
