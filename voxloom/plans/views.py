"""Views over the driver's tables that stand in for corpora: as DataFrames, and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text as tx
from voxloom.functions.hashing import hash01, hash_bucket, split_by_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    split = split_by_hash(hash01("doc_id"), 0.90, 0.05)
    return docs.select(
        "doc_id",
        F.concat_ws("__", "source", split, F.col("doc_id").cast("string")).alias("utt_id"),
        F.col("source").alias("dataset"),
        split.alias("split"),
        F.concat(F.lit("/audio/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("audio_path"),
        F.concat(F.lit("spk"), (F.col("doc_id") % 97).cast("string")).alias("speaker_id"),
        "text",
        (F.col("n_chars") / 15.0).alias("duration_sec"),
    )


def edited(doc: Column, i: Column) -> Column:
    """Whether the second recognizer differs at word i: about a tenth of the words of three quarters of the documents."""
    i = i.cast("bigint")
    return (doc % 4 != 3) & ((doc * 7919 + i * i * 31 + i * 17) % 97 < 10)


def hyp(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """All words of each document as `a`, and as `b` the same with edits: by the document other words, more and other words, fewer and other words, or none.

    New words stand in no document, and no document has both more and fewer words: each new word takes a change or an addition and each
    word lost a deletion, so that the fewest edits between `a` and `b` are those made here, kind by kind. `numbered` words end with
    their place, so that the longest common blocks, too, are what the edits have left.
    """
    return with_hyp(table(spark, sf_dir, "documents"), numbered).select("doc_id", "source", "a", "b")


def with_hyp(df: DataFrame, numbered: bool = False) -> DataFrame:
    """Documents with the words `a` and `b` of `hyp`."""
    words = F.filter(F.split(tx.normalize_words("text"), " "), lambda w: w != "")
    words = F.transform(words, lambda w, i: F.concat(w, F.lit("_"), i.cast("string"))) if numbered else words
    doc = F.col("doc_id")
    new = lambda i: F.concat(F.lit("zz"), doc.cast("string"), F.lit("q"), i.cast("string"))

    def at(w: Column, i: Column) -> Column:
        changed = F.when((doc % 4 == 0) | (i % 3 == 1), F.array(new(i))).when(doc % 4 == 1, F.array(w, new(i))).otherwise(F.array().cast("array<string>"))
        return F.when(edited(doc, i), changed).otherwise(F.array(w))

    return df.withColumn("a", words).withColumn("b", F.flatten(F.transform("a", at)))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), start.alias("start_sec"), (start + F.col("value")).alias("end_sec"), F.col("event_type").alias("speaker"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 60)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("src"), at.alias("frame_idx")).agg(F.max(F.col("event_type") != "error").alias("is_speech"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations in time: a word is a second, and each turn starts up to three seconds before the end of all turns before it."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.size(tx.canonical_tokens("text")).cast("double").alias("len"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("len").over(before), F.lit(0.0)))
    back = hash_bucket(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 4)
    start = F.greatest(F.lit(0.0), F.col("before") - back)
    return rows.select(F.col("conv_id").alias("meeting"), F.col("turn").alias("place"), F.col("role").alias("speaker"), start.alias("start"), (start + F.col("len")).alias("end"), "len", "text")


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 most frequent words in upper case, with the mark of a start, and all single characters."""
    from voxloom.operators.relational import number_rows
    from voxloom.plans.cluster import checkpoint

    words = table(spark, sf_dir, "documents").select(F.explode(F.split(tx.normalize_words("text"), " ")).alias("w")).filter("w <> ''")
    counts = checkpoint(words.groupBy(F.upper("w").alias("w")).count())
    top = counts.orderBy(F.desc("count"), "w").limit(500).select(F.concat(F.lit("▁"), F.col("w")).alias("token"))
    letters = counts.select(F.explode(F.split("w", "")).alias("token")).distinct()
    own = spark.createDataFrame([("▁",), ("<blk>",), ("<unk>",)], "token string")
    every = top.union(letters).union(own).filter("token <> ''").distinct().withColumn("g", F.lit(1))
    return number_rows(every, "g", ["token"], "id").drop("g")


#: The same views in DuckDB's SQL.
HASH = "('0x' || left(md5({0}::varchar), 8))::bigint"
_words = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"
SPLIT = f"case when {HASH.format('doc_id')} / 4294967295.0 < 0.90 then 'train' when {HASH.format('doc_id')} / 4294967295.0 < 0.90 + 0.05 then 'val' else 'test' end"
MANIFEST = f"""manifest as (select doc_id, source || '__' || {SPLIT} || '__' || doc_id utt_id, source dataset, {SPLIT} split, '/audio/' || source || '/' || doc_id || '.wav' audio_path,
  'spk' || (doc_id % 97) speaker_id, text, n_chars / 15.0 duration_sec from documents)"""
EDITED = "(doc_id % 4 <> 3 and (doc_id * 7919 + ({0}) * ({0}) * 31 + ({0}) * 17) % 97 < 10)"
HYP = f"""words as (select doc_id, source, list_filter(string_split(trim({_words.format('text')}), ' '), lambda w: w <> '') a from documents),
hyp as (select doc_id, source, a, flatten(list_transform(range(1, len(a) + 1), lambda i: case when not {EDITED.format('i - 1')} then [a[i]] when doc_id % 4 = 0 or (i - 1) % 3 = 1 then ['zz' || doc_id || 'q' || (i - 1)] when doc_id % 4 = 1 then [a[i], 'zz' || doc_id || 'q' || (i - 1)] else []::varchar[] end)) b,
  len(list_filter(range(0, len(a)), lambda i: {EDITED.format('i')})) edits, len(list_filter(range(0, len(a)), lambda i: {EDITED.format('i')} and (doc_id % 4 = 0 or i % 3 = 1))) changed from words)"""
NUMBERED_HYP = HYP.replace("lambda w: w <> '') a from documents)", "lambda w: w <> '') plain from documents), numbered as (select doc_id, source, list_transform(plain, lambda w, i: w || '_' || (i - 1)) a from words)").replace("changed from words)", "changed from numbered)")
UPPERED = f"""upper_words as (select doc_id, source, list_filter(string_split(trim({_words.format('text')}), ' '), lambda w: w <> '') w from documents),
top_words as (select upper(replace(w, 'ß', 'ss')) w, count(*) n from (select unnest(w) w from upper_words) group by 1),
vocab as (select token, row_number() over (order by token) - 1 id from (select '▁' || w token from (select w from top_words order by n desc, w limit 500) union select unnest(string_split(w, '')) from top_words union select unnest(['▁', '<blk>', '<unk>'])) where token <> '')"""
#: crc32 of a short text of ASCII: a fold over its bytes with the usual table.
CRC_TABLE = "crc_table as materialized (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) crcs)"
CRC = "xor(list_reduce(list_transform(string_split({0}, ''), lambda c: unicode(c)::bigint), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"
REGIONS = "regions as (select user_id src, epoch_us(ts) / 1e6 start_sec, epoch_us(ts) / 1e6 + value end_sec, event_type speaker from events)"
FRAMES = "frames as (select user_id src, floor(epoch_us(ts) / 1e6 / 60)::bigint frame_idx, max(event_type <> 'error') is_speech from events group by all)"
TOKENS = "(case when trim({w}) = '' then []::varchar[] else string_split(trim({w}), ' ') end)".replace("{w}", "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_À-ỹ]+', ' ', 'g')")
TURNS = f"""raw_turns as (select conv_id, turn, role, text, len({TOKENS.format('text')})::double len from conversations),
placed_turns as (select *, coalesce(sum(len) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0.0) before from raw_turns),
turns as (select conv_id meeting, turn place, role speaker, greatest(0.0, before - {HASH.format("(conv_id || ':' || turn)")} % 4) "start", greatest(0.0, before - {HASH.format("(conv_id || ':' || turn)")} % 4) + len "end", len, text from placed_turns)"""
