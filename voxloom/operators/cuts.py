"""Cuts, supervisions, slots of speakers, and examples of parallel arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.text import upper_text

FRAMES_PER_SEC = 100


def build_cuts(manifest: DataFrame, kind: str = "single") -> DataFrame:
    """Recordings with one supervision over their whole length, from a wide manifest; rows without samples go."""
    rate = F.coalesce("sample_rate", F.lit(16000))
    good = manifest.filter(F.coalesce("num_samples", F.lit(0)) > 0)
    seconds = F.round(F.col("num_samples") / rate, 6)
    source = F.array(F.struct(F.lit("file").alias("type"), F.array(F.lit(0)).alias("channels"), F.col("audio_path").alias("source")))
    recording = F.struct(F.col("utt_id").alias("id"), source.alias("sources"), rate.alias("sampling_rate"), F.col("num_samples").cast("bigint").alias("num_samples"), seconds.alias("duration"))
    sup = F.struct(
        F.concat("utt_id", F.lit("_sup0")).alias("id"), F.col("utt_id").alias("recording_id"), F.lit(0.0).alias("start"), seconds.alias("duration"), F.lit(0).alias("channel"), F.col("text"), F.col("speaker_id").alias("speaker")
    )
    return good.select(F.col("utt_id").alias("id"), F.lit(0.0).alias("start"), seconds.alias("duration"), F.lit(0).alias("channel"), recording.alias("recording"), F.array(sup).alias("supervisions"), F.lit(kind).alias("mix_type"))


def attach_supervisions(mixes: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each source of a mixture; a mixture without sources has one over its whole length."""
    found = mixes.select("mix_id", "duration_sec", F.col("text").alias("_text")).join(sources.select("mix_id", "seg_id", "speaker_id", "start_sec", F.col("duration_sec").alias("_sec"), "text"), "mix_id", "left")
    return found.select(
        F.coalesce("seg_id", F.concat("mix_id", F.lit("_sup0"))).alias("id"),
        F.col("mix_id").alias("recording_id"),
        F.coalesce("start_sec", F.lit(0.0)).alias("start"),
        F.coalesce("_sec", "duration_sec").alias("duration"),
        F.lit(0).alias("channel"),
        F.coalesce("text", "_text").alias("text"),
        F.coalesce("speaker_id", F.lit("unknown")).alias("speaker"),
    )


def upper_supervisions(cuts: DataFrame) -> DataFrame:
    """Cuts with all texts in upper case, those in tracks too, and whether a cut changed."""
    up = lambda sups: F.transform(sups, lambda s: s.withField("text", F.upper(s["text"])))
    out = cuts.withColumn("_before", F.struct(F.transform("supervisions", lambda s: s["text"]), F.transform("tracks", lambda t: F.transform(t["cut"]["supervisions"], lambda s: s["text"]))))
    out = out.withColumns({"supervisions": up(F.col("supervisions")), "tracks": F.transform("tracks", lambda t: t.withField("cut.supervisions", up(t["cut"]["supervisions"])))})
    after = F.struct(F.transform("supervisions", lambda s: s["text"]), F.transform("tracks", lambda t: F.transform(t["cut"]["supervisions"], lambda s: s["text"])))
    return out.withColumn("changed", ~F.col("_before").eqNullSafe(after)).drop("_before")


def prefix_ids(cuts: DataFrame, prefix: str, upper: bool = True) -> DataFrame:
    """Ids of cuts, recordings and supervisions with a prefix, all alike, and texts in upper case."""
    p = lambda c: F.concat(F.lit(prefix), c)
    sup = lambda s: s.withField("id", p(s["id"])).withField("recording_id", p(s["recording_id"])).withField("text", upper_text(s["text"], upper))
    return cuts.withColumns({"id": p(F.col("id")), "recording": F.col("recording").withField("id", p(F.col("recording.id"))), "supervisions": F.transform("supervisions", sup)})


def merge_prefixed(old: DataFrame, new: DataFrame, prefix: str) -> DataFrame:
    """Both tables together after prefixing the new ids; ids in both raise an error when read."""
    both = old.unionByName(prefix_ids(new, prefix), allowMissingColumns=True)
    twice = both.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    checked = twice.filter(F.assert_true(F.col("n") <= 1, F.lit("an id is in both tables")).isNull())
    return both.join(F.broadcast(checked)).drop("n")


def arrival_slots(sups: DataFrame, slots: int, key: str = "cut") -> DataFrame:
    """The slot of each speaker of a cut, by first start; speakers beyond `slots` go. The key holds a cut's speakers alone."""
    first = sups.groupBy(key, "speaker").agg(F.min("start").alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first", "speaker")) - 1
    return first.withColumn("slot", place).filter(F.col("slot") < slots)


def target_slot(slots: DataFrame, epoch: int, policy: str = "round_robin", key: str = "cut") -> DataFrame:
    """The slot to train on: crc32 of the cut's id plus the epoch, or a hash of both, modulo the active slots."""
    base = F.crc32(F.col(key).cast("string").cast("binary")) + epoch if policy == "round_robin" else F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(epoch)), F.lit(2**31))
    active = F.array_sort(F.collect_set("slot"))
    return slots.groupBy(key).agg(active.alias("active")).select(key, F.element_at("active", (base % F.size("active") + 1).cast("int")).alias("target_slot"))


def slot_texts(sups: DataFrame, slots: DataFrame, key: str = "cut") -> DataFrame:
    """The text of each slot, in the order of starts."""
    both = sups.join(slots.select(key, "speaker", "slot"), [key, "speaker"]).filter(F.coalesce("text", F.lit("")) != "")
    ordered = F.sort_array(F.collect_list(F.struct("start", "place", "text")))
    return both.groupBy(key, "slot").agg(F.trim(F.array_join(F.transform(ordered, lambda s: s["text"]), " ")).alias("text"))


def slot_frames(sups: DataFrame, slots: DataFrame, frames: int, key: str = "cut") -> DataFrame:
    """Frames of each supervision: from the one it starts in to the one it ends in, inside 0 and `frames`."""
    both = sups.join(slots.select(key, "speaker", "slot"), [key, "speaker"])
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(frames), c)).cast("int")
    return both.select(key, "slot", clamp(F.floor(F.col("start") * FRAMES_PER_SEC)).alias("start_frame"), clamp(F.ceil(F.col("end") * FRAMES_PER_SEC)).alias("end_frame")).filter("end_frame > start_frame")


def reference_per_speaker(sups: DataFrame, slots: int, key: str = "cut") -> DataFrame:
    """Words of each speaker of a cut, speakers by first appearance; those beyond `slots` go."""
    texts = slot_texts(sups, arrival_slots(sups, slots, key), key)
    ordered = F.sort_array(F.collect_list(F.struct("slot", F.split("text", " ").alias("words"))))
    return texts.groupBy(key).agg(F.transform(ordered, lambda s: s["words"]).alias("ref_per_speaker"))


def normalize_example(df: DataFrame, required: Sequence[str], wrapped: Sequence[str] = ("audio_path", "num_samples")) -> DataFrame:
    """Examples with the required values (others raise an error), scalars under `observation`, and a scenario: the id by default."""
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    out = df.filter(F.assert_true(missing == "", F.concat(F.lit("missing: "), missing)).isNull())
    out = out.withColumns({c: F.struct(F.col(c).alias("observation")) for c in wrapped if c in df.columns})
    scenario = F.coalesce("scenario", "example_id") if "scenario" in df.columns else F.col("example_id")
    return out.withColumn("scenario", scenario)


def collate(df: DataFrame, key: str, order: str, columns: Sequence[str], one_dataset: bool = True) -> DataFrame:
    """Rows as parallel arrays in the order of `order`, an id joined from theirs; repeated speakers and mixed datasets raise an error."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    found = df.groupBy(key).agg(rows.alias("_r"), F.countDistinct("speaker_id").alias("_s"), F.countDistinct("dataset").alias("_d"), F.first("dataset").alias("dataset"))
    fine = (F.col("_s") == F.size("_r")) & ((F.col("_d") == 1) | (not one_dataset))
    found = found.filter(F.assert_true(fine, F.lit("a group repeats a speaker or mixes datasets")).isNull())
    arrays = [F.col(f"_r.{c}").alias(c) for c in columns]
    return found.select(key, "dataset", F.array_join(F.transform("_r", lambda r: r["example_id"].cast("string")), "_").alias("example_id"), *[a for c, a in zip(columns, arrays) if c != "example_id"])


def by_speaker(df: DataFrame, key: str, equal: Sequence[str], listed: Sequence[str]) -> DataFrame:
    """Arrays of sources regrouped by speaker: `equal` values must agree, `listed` ones become lists."""
    rows = df.select(key, F.posexplode(F.arrays_zip("speaker_id", *equal, *listed)).alias("place", "r")).select(key, "place", "r.*")
    ordered = F.sort_array(F.collect_list(F.struct("place", *listed)))
    found = rows.groupBy(key, "speaker_id").agg(ordered.alias("_l"), *[F.min(c).alias(c) for c in equal], *[F.max(c).alias(f"_max_{c}") for c in equal])
    fine = F.lit(True)
    for c in equal:
        fine = fine & F.col(c).eqNullSafe(F.col(f"_max_{c}"))
    found = found.filter(F.assert_true(fine, F.lit("a speaker's values differ")).isNull())
    return found.select(key, "speaker_id", *equal, *[F.col(f"_l.{c}").alias(c) for c in listed])


def speaker_map(speakers: Column, values: Column, sequence: Column) -> Column:
    """The value of each speaker in a sequence of speakers."""
    table = F.map_from_arrays(speakers, values)
    return F.transform(sequence, lambda s: F.try_element_at(table, s))
