"""Time intervals: frames to regions, merging, padding, packing, splitting, overlap and activity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.plans.cluster import checkpoint

#: Seconds of a key's time line that are merged before the key's own rows meet: this keeps keys with very many rows out of one task.
SPAN = 3600.0
#: The same in frames.
FRAME_SPAN = 200_000
# Hop and rate of the frames, and lengths in seconds.
HOP, RATE = 256, 16000
MERGE_GAP, PAD, JOIN_GAP, RESCUE_GAP, MIN_SEG, MAX_SEG, AROUND_CUT = 0.3, 0.1, 1.2, 3.0, 1.0, 20.0, 2.0


def _merge(df: DataFrame, keys: list[Column | str], gap: float) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start_sec", "end_sec")
    reach = F.max("end_sec").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col("start_sec") - reach > gap), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec")).drop("_island")


def merge_nearby(df: DataFrame, gap: float = MERGE_GAP, key: str = "src") -> DataFrame:
    """Regions joined where the gap between them is at most `gap`: first inside spans of time, then across them."""
    inside = _merge(df.select(key, "start_sec", "end_sec").withColumn("_span", F.floor(F.col("start_sec") / SPAN)), [key, "_span"], gap)
    return _merge(inside.drop("_span"), [key], gap)


def frames_to_regions(frames: DataFrame, silence_ms: float, hop: int = HOP, rate: int = RATE, key: str = "src", samples: str | None = None) -> DataFrame:
    """Speech frames joined over up to `silence_ms` of silence; ends are cut at the source's samples.

    Frames are merged inside spans of FRAME_SPAN frames first, then what is left of them across spans.
    """
    most = max(1, round(silence_ms / 1000 / (hop / rate)))
    speech = frames.filter("is_speech").select(key, F.col("frame_idx").alias("start_sec"), F.col("frame_idx").alias("end_sec"), F.floor(F.col("frame_idx") / FRAME_SPAN).alias("_span"))
    inside = _merge(speech, [key, "_span"], most).drop("_span")
    found = _merge(inside, [key], most)
    end = (F.col("end_sec") + 1) * hop
    if samples:
        found = found.join(frames.groupBy(key).agg(F.max(samples).alias("_samples")), key)
        end = F.least(F.col("_samples"), end)
    return found.select(key, (F.col("start_sec") * (hop / rate)).alias("start_sec"), (end / rate).alias("end_sec"))


def pad_clamp(df: DataFrame, pad: float = PAD, duration: str | None = None) -> DataFrame:
    """Regions longer by `pad` at both ends, inside 0 and the source's duration; empty ones go."""
    end = F.col("end_sec") + pad
    end = F.least(F.col(duration), end) if duration else end
    return df.withColumns({"start_sec": F.greatest(F.lit(0.0), F.col("start_sec") - pad), "end_sec": end}).filter("end_sec > start_sec")


def pack_short(df: DataFrame, min_seg: float = MIN_SEG, join_gap: float = JOIN_GAP, rescue_gap: float = RESCUE_GAP, key: str = "src", span: float = SPAN) -> DataFrame:
    """Short regions joined to the next ones until they last `min_seg`, over gaps up to the larger of both.

    The fold runs over chains: regions whose gaps are all joinable. A chain starts where a gap is larger, so chains are
    independent, and no fold holds a whole source unless it has no pause.
    """
    gap = max(join_gap, rescue_gap)
    order = Window.partitionBy(key).orderBy("start_sec", "end_sec")
    new = F.when(F.coalesce(F.col("start_sec") - F.lag("end_sec").over(order) <= gap, F.lit(False)), 0).otherwise(1)
    chains = df.select(key, "start_sec", "end_sec").withColumn("_new", new).withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    regions = F.array_sort(F.collect_list(F.struct("start_sec", "end_sec")))

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (last["end_sec"] - last["start_sec"] < min_seg) & (r["start_sec"] - last["end_sec"] <= gap)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start_sec"].alias("start_sec"), r["end_sec"].alias("end_sec"))))
        return F.when(joins, joined).otherwise(F.concat(done, F.array(r)))

    empty = F.array().cast("array<struct<start_sec:double,end_sec:double>>")
    found = chains.groupBy(key, "_chain").agg(regions.alias("r")).select(key, F.explode(F.aggregate("r", empty, step)).alias("r"))
    return found.select(key, "r.*")


def split_long(df: DataFrame, energy: DataFrame | None = None, min_seg: float = MIN_SEG, max_seg: float = MAX_SEG, key: str = "src") -> DataFrame:
    """Regions over `max_seg` cut at the least energy within two seconds of the limit; without energies at the limit. Tails under `min_seg` go.

    `energy` has the key, `at_sec` (the middle of a frame) and `energy`. Only frames inside long regions meet them.
    """
    long = (F.col("end_sec") - F.col("start_sec")) > max_seg
    if energy is None:
        n = F.ceil((F.col("end_sec") - F.col("start_sec")) / max_seg) - 1
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0)).cast("int")), lambda i: F.struct((F.col("start_sec") + i * max_seg).alias("start_sec"), F.least(F.col("end_sec"), F.col("start_sec") + (i + 1) * max_seg).alias("end_sec")))
        parts = df.select(key, long.alias("_long"), F.explode(cuts).alias("r"))
        return parts.select(key, "_long", "r.*").filter(~F.col("_long") | (F.col("end_sec") - F.col("start_sec") >= min_seg)).drop("_long")
    marked = df.withColumn("_region", F.xxhash64(key, "start_sec", "end_sec"))
    spans = F.sequence(F.floor(F.col("start_sec") / SPAN), F.floor(F.col("end_sec") / SPAN))
    frames = energy.select(F.col(key).alias("_k"), "at_sec", "energy", F.floor(F.col("at_sec") / SPAN).alias("_span"))
    met = marked.filter(long).withColumn("_span", F.explode(spans)).join(frames.withColumnRenamed("_k", key), [key, "_span"])
    wanted = met.filter(F.col("at_sec").between(F.col("start_sec"), F.col("end_sec")))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at_sec", kind="stable")
        name, start, end = pdf[[key, "start_sec", "end_sec"]].iloc[0]
        edges = cut_points(pdf["at_sec"].to_numpy(), pdf["energy"].to_numpy(), start, end, min_seg, max_seg)
        return pd.DataFrame({key: name, "start_sec": edges[:-1], "end_sec": edges[1:]}).query("end_sec < @end or end_sec - start_sec >= @min_seg")

    kind = dict(df.dtypes)[key]
    cut_rows = wanted.groupBy("_region").applyInPandas(cut, f"`{key}` {kind}, start_sec double, end_sec double")
    without = marked.filter(long).join(wanted.select("_region").distinct(), "_region", "left_anti")
    return marked.filter(~long).select(key, "start_sec", "end_sec").union(cut_rows).union(split_long(without, None, min_seg, max_seg, key))


def cut_points(at: np.ndarray, power: np.ndarray, start: float, end: float, min_seg: float, max_seg: float) -> list[float]:
    """Start, cuts and end of a region: each cut at the quietest of the frames (sorted by `at`) around `max_seg` after the one before."""
    edges = [start]
    while end - edges[-1] > max_seg:
        earliest, limit = edges[-1] + min_seg, edges[-1] + max_seg
        first, last = np.searchsorted(at, max(earliest, limit - AROUND_CUT), "left"), np.searchsorted(at, min(end, limit + AROUND_CUT), "right")
        quiet = at[first + power[first:last].argmin()] if last > first else limit
        edges.append(float(np.clip(quiet, earliest, limit)))
    return [*edges, end]


def segment_source(frames: DataFrame, silence_ms: float, energy: DataFrame | None = None, duration: str | None = None, hop: int = HOP, rate: int = RATE, key: str = "src") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Segments of sources from their speech frames, and the regions at each stage on the way.

    Stages are written, so that no task holds the sorted rows of several at a time and none is found twice.
    """
    raw = checkpoint(frames_to_regions(frames, silence_ms, hop, rate, key))
    merged = checkpoint(merge_nearby(raw, MERGE_GAP, key))
    padded = merged
    if duration:
        padded = merged.join(frames.groupBy(key).agg(F.max(duration).alias(duration)), key)
    padded = pad_clamp(padded, PAD, duration).select(key, "start_sec", "end_sec")
    packed = checkpoint(pack_short(padded, key=key))
    kept = packed.filter(F.col("end_sec") - F.col("start_sec") >= MIN_SEG)
    final = split_long(kept, energy, key=key)
    return final, {"raw": raw, "merged": merged, "padded": padded, "packed": packed, "kept": kept, "final": final}


def sweep(df: DataFrame, key: str, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """Stretches of time between events, with how many intervals are active in each.

    Events are added up by spans of time first; inside a span they start from the sum of all spans before.
    """
    events = df.filter(F.col(end) > F.col(start)).select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    events = events.groupBy(key, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).withColumn("_span", F.floor(F.col("at") / SPAN))
    spans = events.groupBy(key, "_span").agg(F.sum("d").alias("_d"), F.min("at").alias("_first"))
    across = Window.partitionBy(key).orderBy("_span")
    spans = spans.select(key, "_span", F.coalesce(F.sum("_d").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(across).alias("_next"))
    order = Window.partitionBy(key, "_span").orderBy("at")
    found = events.join(spans, [key, "_span"])
    found = found.withColumns({"active": F.col("_before") + F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)), "until": F.coalesce(F.lead("at").over(order), "_next")})
    return found.filter("until is not null").select(key, "at", "until", "active")


def overlap_ratios(df: DataFrame, key: str) -> DataFrame:
    """Shares of the active time with two and three or more at once, and the most at once."""
    wide = sweep(df, key).withColumn("len", F.col("until") - F.col("at"))
    total = F.greatest(F.sum(F.when(F.col("active") >= 1, F.col("len")).otherwise(0.0)), F.lit(1e-9))
    part = lambda n: F.round(F.sum(F.when(F.col("active") >= n, F.col("len")).otherwise(0.0)) / total, 6)
    return wide.groupBy(key).agg(part(2).alias("ov2"), part(3).alias("ov3"), F.max("active").cast("int").alias("max_active"))


def activity(df: DataFrame, key: str, speaker: str = "speaker") -> DataFrame:
    """When each speaker is active: their intervals, united."""
    one = df.withColumn("_both", F.struct(key, speaker)).select("_both", "start_sec", "end_sec")
    return merge_nearby(one, 0.0, "_both").select("_both.*", "start_sec", "end_sec")


def silence(df: DataFrame, key: str, duration: str) -> DataFrame:
    """When nobody is active, from 0 to the end of the recording."""
    ends = df.groupBy(key).agg(F.max(duration).alias("_total"))
    united = merge_nearby(df, 0.0, key)
    order = Window.partitionBy(key).orderBy("start_sec")
    gaps = united.select(key, F.coalesce(F.lag("end_sec").over(order), F.lit(0.0)).alias("a"), F.col("start_sec").alias("b"))
    tail = united.groupBy(key).agg(F.max("end_sec").alias("a")).join(ends, key).select(key, "a", F.col("_total").alias("b"))
    return gaps.union(tail).filter("b > a").select(key, F.col("a").alias("start_sec"), F.col("b").alias("end_sec"), (F.col("b") - F.col("a")).alias("length"))


def segment_lengths(df: DataFrame, key: str, level: int) -> DataFrame:
    """Lengths of the stretches, as long as they go, with exactly `level` active."""
    wide = sweep(df, key).filter(F.col("active") == level)
    return merge_nearby(wide.select(key, F.col("at").alias("start_sec"), F.col("until").alias("end_sec")), 0.0, key).withColumn("length", F.col("end_sec") - F.col("start_sec"))


def crop_supervisions(cuts: DataFrame, windows: DataFrame, key: str = "cut") -> DataFrame:
    """Supervisions that meet their cut's window (`w_start`, `w_end`), clipped to it and counted from its start."""
    both = cuts.join(windows, key)
    start, end = F.greatest("start", "w_start"), F.least(F.col("start") + F.col("duration"), F.col("w_end"))
    return both.filter(end > start).withColumns({"start": start - F.col("w_start"), "end": end - F.col("w_start")}).drop("w_start", "w_end", "duration")


def segment_filter(df: DataFrame, start: int, stop: int, key: str) -> DataFrame:
    """Sources active in a window of samples, clipped to it and counted from its start, with the speakers that stay."""
    a, b = F.greatest(F.col("offset"), F.lit(start)), F.least(F.col("offset") + F.col("num_samples"), F.lit(stop))
    cut = df.filter(b > a).withColumns({"clipped": a - F.col("offset"), "num_samples": b - a, "offset": a - start})
    return cut.join(cut.groupBy(key).agg(F.countDistinct("speaker").alias("num_speakers")), key)


def truncate_min(df: DataFrame, key: str) -> DataFrame:
    """Examples cut to the end of the source that ends first."""
    shortest = df.groupBy(key).agg(F.min(F.col("offset") + F.col("num_samples")).alias("_stop"))
    cut = df.join(shortest, key).withColumn("num_samples", F.least(F.col("num_samples"), F.col("_stop") - F.col("offset")))
    return cut.filter("num_samples > 0").drop("_stop")


def align_to_vad(df: DataFrame, vad: DataFrame, source: str = "source_id") -> DataFrame:
    """Sources cut to their first and last activity; those without any stay whole."""
    bounds = vad.groupBy(source).agg(F.min("start").alias("_a"), F.max("stop").alias("_b"))
    found = df.join(bounds, source, "left")
    return found.withColumns({"offset": F.col("offset") + F.coalesce("_a", F.lit(0)), "num_samples": F.coalesce(F.col("_b") - F.col("_a"), F.col("num_samples"))}).drop("_a", "_b")


def activity_from_vad(df: DataFrame, vad: DataFrame, source: str = "source_id") -> DataFrame:
    """Activity of each source, counted from the start of its example."""
    return df.join(vad, source).withColumns({"start": F.col("start") + F.col("offset"), "stop": F.col("stop") + F.col("offset")})


STATES = ("TH", "TS", "OV", "BC")


def turn_states(df: DataFrame, key: str) -> DataFrame:
    """Each turn but the first with its state and the silence or overlap before it.

    A backchannel leaves the speaker in the foreground, so that states follow one from another: turn-hold, turn-switch,
    overlap, backchannel. A turn-hold before the foreground's end has a negative silence and is flagged. Rows of a key are
    sorted by Spark and pass in batches; of a key only the foreground and the last state are held between them.
    """

    def pass_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meeting = speaker = end = before = None
        for batch in batches:
            rows = []
            for name, place, own, start, stop in batch.itertuples(index=False):
                if meeting is None or name != meeting:
                    meeting, speaker, end, before = name, own, stop, STATES[0]
                    continue
                gap, same = start - end, own == speaker
                state = STATES[0 if same else 1 if gap > 0 else 2 if stop > end else 3]
                rows.append((name, place, before, state, gap if same or gap > 0 else None, -gap if state == "OV" else None))
                before = state
                if state != "BC":
                    speaker, end = own, stop
            yield pd.DataFrame(rows, columns=[key, "place", "from_state", "to_state", "silence", "overlap"])

    kind = dict(df.dtypes)[key]
    turns = df.select(key, F.col("place").cast("long").alias("place"), "speaker", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return turns.repartition(key).sortWithinPartitions(key, "place").mapInPandas(pass_by, f"`{key}` {kind}, place long, from_state string, to_state string, silence double, overlap double")


def turn_transitions(states: DataFrame) -> DataFrame:
    """The probabilities of going from a state to the next; a state that never came stays where it is."""
    spark = states.sparkSession
    grid = spark.createDataFrame([(a, b) for a in STATES for b in STATES], "from_state string, to_state string")
    counts = states.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    totals = states.groupBy("from_state").agg(F.count("*").alias("total"))
    found = grid.join(F.broadcast(counts), ["from_state", "to_state"], "left").join(F.broadcast(totals), "from_state", "left")
    stays = F.when(F.col("from_state") == F.col("to_state"), 1.0).otherwise(0.0)
    return found.select("from_state", "to_state", F.when(F.col("total").isNull(), stays).otherwise(F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 9)).alias("p"))


def max_allowed_overlap(df: DataFrame, key: str, speaker: Column, at_once: int) -> DataFrame:
    """How far a new turn of `speaker` may reach back so that at most `at_once` speak at once and nobody over themselves."""
    ends = F.reverse(F.array_sort(F.collect_list(F.struct("end", "speaker"))))
    found = df.groupBy(key).agg(F.slice(ends, 1, at_once).alias("last"), F.first(speaker).alias("_me"))
    last = F.concat("last", F.array_repeat(F.struct(F.lit(0).cast("double").alias("end"), F.lit(None).cast("string").alias("speaker")), F.greatest(F.lit(0), at_once - F.size("last"))))
    mine = F.array_position(F.transform(last, lambda s: F.coalesce(s["speaker"], F.lit(""))), F.col("_me"))
    place = F.when(mine > 0, mine).otherwise(at_once).cast("int")
    return found.select(key, (F.get(last, 0)["end"] - F.get(last, place - 1)["end"]).alias("max_overlap"))
