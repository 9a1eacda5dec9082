"""Structured Streaming jobs: watching folders, rounds, segmenting frames with state, regions by event time, votes, progress and error rates."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from voxloom.functions import align
from voxloom.operators.voting import vote_exact
from voxloom.sources.tail import tail_log as tail_log


def watch(spark: SparkSession, path: str, schema: str, fn: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None, max_files: int = 1000, kind: str = "json") -> StreamingQuery:
    """New files of a folder, at most `max_files` a round, to `fn`; all there is, then the end, if `interval` is None."""
    stream = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", max_files).load(path)
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


@dataclass(frozen=True)
class Round:
    """What a round did: rows that came, and rows that were processed."""

    number: int
    rows: int
    processed: int


class Stuck(Exception):
    """Raised inside a round that must not count as done."""


def rounds(stream: DataFrame, fn: Callable[[DataFrame, int], int], checkpoint: str, most: int = 1000, wait: float = 0.2) -> list[Round]:
    """Rounds of a stream, until there is nothing new, a round makes no progress, or `most` rounds are over; those that were done.

    The source bounds a round (`maxFilesPerTrigger` of files). `fn` processes its rows and returns how many it has processed. A round that had rows
    and processed none ends the query before Spark counts it as done, so that a later call begins with the same rows; so does a round after the last.
    """
    done: list[Round] = []

    def one(df: DataFrame, number: int) -> None:
        if len(done) == most:
            raise Stuck("enough rounds")
        rows = df.count()
        processed = fn(df, number) if rows else 0
        if rows and not processed:
            raise Stuck("a round made no progress")
        if rows:
            done.append(Round(number, rows, processed))

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    idle = 0
    try:
        while query.isActive:
            status = query.status
            idle = idle + 1 if not status["isDataAvailable"] and not status["isTriggerActive"] and query.lastProgress is not None else 0
            if idle >= 3:
                query.stop()
            else:
                query.awaitTermination(wait)
    except Exception as e:
        if Stuck.__name__ not in str(e):
            raise
    finally:
        query.stop()
    return done


def stream_vote(stream: DataFrame, key: str = "denoised_path", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Votes of rows as they come, each key once within the watermark."""
    return vote_exact(stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]))


def stream_regions(stream: DataFrame, gap: float, key: str = "src", ts: str = "ts", length: str = "duration_sec", late: str = "1 hour") -> DataFrame:
    """Regions joined over gaps up to `gap`: session windows as long as each region and the gap. Late rows are dropped."""
    window = F.session_window(F.col(ts), F.concat((F.col(length) + gap).cast("string"), F.lit(" seconds")))
    end = F.unix_micros(F.col(ts)) / 1e6 + F.col(length)
    found = stream.withWatermark(ts, late).groupBy(key, window).agg(F.min(F.unix_micros(F.col(ts)) / 1e6).alias("start_sec"), F.max(end).alias("end_sec"), F.count("*").alias("regions"))
    return found.select(key, "start_sec", "end_sec", "regions")


def stream_progress(stream: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows and hours by window and dataset."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, width), "dataset").agg(F.count("*").alias("rows"), F.round(F.sum("duration_sec") / 3600, 6).alias("hours"))
    return rows.select(F.col("window.start").alias("start"), "dataset", "rows", "hours")


class RegionProcessor(StatefulProcessor):
    """State of a key: its open regions, joined over gaps. A timer closes those that no row can reach any more."""

    def __init__(self, gap: float):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start double, stop double, regions long")

    def rows(self, key, found: list[tuple[float, float, int]], late: int) -> pd.DataFrame:
        rows = [(key[0], a, b, n, 0) for a, b, n in found] + [(key[0], None, None, 0, late)] * (late > 0)
        return pd.DataFrame(rows, columns=["key", "start_sec", "end_sec", "regions", "late_rows"]).astype({"start_sec": float, "end_sec": float, "regions": "int64", "late_rows": "int64"})

    def settle(self, open_: list[tuple[float, float, int]], now: float) -> list[tuple[float, float, int]]:
        """Keep what is still open at the time `now`, with a timer for the first to close; return the rest."""
        ends = lambda r: int((r[1] + self.gap) * 1000) + 1
        closed, left = [r for r in open_ if ends(r) <= now], [r for r in open_ if ends(r) > now]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.open.put(left)
            self.handle.registerTimer(min(map(ends, left)))
        else:
            self.open.clear()
        return closed

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        found, late = [tuple(r) for r in self.open.get()] if self.open.exists() else [], 0
        for part in rows:
            in_time = (part["at_ms"] >= now).to_numpy()
            late += int((~in_time).sum())
            part = part[in_time]
            found += zip(part["start"].tolist(), part["stop"].tolist(), [1] * len(part))
            found = self.joined(found)
        yield self.rows(key, self.settle(found, now), late)

    def joined(self, found: list[tuple[float, float, int]]) -> list[tuple[float, float, int]]:
        out: list[tuple[float, float, int]] = []
        for start, stop, n in sorted(found):
            if out and start - out[-1][1] <= self.gap:
                out[-1] = (out[-1][0], max(stop, out[-1][1]), out[-1][2] + n)
            else:
                out.append((start, stop, n))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        yield self.rows(key, self.settle(found, timerValues.getCurrentWatermarkInMs()), 0)

    def close(self) -> None:
        pass


def counted_regions(stream: DataFrame, gap: float, key: str = "src", ts: str = "ts", length: str = "duration_sec", late: str = "1 hour") -> DataFrame:
    """The regions of `stream_regions`, and rows of `late_rows`: how many came behind the watermark in a batch. Late rows belong to no region.

    The processor sees the time as a number, as Spark would drop late rows before it.
    """
    at = F.unix_micros(F.col(ts))
    rows = stream.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), F.floor(at / 1000).alias("at_ms"), (at / 1e6).alias("start"), (at / 1e6 + F.col(length)).alias("stop"))
    found = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=RegionProcessor(gap), outputStructType="key string, start_sec double, end_sec double, regions long, late_rows long", outputMode="Append", timeMode="EventTime"
    )
    return found.withColumnRenamed("key", key)


def stream_wer(stream: DataFrame, ref: str, hyp: str, by: tuple[str, ...] = (), ts: str | None = None, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Errors, reference words and error rate so far (of word lists `ref` and `hyp`), in all or `by` columns; with `ts`, in windows of `width` that begin each `slide`.

    State holds sums alone: errors are counted row by row as rows come. A row without reference words adds its errors, and no words.
    """
    words = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    rows = stream.select(*by, *([ts] if ts else []), align.edit_distance(words(ref), words(hyp)).alias("_errors"), F.size(words(ref)).alias("_words"))
    keys: list = list(by)
    if ts:
        rows = rows.withWatermark(ts, late)
        keys.insert(0, F.window(ts, width, slide or width))
    found = rows.groupBy(*keys).agg(F.count("*").alias("utterances"), F.sum("_errors").alias("errors"), F.sum("_words").alias("ref_words"))
    rate = F.round(100.0 * F.col("errors") / F.greatest(F.lit(1), "ref_words"), 6).alias("wer")
    time_of = [F.col("window.start").alias("start"), F.col("window.end").alias("end")] if ts else []
    return found.select(*time_of, *by, "utterances", "errors", "ref_words", rate)


@dataclass(frozen=True)
class SegmenterConfig:
    frame_sec: float = 0.016
    min_speech_sec: float = 0.25
    max_speech_sec: float = 20.0
    min_silence_sec: float = 0.3
    padding_sec: float = 0.1

    @property
    def frames(self) -> tuple[int, int, int]:
        """The least and the most of speech, and the least of silence, in frames."""
        return tuple(int(x / self.frame_sec + 1e-9) for x in (self.min_speech_sec, self.max_speech_sec, self.min_silence_sec))


class Segmenter:
    """Frames in, segments (first frame, frames) out; the state between frames is four whole numbers.

    `start` is -1 in silence; `held` frames belong to the open segment, the last `quiet` of them silent; `at` is the next frame.
    """

    def __init__(self, config: SegmenterConfig, state: tuple[int, int, int, int] = (-1, 0, 0, 0)):
        self.config = config
        self.start, self.held, self.quiet, self.at = state

    @property
    def state(self) -> tuple[int, int, int, int]:
        return self.start, self.held, self.quiet, self.at

    def close(self, frames: int) -> list[tuple[int, int]]:
        return [(self.start, frames)] if frames >= self.config.frames[0] and frames else []

    def feed(self, speech: bool) -> list[tuple[int, int]]:
        _, most, silence = self.config.frames
        out: list[tuple[int, int]] = []
        if self.start < 0:
            if speech:
                self.start, self.held, self.quiet = self.at, 1, 0
        else:
            self.held += 1
            self.quiet = 0 if speech else self.quiet + 1
            if speech and most and self.held >= most:
                out = self.close(self.held)
                self.start, self.held = self.at, 0
            elif not speech and self.quiet >= silence and self.quiet > 1:
                out = self.close(self.held - self.quiet)
                self.start, self.held, self.quiet = -1, 0, 0
        self.at += 1
        return out

    def flush(self) -> list[tuple[int, int]]:
        out = self.close(self.held - self.quiet) if self.start >= 0 else []
        self.start, self.held, self.quiet = -1, 0, 0
        return out


SEGMENTS = "src string, start_frame long, frames long, start_sec double, end_sec double"


def segment_rows(src: str, found: list[tuple[int, int]], config: SegmenterConfig) -> list[tuple]:
    return [(src, a, n, max(0.0, a * config.frame_sec - config.padding_sec), (a + n) * config.frame_sec + config.padding_sec) for a, n in found]


class SegmentProcessor(StatefulProcessor):
    """State of a source: the segmenter's numbers. A row whose `is_last` is true ends the source; so does silence of `idle_ms` of event time, if that is set.

    A source that goes on after its end starts anew at the frame that comes then.
    """

    def __init__(self, config: SegmenterConfig, idle_ms: int | None = None):
        self.config, self.idle_ms = config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("segmenter", "start long, held long, quiet long, at long")

    def rows(self, key, found: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame(segment_rows(key[0], found, self.config), columns=["src", "start_frame", "frames", "start_sec", "end_sec"])

    def wait_until(self, at: int | None) -> None:
        """One timer at `at`, or none."""
        timers = list(self.handle.listTimers())
        if at is not None and timers and max(timers) >= at:
            return
        for timer in timers:
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(p["frame_idx"].to_numpy(np.int64), p["is_speech"].to_numpy(bool), p["is_last"].to_numpy(bool), p["at_ms"].max()) for p in rows]
        places, speech, last = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.argsort(places, kind="stable")
        segmenter = Segmenter(self.config, tuple(self.state.get()) if self.state.exists() else (-1, 0, 0, int(places[order[0]])))
        found = []
        for flag in speech[order].tolist():
            found += segmenter.feed(flag)
        if last.any():
            found += segmenter.flush()
            self.state.clear()
        else:
            self.state.update(segmenter.state)
        if self.idle_ms is not None:
            self.wait_until(None if last.any() else int(max(p[3] for p in parts)) + self.idle_ms)
        yield self.rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = []
        if self.state.exists():
            found = Segmenter(self.config, tuple(self.state.get())).flush()
            self.state.clear()
        yield self.rows(key, found)

    def close(self) -> None:
        pass


def stream_segments(frames: DataFrame, config: SegmenterConfig = SegmenterConfig(), ts: str | None = None, late: str = "1 minute", idle_sec: float = 60.0) -> DataFrame:
    """Segments of `src`, `frame_idx`, `is_speech`, `is_last` rows; frames of a source must come in order from batch to batch.

    With the time `ts` of frames, a source that the watermark has left `idle_sec` behind is flushed and forgotten, so that state does not
    grow with sources that never say that they end.
    """
    rows = frames if ts is None else frames.withWatermark(ts, late)
    at = F.lit(0).cast("long") if ts is None else F.floor(F.unix_micros(F.col(ts)) / 1000)
    rows = rows.select("src", "frame_idx", F.coalesce("is_speech", F.lit(False)).alias("is_speech"), F.coalesce("is_last", F.lit(False)).alias("is_last"), at.alias("at_ms"))
    processor = SegmentProcessor(config, None if ts is None else int(idle_sec * 1000))
    return rows.groupBy("src").transformWithStateInPandas(statefulProcessor=processor, outputStructType=SEGMENTS, outputMode="Append", timeMode="None" if ts is None else "EventTime")


def batch_segments(frames: DataFrame, config: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """The same segments from a table: Spark sorts the frames, and a task holds a source's four numbers between batches."""
    columns = ["src", "start_frame", "frames", "start_sec", "end_sec"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, segmenter = None, None
        for batch in batches:
            found: list[tuple] = []
            for src, place, speech in zip(batch["src"], batch["frame_idx"], batch["is_speech"]):
                if segmenter is None or src != source:
                    found += segment_rows(source, segmenter.flush(), config) if segmenter else []
                    source, segmenter = src, Segmenter(config, (-1, 0, 0, int(place)))
                found += segment_rows(src, segmenter.feed(bool(speech)), config)
            yield pd.DataFrame(found, columns=columns)
        if segmenter:
            yield pd.DataFrame(segment_rows(source, segmenter.flush(), config), columns=columns)

    return frames.select("src", "frame_idx", "is_speech").repartition("src").sortWithinPartitions("src", "frame_idx").mapInPandas(run, SEGMENTS)
