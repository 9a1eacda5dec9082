"""Streams whose state ends, counts or sums: timers, late rows, error rates and rounds."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from voxloom.operators import scoring
from voxloom.operators.intervals import merge_nearby
from voxloom.streaming import jobs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(sec):
    return T0 + timedelta(seconds=sec)


class Feed:
    """A folder of Parquet files, one a batch, and a query that reads it to its end each time."""

    def __init__(self, spark, tmp_path, schema, build, mode="append"):
        self.spark, self.path, self.schema, self.build, self.mode = spark, tmp_path, schema, build, mode
        (tmp_path / "feed").mkdir()
        self.n = 0

    def __call__(self, rows):
        import shutil

        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(self.path / f"made{self.n}"))
        shutil.copy(next((self.path / f"made{self.n}").glob("part-*")), self.path / "feed" / f"{self.n}.parquet")
        self.n += 1
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / "feed"))
        seen = []
        query = self.build(stream).writeStream.foreachBatch(lambda df, _: seen.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(self.path / "cp")).outputMode(self.mode).trigger(availableNow=True).start()
        query.awaitTermination(180)
        state = [op for p in query.recentProgress for op in p["stateOperators"]]
        return [r for part in seen for r in part], state[-1]["numRowsTotal"] if state else None


def test_silent_source_is_flushed_and_forgotten(spark, tmp_path):
    config = jobs.SegmenterConfig(1.0, 2.0, 100.0, 3.0, 0.0)
    feed = Feed(spark, tmp_path, "src string, frame_idx long, is_speech boolean, is_last boolean, ts timestamp", lambda s: jobs.stream_segments(s, config, "ts", "5 seconds", 20.0))
    frames = lambda src, flags, start=0: [(src, start + i, bool(f), False, at(start + i)) for i, f in enumerate(flags)]
    out, held = feed(frames("quiet", [0, 1, 1, 1, 0]) + frames("busy", [1] * 8))
    assert out == [] and held > 0
    out, more = feed(frames("busy", [1] * 40, 8))
    assert out == [("quiet", 1, 3, 1.0, 4.0)]
    out, less = feed(frames("busy", [0] * 5, 48))
    assert out == [("busy", 0, 48, 0.0, 48.0)] and less < held
    out, _ = feed(frames("quiet", [1, 1, 1], 60) + frames("busy", [1, 1], 53))
    assert out == []
    out, last = feed(frames("other", [0], 200))
    assert sorted(out) == [("busy", 53, 2, 53.0, 55.0), ("quiet", 60, 3, 60.0, 63.0)]


def test_last_row_ends_a_source_at_once(spark, tmp_path):
    config = jobs.SegmenterConfig(1.0, 2.0, 100.0, 3.0, 0.0)
    feed = Feed(spark, tmp_path, "src string, frame_idx long, is_speech boolean, is_last boolean, ts timestamp", lambda s: jobs.stream_segments(s, config, "ts", "5 seconds", 20.0))
    out, _ = feed([("a", i, True, i == 4, at(i)) for i in range(5)])
    assert out == [("a", 0, 5, 0.0, 5.0)]
    assert feed([("b", 0, True, False, at(500))])[0] == []


def test_late_rows_are_counted(spark, tmp_path):
    feed = Feed(spark, tmp_path, "src string, ts timestamp, duration_sec double", lambda s: jobs.counted_regions(s, 10.0, late="30 seconds"))
    rng, taken, late, got = random.Random(5), [], Counter(), []
    newest, mark = 0, float("-inf")
    for k in range(6):
        rows = [(rng.choice("ab"), rng.randrange(max(0, k * 100 - 150), k * 100 + 100), float(rng.randint(1, 20))) for _ in range(40)]
        for src, t, n in rows:
            if t < mark:
                late[src] += 1
            else:
                taken.append((src, t, n))
        newest = max([newest, *(t for _, t, _ in rows)])
        out, _ = feed([(src, at(t), n) for src, t, n in rows])
        got += out
        mark = newest - 30
    got += feed([("z", at(9000), 1.0)])[0]
    assert late and {r[0]: n for r in got if (n := sum(x[4] for x in got if x[0] == r[0]))} == dict(late)
    table = spark.createDataFrame(taken, "src string, start_sec long, d double").selectExpr("src", "cast(start_sec as double) as start_sec", "start_sec + d as end_sec")
    base = T0.timestamp()
    assert sorted((r[0], r[1] - base, r[2] - base) for r in got if r[3] and r[0] != "z") == sorted(tuple(r) for r in merge_nearby(table, 10.0).collect())
    assert sum(r[3] for r in got if r[0] != "z") == len(taken)


def test_running_error_rate_equals_the_batch(spark, tmp_path):
    schema = "dataset string, ts timestamp, ref array<string>, hyp array<string>"
    feed = Feed(spark, tmp_path, schema, lambda s: jobs.stream_wer(s, "ref", "hyp", ("dataset",)), "complete")
    rng, every = random.Random(2), []
    for _ in range(3):
        rows = [(rng.choice("xy"), at(rng.randrange(7200)), rng.choices("abc", k=rng.randrange(0, 9)), rng.choices("abc", k=rng.randrange(0, 9))) for _ in range(25)] + [("x", at(1), None, ["a"])]
        every += rows
        out, _ = feed(rows)
        table = spark.createDataFrame(every, schema).withColumn("ref", F.coalesce("ref", F.array().cast("array<string>")))
        want = scoring.wer(table, "ref", "hyp", ("dataset",)).select("dataset", "utterances", "errors", "ref_words", "wer")
        assert sorted(out) == sorted(tuple(r) for r in want.collect())


def test_error_rate_in_sliding_windows(spark, tmp_path):
    schema = "ts timestamp, ref array<string>, hyp array<string>"
    feed = Feed(spark, tmp_path, schema, lambda s: jobs.stream_wer(s, "ref", "hyp", (), "ts", "20 minutes", "10 minutes"), "complete")
    out, _ = feed([(at(60), ["a", "b"], ["a", "c"]), (at(11 * 60), ["a"], ["a"])])
    found = {(r[0].minute, r[2], r[3], r[4]) for r in out}
    assert found == {(50, 1, 1, 2), (0, 2, 1, 3), (10, 1, 0, 1)}


def source_of(spark, tmp_path, files):
    (tmp_path / "in").mkdir()
    for k in range(files):
        (tmp_path / "in" / f"{k}.json").write_text('{"id": %d}\n' % k)
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_rounds_end_when_all_is_done(spark, tmp_path):
    stream = source_of(spark, tmp_path, 4)
    done = jobs.rounds(stream, lambda df, i: df.count(), str(tmp_path / "cp"))
    assert [r.processed for r in done] == [1, 1, 1, 1]
    assert jobs.rounds(stream, lambda df, i: df.count(), str(tmp_path / "cp")) == []


def test_rounds_end_without_progress_and_lose_nothing(spark, tmp_path):
    stream, seen = source_of(spark, tmp_path, 5), []

    def stuck_after_two(df, i):
        if len(seen) == 2:
            return 0
        seen.extend(r["id"] for r in df.collect())
        return df.count()

    assert len(jobs.rounds(stream, stuck_after_two, str(tmp_path / "cp"))) == 2

    def work(df, i):
        seen.extend(r["id"] for r in df.collect())
        return df.count()

    assert len(jobs.rounds(stream, work, str(tmp_path / "cp"), most=2)) == 2
    assert len(jobs.rounds(stream, work, str(tmp_path / "cp"))) == 1
    assert sorted(seen) == [0, 1, 2, 3, 4]
