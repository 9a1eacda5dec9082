import random
from datetime import datetime, timedelta, timezone

from voxloom.operators.intervals import merge_nearby
from voxloom.streaming import jobs


def frames_of(seed, n):
    rng, out, speech = random.Random(seed), [], False
    for _ in range(n):
        speech = speech if rng.random() < 0.9 else not speech
        out.append(speech)
    return out


def test_segmenter_splits_and_trims():
    config = jobs.SegmenterConfig(1.0, 2.0, 5.0, 2.0, 0.0)
    s = jobs.Segmenter(config)
    found = [x for flag in [0, 1, 1, 1, 0, 0, 1, 0, 0, 1, 1, 1, 1, 1, 1] for x in s.feed(bool(flag))] + s.flush()
    assert found == [(1, 3), (9, 5)]


def test_stream_equals_batch(spark, tmp_path):
    config = jobs.SegmenterConfig(0.1, 0.3, 2.0, 0.3, 0.05)
    every = [(src, i, speech, i == 299) for src in ("a", "b") for i, speech in enumerate(frames_of(src, 300))]
    schema = "src string, frame_idx long, is_speech boolean, is_last boolean"
    for k, (low, high) in enumerate(((0, 70), (70, 200), (200, 300))):
        spark.createDataFrame([r for r in every if low <= r[1] < high], schema).coalesce(1).write.json(str(tmp_path / "in" / f"{k}"))
    import os
    import shutil

    os.makedirs(tmp_path / "feed")
    query = None
    stream = spark.readStream.schema(schema).json(str(tmp_path / "feed"))
    for k in range(3):
        part = next((tmp_path / "in" / f"{k}").glob("part-*"))
        shutil.copy(part, tmp_path / "feed" / f"{k}.json")
        query = jobs.stream_segments(stream, config).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in jobs.batch_segments(spark.createDataFrame(every, schema), config).collect()}
    assert got == want and len(want) > 4


def test_regions_by_event_time(spark, tmp_path):
    rng, t0 = random.Random(1), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(rng.choice("ab"), t0 + timedelta(seconds=rng.randrange(3000)), float(rng.randint(1, 30))) for _ in range(60)]
    df = spark.createDataFrame(rows, "src string, ts timestamp, duration_sec double")
    df.write.parquet(str(tmp_path / "in"))
    # a row long after all others moves the watermark past them
    spark.createDataFrame([("z", t0 + timedelta(days=2), 1.0)], df.schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = jobs.stream_regions(stream, 10.0).writeStream.format("memory").queryName("regions").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["src"], r["start_sec"], r["end_sec"]) for r in spark.sql("select * from regions where src <> 'z'").collect())
    table = df.selectExpr("src", "unix_micros(ts) / 1e6 as start_sec", "unix_micros(ts) / 1e6 + duration_sec as end_sec")
    assert got == sorted(tuple(r) for r in merge_nearby(table, 10.0).collect())


def test_watch_and_votes(spark, tmp_path):
    schema = "denoised_path string, zipformer_text string, gipformer_text string, ts timestamp"
    spark.createDataFrame([("a", "x", "X."), ("b", "x", "y"), ("a", "x", "X.")], "denoised_path string, zipformer_text string, gipformer_text string").selectExpr("*", "timestamp'2024-01-01 00:00:00' as ts").write.json(str(tmp_path / "in"))
    seen = []
    jobs.watch(spark, str(tmp_path / "in"), schema, lambda df, i: seen.append(df.count()), str(tmp_path / "cp1")).awaitTermination(120)
    assert sum(seen) == 3
    jobs.watch(spark, str(tmp_path / "in"), schema, lambda df, i: seen.append(df.count()), str(tmp_path / "cp1")).awaitTermination(120)
    assert sum(seen) == 3
    query = jobs.stream_vote(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("votes").option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["denoised_path"], r["decision_reason"]) for r in spark.sql("select * from votes").collect()) == [("a", "exact"), ("b", "mismatch")]
