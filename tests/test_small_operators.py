"""Operators that no query registers, on a few rows each."""

import json

import pytest
from pyspark.sql import functions as F

from voxloom.functions import align, hashing, names
from voxloom.functions import text as tx
from voxloom.operators import compose as co
from voxloom.operators import cuts as cu
from voxloom.operators import intervals as iv
from voxloom.operators import relational as re_
from voxloom.operators import vocab as vo
from voxloom.sources import readers, sinks
from voxloom.streaming import jobs


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a b", "A, b.", "HTTP 429 Too many", [1, 2])], "raw string, norm string, message string, seq array<int>")
    one = df.select(
        tx.compare_pair("raw", "norm").alias("c"), tx.classify_error("message", ["private video"], ["429"]).alias("e"), tx.classify_error(F.lit(None).cast("string"), ["x"], ["y"]).alias("o"),
        tx.build_prompt("raw", F.lit(True), F.lit(False), F.lit(True)).alias("p"), align.non_number_distance(F.lit("hai 3 quả"), F.lit("2 quả to")).alias("d"),
        cu.speaker_map(F.array(F.lit(1), F.lit(3)), F.array(F.lit("x"), F.lit("y")), F.array(F.lit(3), F.lit(2), F.lit(1))).alias("m"), hashing.keyed_seed("raw", F.lit(1)).alias("s"), hashing.keyed_seed("raw", F.lit(2)).alias("t"),
        tx.strip_control(F.lit("a\x00b\r\nc ")).alias("x"),
    ).first()
    assert tuple(one["c"]) == (True, True, 2, 2, 0, 2) and one["e"] == "retry" and one["o"] == "other"
    assert one["p"].endswith("TEXT: a b") and "digits" in one["p"] and "Put punctuation" not in one["p"]
    assert one["d"] == 1 and one["m"] == ["y", None, "x"] and one["s"] != one["t"] and one["x"] == "ab c"


def test_rows_are_chosen(spark):
    df = spark.createDataFrame([("u1", "/a/x.wav", "d1", False, 5.0), ("u2", "http://h/y.wav", "d2", False, 9.0), ("u3", "/a/z.mp3", "d1", True, 1.0)], "utt_id string, audio_path string, dataset string, accepted boolean, duration_sec double")
    assert rows(re_.filter_local_wav(df).select("utt_id")) == [("u1",)]
    assert rows(re_.filter_target(df, "y", "audio_path").select("utt_id")) == [("u2",)]
    assert rows(re_.select_datasets(df, ["d1"]).select("utt_id"), "utt_id") == [("u1",), ("u3",)]
    assert [r[0] for r in rows(re_.longest_first(df, "utt_id").select("utt_id"))] == ["u2", "u1", "u3"] and rows(re_.subset(df, 2, ["utt_id"]).select("utt_id")) == [("u1",), ("u2",)]
    assert rows(vo.dataset_alias(df, {"all": ["d1", "d2"]}, "all").select("utt_id"), "utt_id") == [("u1",), ("u2",), ("u3",)] and vo.dataset_alias(df, {}, "d2").count() == 1
    quality = spark.createDataFrame([(1, 0.0, 0.0, 1), (1, 0.2, 0.0, 2), (2, 0.1, 0.0, 2), (2, 0.05, 0.0, 2), (3, 0.2, 0.03, 3), (3, 0.2, 0.01, 3)], "num_speakers int, ov2 double, ov3 double, max_active int")
    assert [r["pass_all"] for r in re_.quality_check(quality).collect()] == [True, False, True, False, True, False]
    tries = spark.createDataFrame([("m", 0, 2, 0.1, 0.5), ("m", 1, 3, 0.0, 0.1), ("m", 2, 3, 0.2, 0.1)], "mix string, candidate int, max_active int, ov3 double, ov2 double")
    assert rows(re_.best_candidate(tries, "mix").select("mix", "candidate")) == [("m", 2)]
    unknown = spark.createDataFrame([("b", 1, "x" * 300), ("a", 2, "y"), ("c", 0, "z")], "utt_id string, unknown int, text string")
    assert [(r[0], len(r[2])) for r in rows(re_.unknown_examples(unknown, 5))] == [("a", 1), ("b", 280)]
    more = spark.createDataFrame([("u1", "other"), ("u9", "new")], "utt_id string, dataset string")
    assert rows(re_.merge_distinct([df.select("utt_id", "dataset"), more], "utt_id"), "utt_id") == [("u1", "d1"), ("u2", "d2"), ("u3", "d1"), ("u9", "new")]
    info = spark.createDataFrame([("u1", "f")], "who string, gender string")
    assert rows(re_.attach_by_prefix(spark.createDataFrame([("u1_7",), ("u2_8",)], "id string"), info, "id", 2, "who").select("id", "gender"), "id") == [("u1_7", "f"), ("u2_8", None)]


def test_examples_and_cuts(spark):
    mixes = spark.createDataFrame([("m1", 9.0, "all"), ("m2", 4.0, "alone")], "mix_id string, duration_sec double, text string")
    sources = spark.createDataFrame([("m1", "s1", "A", 1.0, 3.0, "x")], "mix_id string, seg_id string, speaker_id string, start_sec double, duration_sec double, text string")
    assert rows(cu.attach_supervisions(mixes, sources), "id") == [("m2_sup0", "m2", 0.0, 4.0, 0, "alone", "unknown"), ("s1", "m1", 1.0, 3.0, 0, "x", "A")]
    one = spark.createDataFrame([("e1", "a.wav", 9, None), ("e2", None, 3, "s")], "example_id string, audio_path string, num_samples int, scenario string")
    assert [(r["scenario"], r["audio_path"]["observation"]) for r in cu.normalize_example(one.filter("audio_path is not null"), ["audio_path"]).collect()] == [("e1", "a.wav")]
    with pytest.raises(Exception, match="missing"):
        cu.normalize_example(one, ["audio_path"]).collect()
    group = spark.createDataFrame([(0, 0, "a", "s1", "d", 5), (0, 1, "b", "s2", "d", 7)], "g int, slot int, example_id string, speaker_id string, dataset string, n int")
    assert rows(cu.collate(group, "g", "slot", ["example_id", "speaker_id", "n"]).select("example_id", "speaker_id", "n")) == [("a_b", ["s1", "s2"], [5, 7])]
    with pytest.raises(Exception, match="repeats a speaker"):
        cu.collate(group.withColumn("speaker_id", F.lit("s")), "g", "slot", ["example_id", "n"]).collect()
    wide = spark.createDataFrame([("e", ["A", "B", "A"], ["f", "m", "f"], [1, 2, 3])], "id string, speaker_id array<string>, gender array<string>, offset array<int>")
    assert rows(cu.by_speaker(wide, "id", ["gender"], ["offset"]), "speaker_id") == [("e", "A", "f", [1, 3]), ("e", "B", "m", [2])]
    with pytest.raises(Exception, match="differ"):
        cu.by_speaker(wide.withColumn("gender", F.array(*map(F.lit, ("f", "m", "m")))), "id", ["gender"], ["offset"]).collect()
    manifest = spark.createDataFrame([("u", "a.wav", "x", "s", 16000, 8000)], "utt_id string, audio_path string, text string, speaker_id string, sample_rate int, num_samples long")
    old = cu.build_cuts(manifest)
    assert sorted(r["id"] for r in cu.merge_prefixed(old, old, "n-").collect()) == ["n-u", "u"]
    with pytest.raises(Exception, match="both tables"):
        cu.merge_prefixed(old, old, "").collect()


def test_activity_of_sources(spark):
    df = spark.createDataFrame([("s1", 100, 50), ("s2", 0, 30)], "source_id string, offset long, num_samples long")
    vad = spark.createDataFrame([("s1", 5, 10), ("s1", 20, 40)], "source_id string, start long, stop long")
    assert rows(iv.align_to_vad(df, vad), "source_id") == [("s1", 105, 35), ("s2", 0, 30)]
    assert rows(iv.activity_from_vad(df, vad).select("source_id", "start", "stop"), "start") == [("s1", 105, 110), ("s1", 120, 140)]
    ends = spark.createDataFrame([("m", "A", 10.0), ("m", "B", 8.0), ("m", "C", 3.0)], "m string, speaker string, end double")
    reach = lambda me, at_once: iv.max_allowed_overlap(ends, "m", F.lit(me), at_once).first()["max_overlap"]
    assert reach("D", 2) == 2.0 and reach("D", 3) == 7.0 and reach("A", 3) == 0.0 and reach("B", 3) == 2.0


def test_draws_and_splits(spark):
    people = spark.createDataFrame([(f"u{i}", f"s{i % 20:02d}") for i in range(100)], "utt_id string, speaker_id string")
    split = co.split_speakers(people, 0.7, 0.2)
    counts = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.countDistinct("speaker_id").alias("n")).collect()}
    assert counts == {"train": 14, "val": 4, "test": 2} and split.count() == 100 and split.groupBy("speaker_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("none", 0.0)], "dataset string, weight double")
    drawn = {r["dataset"]: r["count"] for r in co.weighted_pick(spark.range(4000), "id", weights).groupBy("dataset").count().collect()}
    assert set(drawn) == {"a", "b"} and abs(drawn["a"] - 3000) < 150
    groups = spark.createDataFrame([(g, s) for g in range(300) for s in range(3)], "group int, slot int")
    sizes = co.compose_variable(groups, [1, 3]).groupBy("group").agg(F.count("*").alias("n"), F.max("size").alias("size")).collect()
    assert {r["n"] for r in sizes} == {1, 3} and all(r["n"] == r["size"] for r in sizes)
    sources = spark.createDataFrame([(i, [100, 40]) for i in range(50)], "example_id int, num_samples array<long>")
    assert all(r["offset"] == [7, 7] for r in co.offsets(sources, "constant", constant=7).collect())
    assert all(r["offset"][0] == 0 and 0 <= r["offset"][1] <= 60 for r in co.offsets(sources, "random").collect())
    assert all(r["offset"][0] == 0 and 30 <= r["offset"][1] <= 70 for r in co.offsets(sources, "partial").collect())
    with pytest.raises(ValueError):
        co.offsets(sources, "other")


def test_more_readers_and_writers(spark, tmp_path):
    cut = {"id": "c", "start": 0.0, "duration": 1.0, "supervisions": [{"id": "s", "text": "x"}]}
    for name in ("train.single.cuts_clean.jsonl", "train.other.cuts_clean.jsonl", "train.single.cuts_rir.jsonl"):
        (tmp_path / name).write_text(json.dumps(cut) + "\n")
    found = readers.read_cuts(spark, str(tmp_path), ["single"], ["clean", "rir"]).collect()
    assert sorted(r["file"] for r in found) == ["train.single.cuts_clean.jsonl", "train.single.cuts_rir.jsonl"] and found[0]["supervisions"][0]["text"] == "x"
    (tmp_path / "spk.txt").write_text("; note\n001 Male x\n002 F\n001 female\n003 ?\n")
    assert rows(readers.read_speaker_info(spark, str(tmp_path / "spk.txt")).select("speaker"), "speaker") == [("001",), ("002",)]
    assert [r["text"] for r in readers.pick_text_column(spark.createDataFrame([(" ", "b"), ("a", "c")], "transcription string, sentence string")).collect()] == ["b", "a"]
    segs = spark.createDataFrame([("s1", "hello"), ("s2", "there")], "seg_id string, text string")
    sinks.write_supervision_text(segs, str(tmp_path / "sup"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "sup")).collect()) == ["s1 hello", "s2 there"]
    scores = spark.createDataFrame([("b", 1, [["x"]], [["y"]]), ("a", 0, [["z"]], [["z"]])], "id string, errors int, ref_per_speaker array<array<string>>, hyp_per_speaker array<array<string>>")
    sinks.write_per_utt_scores(scores, str(tmp_path / "scores"))
    assert spark.read.json(str(tmp_path / "scores/scores")).count() == 2 and spark.read.text(str(tmp_path / "scores/transcripts")).first()[0].startswith("a\terrors=0")
    lines = [f"line {i} " + "x" * 50 for i in range(400)]
    (tmp_path / "long.txt").write_text("\n".join(lines) + "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    try:
        numbered = rows(readers.read_lines(spark, str(tmp_path / "long.txt")).select("line", "value"), "line")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert numbered == list(enumerate(lines))


def test_streams_of_logs_and_progress(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\ntwo\n")
    stream = jobs.tail_log(spark, str(tmp_path / "logs"))
    for want in (2, 2):
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == want
    done = spark.createDataFrame([("2024-01-01 00:10:00", "d", 1800.0), ("2024-01-01 00:20:00", "d", 1800.0), ("2024-01-01 09:00:00", "e", 60.0)], "t string, dataset string, duration_sec double").select(F.to_timestamp("t").alias("ts"), "dataset", "duration_sec")
    done.write.parquet(str(tmp_path / "rows"))
    stream = jobs.stream_progress(spark.readStream.schema(done.schema).parquet(str(tmp_path / "rows")))
    query = stream.writeStream.format("memory").queryName("progress_rows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["dataset"], r["rows"], r["hours"]) for r in spark.table("progress_rows").collect()) == [("d", 2, 1.0), ("e", 1, 0.016667)]


def test_names_of_rows(spark):
    one = spark.createDataFrame([("d", "train", 3, 12)], "d string, s string, p int, r int").select(names.row_utt_id("d", "s", "p", "r")).first()[0]
    assert one == "d__train__p00003__r00000012"
