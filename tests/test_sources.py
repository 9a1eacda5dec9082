import gzip
import io
import json
import math
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom import schemas
from voxloom.sources import arrow_stream, readers, sinks, wav


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def wav_bytes(seconds=1.0, rate=8000, channels=2):
    x = (np.sin(np.arange(int(seconds * rate)) / 5) * 12000).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(x, channels).tobytes())
    return out.getvalue()


def test_text_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"utt_id":"a","dataset":"d","text":"x"}\nbroken\n\n{"utt_id":"b","dataset":"d","text":" "}\n')
    assert rows(readers.read_manifest(spark, str(tmp_path / "m.jsonl")).select("utt_id", "text")) == [("a", "x")]
    (tmp_path / "t.tsv").write_text('u1\tsay "hi"\tthere\nbad\n\nu2\ty\n')
    assert rows(readers.read_tsv_transcript(spark, str(tmp_path / "t.tsv")).select("line", "utt_id", "text"), "line") == [(0, "u1", 'say "hi"\tthere'), (3, "u2", "y")]
    assert rows(readers.read_keyed_text(spark, str(tmp_path / "t.tsv")).select("key"), "line")[1] == ("line_2",)
    (tmp_path / "tokens.txt").write_text("<blk> 0\n▁A B 1\n")
    assert rows(readers.read_tokens(spark, str(tmp_path / "tokens.txt")), "id") == [("<blk>", 0), ("▁A B", 1)]
    (tmp_path / "speakers.txt").write_text(";id | sex | name\n14 | F | x | y\n")
    assert rows(readers.read_pipe_table(spark, str(tmp_path / "speakers.txt"), ["id", "sex", "name"])) == [("14", "F", "x | y")]
    (tmp_path / "a.dot").write_text("hello there (utt1)\n")
    (tmp_path / "a.ptx").write_text("HELLO (utt1)\nother (utt2)\n")
    assert rows(readers.read_paren_transcripts(spark, str(tmp_path / "a.*")), "utt_id") == [("utt1", "hello there"), ("utt2", "other")]
    (tmp_path / "urls.csv").write_text("url,x\n b ,1\na,2\nb,3\n,4\n")
    assert sorted(r[0] for r in rows(readers.read_urls(spark, str(tmp_path / "urls.csv"), "url").select("url"))) == ["a", "b"]
    with pytest.raises(ValueError):
        readers.read_urls(spark, str(tmp_path / "urls.csv"), "link")
    with gzip.open(tmp_path / "train_prompts.gz", "wt") as f:
        f.write("id1 some words\nid2\n")
    assert rows(readers.read_prompts_gz(spark, str(tmp_path / "train_prompts.gz"))) == [("id1", "some words", "train")]
    (tmp_path / "ledger.tsv").write_text("timestamp\tname\tsource_dir\tcompressed_bytes\tsha256\tparts\tstatus\n2024-01-02 03:04:05\tx\t/d\t12\tab\t1\tDONE\n")
    assert readers.read_ledger(spark, str(tmp_path / "ledger.tsv")).first()["compressed_bytes"] == 12
    (tmp_path / "seg.csv").write_text("src,segment_path\na,b\n")
    assert readers.read_segments_csv(spark, str(tmp_path / "seg.csv"), schemas.VAD_SEGMENTS, ["src"]).first()["duration_sec"] is None
    (tmp_path / "i.ndx").write_text("; note\n11_1_1: /wsj0/a.wv1\n")
    assert rows(readers.read_index_list(spark, str(tmp_path / "i.ndx"))) == [("11-1.1", "wsj0/a.wv1")]


def test_metadata_and_sidecars(spark, tmp_path):
    for name, text in (("m1", json.dumps({"mix_id": "m1", "sources": [{"seg_id": "s", "start_sec": 1.0}]})), ("m2", "{broken")):
        (tmp_path / "mix" / name).mkdir(parents=True)
        (tmp_path / "mix" / name / "metadata.json").write_text(text)
    good, bad = readers.read_mix_metadata(spark, str(tmp_path / "mix"))
    assert [r["mix_id"] for r in good.collect()] == ["m1"] and bad.count() == 1
    (tmp_path / "side").mkdir()
    (tmp_path / "side" / "x.wav").write_bytes(wav_bytes())
    (tmp_path / "side" / "x.txt").write_text("words\n")
    assert [r["text"] for r in readers.read_sidecar_text(spark, str(tmp_path / "side")).collect()] == ["words"]
    assert readers.list_audio(spark, str(tmp_path / "side")).count() == 1


def test_wav_jobs(spark, tmp_path):
    df = spark.createDataFrame([("a", wav_bytes()), ("b", b"none")], "path string, content binary")
    found = {r["path"]: r for r in wav.probe_wav(df).collect()}
    assert found["a"]["frames"] == 8000 and found["a"]["channels"] == 2 and found["b"]["error"]
    out = {r["path"]: r for r in wav.normalize_audio(df, 16000).collect()}
    assert out["a"]["num_samples"] == 16000 and out["b"]["wav"] is None
    x, rate = wav.samples_of(bytes(out["a"]["wav"]))
    assert rate == 16000 and abs(float(np.abs(x).max()) - 12000 / 32768) < 0.01
    energy = wav.frame_energy(df)
    assert energy.count() == len(range(0, 8000 - 240 + 1, 80)) and all(math.isfinite(r["energy"]) for r in energy.collect())
    shard = spark.createDataFrame([("p-00003.parquet", 7, "x/y.mp3", wav_bytes(), " hi "), ("p-00003.parquet", 8, "z.wav", b"?", "ho")], "source_file string, source_row long, source_audio_path string, audio_bytes binary, text string")
    good, state = wav.extract_shards(shard, "d", "train")
    assert [(r["utt_id"], r["audio_path"], r["text"]) for r in good.collect()] == [("d__train__p00003__r00000007", "y.wav", "HI")] and state.first()["failed"] == 1


def test_arrow_stream(spark, tmp_path):
    table = pa.table({"audio": [{"path": "a.wav", "bytes": b"1"}, {"path": "b.wav", "bytes": b"2"}], "text": ["x", ""], "sid": [1, 2]})
    with pa.OSFile(str(tmp_path / "shard.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    found = arrow_stream.read_arrow_stream(spark, str(tmp_path / "shard.arrow"), with_bytes=True).collect()
    assert [(r["source_audio_path"], bytes(r["audio_bytes"]), r["text"], r["sid"], r["source_row"]) for r in found] == [("a.wav", b"1", "x", "1", 0)]


def test_parquet_audio(spark, tmp_path):
    df = spark.createDataFrame([(("a.wav", bytearray(b"1")), "x"), (("b.wav", bytearray(b"2")), " ")], "audio struct<path:string,bytes:binary>, transcription string")
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    found = readers.read_parquet_audio(spark, str(tmp_path / "p"), "transcription")
    assert [(r["source_audio_path"], r["source_row"]) for r in found.collect()] == [("a.wav", 0)]
    assert "bytes" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1].split("\n")[0]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("u1", "a.wav", "x\ty", "train", "single"), ("u2", "b.wav", "z", "val", "single")], "utt_id string, audio_path string, text string, split string, mix_type string")
    sinks.write_manifest(df, str(tmp_path / "m"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    assert sorted(r["text"] for r in spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).collect()) == ["x y", "z"]
    sinks.append_results(df, str(tmp_path / "r"))
    sinks.append_results(df, str(tmp_path / "r"))
    sinks.replace_table(sinks.read_table(spark, str(tmp_path / "r")).filter("utt_id = 'u1'"), str(tmp_path / "r"))
    assert sinks.read_table(spark, str(tmp_path / "r")).count() == 2
    sinks.write_by_split_mix(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).filter("split = 'val' and mix_type = 'single'").count() == 1
    assert sum(r["rows"] for r in sinks.write_shards(df, 3, str(tmp_path / "h")).collect()) == 2
    sinks.write_summary(df.agg(F.count("*").alias("n")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["n"] == 2
    lines = sinks.recog_lines(spark.createDataFrame([("b", "r", "h"), ("a", "x", None)], "id string, ref string, hyp string"))
    assert [r[0] for r in lines.collect()] == ["a:\tref=x", "a:\thyp=", "b:\tref=r", "b:\thyp=h"]
    sinks.rewrite_text_field(df.withColumn("new", F.upper("text")), "text", "new", str(tmp_path / "w"), "tsv", "utt_id")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "w")).collect()) == ["u1\tX\tY", "u2\tZ"]
