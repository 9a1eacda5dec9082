"""Tables replaced under readers, shards resumed from their ledger, and headers of WAV files."""

import io
import struct
import threading
import wave

import pytest

from voxloom.sources import versions, wav


def wav_bytes(channels=1, width=2, rate=8000, frames=80):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"\x01\x02" * (frames * channels * width // 2))
    return out.getvalue()


def test_readers_never_miss_a_table(spark, tmp_path):
    table = str(tmp_path / "table")
    versions.replace_table(spark.range(3).coalesce(1), table)
    seen, failed, over = [], [], threading.Event()

    def read():
        while not over.is_set():
            try:
                seen.append(versions.read_table(spark, table).count())
            except Exception as e:
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(100):
        versions.replace_table(spark.range(3 + k % 2).coalesce(1), table)
    over.set()
    reader.join()
    assert not failed and set(seen) <= {3, 4} and len(seen) > 20


def test_versions_come_from_the_table_itself_and_go(spark, tmp_path):
    table = str(tmp_path / "table")
    for k in range(4):
        old = versions.read_table(spark, table) if k else spark.range(0)
        assert versions.replace_table(old.union(spark.range(k, k + 1)), table, keep=2, keep_sec=0.0) == k
    assert sorted(r[0] for r in versions.read_table(spark, table).collect()) == [0, 1, 2, 3]
    assert versions.read_table(spark, table, 2).count() == 3 and [v[0] for v in versions.versions(spark, table)] == [2, 3]
    assert len(list((tmp_path / "table" / "_data").iterdir())) == 2
    with pytest.raises(ValueError):
        versions.read_table(spark, table, 0)
    (tmp_path / "table" / "_data" / "half").mkdir()
    assert versions.read_table(spark, table).count() == 4
    spark.range(5).write.parquet(str(tmp_path / "plain"))
    assert versions.read_table(spark, str(tmp_path / "plain")).count() == 5


def test_shards_go_on_after_a_lost_run(spark, tmp_path, monkeypatch):
    rows = [(f"p-{s:05d}.parquet", i, f"{s}-{i}.wav", wav_bytes() if i else b"broken", f"text {i}") for s in range(9) for i in range(4)]
    shards = spark.createDataFrame(rows, "source_file string, source_row long, source_audio_path string, audio_bytes binary, text string")
    root, note, rounds = str(tmp_path / "out"), wav.finish, []

    def lost(state, root):
        rounds.append(1)
        if len(rounds) == 2:
            raise RuntimeError("lost")
        note(state, root)

    monkeypatch.setattr(wav, "finish", lost)
    with pytest.raises(RuntimeError):
        wav.extract_shards_to(shards, root, "d", "train", at_once=3)
    monkeypatch.setattr(wav, "finish", note)
    some = wav.ledger(spark, root).count()
    assert 0 < some < 9 and wav.extracted(spark, root).count() == 3 * some < spark.read.parquet(f"{root}/rows").count()
    found = wav.extract_shards_to(shards, root, "d", "train", at_once=3)
    assert sorted(tuple(r) for r in found.collect()) == [(f"p-{s:05d}.parquet", 4, 1) for s in range(9)]
    assert sorted((r["source_file"], r["source_row"]) for r in wav.extracted(spark, root).collect()) == sorted((r[0], r[1]) for r in rows if r[1])
    assert wav.extract_shards_to(shards, root, "d", "train").count() == 9 and wav.extracted(spark, root).count() == 27
    assert wav.extract_shards_to(shards, str(tmp_path / "few"), "d", "train", most=2).count() == 2


def test_headers(spark):
    extra = wav_bytes(2, 3, 44100, 10)
    extra = extra[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + extra[12:]
    files = {"mono": wav_bytes(), "extra": extra, "none": b"none", "null": None, "empty": b"", "cut": wav_bytes()[:30], "only": wav_bytes()[:36], "zero": wav_bytes()[:24] + b"\0" * 4 + wav_bytes()[28:]}
    found = {r["path"]: tuple(r)[1:] for r in wav.probe_wav(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()}
    assert found["mono"] == (80, 8000, 1, 0.01, None) and found["extra"] == (10, 44100, 2, 10 / 44100, None)
    assert {k: found[k][-1] for k in ("none", "null", "empty", "cut", "only", "zero")} == {"none": "no WAV file", "null": "no WAV file", "empty": "no WAV file", "cut": "no format", "only": "no samples", "zero": "bad format"}
    assert all(found[k][:-1] == (None,) * 4 for k in ("none", "null", "empty", "cut", "only", "zero"))
