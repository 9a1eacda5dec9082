import time

import pytest

from voxloom.sources.tail import Range, TailReader, tail_log


def read_all(reader, start):
    end = reader.latestOffset()
    parts = reader.partitions(start, end)
    rows = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    return rows, end


@pytest.mark.parametrize("range_bytes", [1, 3, 7, 1 << 20])
def test_ranges_hold_each_line_once(tmp_path, range_bytes):
    lines = ["one", "", "two two", "x" * 50, "  spaced ", "ü" * 5, "last"]
    log = tmp_path / "a.log"
    log.write_text("\n".join(lines) + "\n" + "unfinished")
    reader = TailReader({"path": str(tmp_path), "rangebytes": str(range_bytes)})
    rows, end = read_all(reader, {})
    assert [r[2] for r in rows] == [x.strip() for x in lines if x] and end == {str(log): len("\n".join(lines).encode()) + 1}
    data = log.read_bytes()
    assert all(data[at:].decode().startswith(next(x for x in lines if x.strip() == v)) for _, at, v in rows)
    assert reader.partitions(end, end) == []


def test_logs_grow_shrink_and_go(tmp_path):
    log = tmp_path / "sub" / "a.log"
    log.parent.mkdir()
    log.write_text("one\ntw")
    reader = TailReader({"path": str(tmp_path), "pattern": "*.log"})
    (tmp_path / "other.txt").write_text("no log\n")
    rows, end = read_all(reader, {})
    assert [r[2] for r in rows] == ["one"]
    with log.open("a") as f:
        f.write("o\nthree\n")
    rows, end = read_all(reader, end)
    assert [r[2] for r in rows] == ["two", "three"]
    again = TailReader({"path": str(tmp_path), "pattern": "*.log"})
    assert read_all(again, end)[0] == []
    log.write_text("new\n")
    rows, end = read_all(reader, end)
    assert [r[2] for r in rows] == ["new"]
    log.unlink()
    assert read_all(reader, end) == ([], {})


def test_finished_logs(tmp_path):
    log, mark = tmp_path / "used.txt", tmp_path / "used.txt.done.json"
    log.write_text("a\nb")
    reader = TailReader({"path": str(tmp_path), "marker": ".done.json"})
    assert read_all(reader, {}) == ([], {})
    mark.write_text("{}")
    rows, end = read_all(reader, {})
    assert [r[2] for r in rows] == ["a", "b"] and read_all(reader, end)[0] == []
    time.sleep(0.02)
    log.write_text("c\n")
    mark.write_text("{ }")
    assert [r[2] for r in read_all(reader, end)[0]] == ["c"]


def test_bytes_that_are_no_text(tmp_path):
    (tmp_path / "x").write_bytes(b"\xff\xfeok\n\xff\n")
    assert [r[2] for r in read_all(TailReader({"path": str(tmp_path)}), {})[0]] == ["ok"]
    assert list(TailReader({"path": str(tmp_path)}).read(Range(str(tmp_path / "x"), 0, 0, 0, 0))) == []


def test_restarted_query_reads_each_line_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    written = []

    def grow(name, n, cut=False):
        with (logs / name).open("a") as f:
            for _ in range(n):
                written.append(f"{name} line {len(written)}")
                f.write(written[-1] + "\n")
            if cut:
                written.append(f"{name} line {len(written)}")
                f.write(written[-1][:4])
                return written[-1][4:] + "\n"

    def run():
        stream = tail_log(spark, str(logs), range_bytes=64)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    rest = grow("a.log", 20, cut=True)
    assert run() == sorted(written[:-1])
    with (logs / "a.log").open("a") as f:
        f.write(rest)
    grow("b.log", 5)
    assert run() == sorted(written)
    assert run() == sorted(written)
    grow("a.log", 3)
    assert run() == sorted(written)
