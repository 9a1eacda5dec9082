"""What the findings of round 3 were about."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import align
from voxloom.operators import compose as co
from voxloom.plans import catalog


def test_buckets_of_batches_are_cut_at_exact_ranks(spark):
    rows = spark.range(0, 100_000, 1, 8).select("id", (F.pmod(F.col("id") * 7919, F.lit(100_003)) / 7).alias("duration_sec"))
    found = co.exact_edges(rows, "duration_sec", 4).first()["_edges"]
    values = sorted(r[0] for r in rows.select("duration_sec").collect())
    assert found == [values[25_000 - 1], values[50_000 - 1], values[75_000 - 1]]
    buckets = co.plan_batches(rows, 1e5, 4).groupBy(F.element_at(F.split("batch", "-"), 1).alias("b")).count().collect()
    assert sorted(r["count"] for r in buckets) == [25_000] * 4
    few = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0)], "id int, duration_sec double")
    assert co.exact_edges(few, "duration_sec", 3).first()["_edges"] == [1.0, 1.0]
    assert co.plan_batches(few.filter("id > 9"), 10.0, 3).count() == 0


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Documents with lines that come again, as only plain words can show."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    rows = [(i, "src1", " ".join(["one two three four five six seven"] * (3 + i % 9)), 300 * (1 + i)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return folder


def edited_words(doc, words):
    out = []
    for i, w in enumerate(words):
        new = f"zz{doc}q{i}"
        changed = doc % 4 != 3 and (doc * 7919 + i * i * 31 + i * 17) % 97 < 10
        out += [w] if not changed else [new] if doc % 4 == 0 or i % 3 == 1 else [w, new] if doc % 4 == 1 else []
    return out


def test_diffs_and_salvage_read_plain_words(spark, repeated):
    matched = 0
    for r in catalog.word_diff(spark, repeated).collect():
        a = (" ".join(["one two three four five six seven"] * (3 + r["doc_id"] % 9))).split()
        b = edited_words(r["doc_id"], a)
        alike = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert (r["ratio"], r["differs"]) == (round(alike.ratio(), 6), a != b)
        if a != b and r["doc_id"] % 7:
            matched += sum(x.size for x in alike.get_matching_blocks())
    assert catalog.salvage_stats(spark, repeated).first()["matched"] == matched


def test_blocks_of_many_pairs_together(monkeypatch):
    rng = random.Random(3)
    pairs = [([rng.randrange(k) for _ in range(rng.randrange(50))], [rng.randrange(k) for _ in range(rng.randrange(50))]) for k in (1, 2, 5, 40) for _ in range(60)]
    lists = [[np.array([w for p in pairs for w in p[s]], np.int64), np.cumsum([0] + [len(p[s]) for p in pairs])] for s in (0, 1)]
    want = [(k, *x) for k, (a, b) in enumerate(pairs) for x in align.common_blocks(a, b)]
    for together, few in ((1 << 20, 1 << 18), (300, 1 << 18), (100, 60)):
        monkeypatch.setattr(align, "TOGETHER", together)
        monkeypatch.setattr(align, "FEW", few)
        assert list(zip(*(c.tolist() for c in align.many_blocks(*lists[0], *lists[1])))) == want


def test_whole_words_as_pieces_of_words():
    import pyarrow as pa

    from voxloom.operators import voting as vt

    rows = [["▁One", "▁--", "▁two_2", "▁É"], [], None, ["▁a"]]
    times = [[0.0, 0.25, 0.25, 1.0], [], None, [3.0]]
    columns = pa.array(rows, pa.list_(pa.string())), pa.array(times, pa.list_(pa.float64()))
    want = [[w._asdict() for w in vt.timed_words(a or [], b or [])] for a, b in zip(rows, times)]
    assert vt.whole_words(*columns).to_pylist() == want
    assert vt.whole_words(pa.array([["▁a", "b"]]), pa.array([[0.0, 1.0]])) is None


def test_votes_read_documents_once(spark, sf_dir):
    plan = catalog._votes(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan


def test_reports_choose_among_written_votes(spark, sf_dir):
    plan = catalog.reject_reports(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" not in plan and "regexp_replace" not in plan


def test_texts_are_encoded_in_slices():
    import pyarrow as pa

    from voxloom.operators import vocab as vo

    texts = ["A" * 600_000, "B B", None, "C" * 600_000, "D" * 3_000_000, ""]
    batch = pa.record_batch([pa.array(texts), pa.array(range(6))], names=["t", "k"])
    parts = list(vo.slices(batch, "t"))
    assert [x for p in parts for x in p.column("t").to_pylist()] == texts
    assert [p.num_rows for p in parts] == [3, 1, 1, 1] and not list(vo.slices(batch.slice(0, 0), "t"))


def test_shorter_runs_are_counted_from_the_longest(spark):
    from voxloom.operators import vocab as vo

    rows = spark.createDataFrame([(["a", "b c", "a"],), ([],), (None,)], "tokens array<string>")
    model = vo.ngram_model(rows, 2)
    assert {(r["order"], r["gram"]): r["count"] for r in model.collect()} == {
        (1, "a"): 2, (1, "b c"): 1, (1, "</s>"): 2, (2, "<s> a"): 1, (2, "a b c"): 1, (2, "b c a"): 1, (2, "a </s>"): 1, (2, "<s> </s>"): 1,
    }
    alone = model.filter("order = 2")._jdf.queryExecution().optimizedPlan().toString()
    assert alone.count("Generate explode") == 1 and "Union" not in alone


def test_stages_of_segments_are_written(spark):
    """no stage carries the windows of those before it."""
    from voxloom.operators import intervals as iv

    frames = spark.createDataFrame([(1, i, i % 50 < 40) for i in range(400)], "src long, frame_idx long, is_speech boolean")
    final, stages = iv.segment_source(frames, 60_000, hop=60, rate=1)
    assert all("Window" not in stages[s]._jdf.queryExecution().optimizedPlan().toString() for s in ("raw", "merged", "packed", "final"))
    assert stages["raw"].count() == 8 and final.count() > 8


def test_paths_go_over_texts_once(monkeypatch):
    """columns that fit in memory are found once, and equal ends not at all."""
    steps = []
    plain = align.Table.steps
    monkeypatch.setattr(align.Table, "steps", lambda self, at, words: steps.append(len(words)) or plain(self, at, words))
    a = [f"w{i}" for i in range(600)]
    b = [*a[:299], "x", *a[300:400], "y", *a[400:]]
    assert align.breakdown(a, b) == (1, 1, 0) and sum(steps) == 401
    monkeypatch.setattr(align, "KEPT_BITS", 0)
    assert align.breakdown(a, b) == (1, 1, 0)
