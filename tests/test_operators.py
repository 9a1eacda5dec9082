import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from voxloom.functions import align, names
from voxloom.functions import text as tx
from voxloom.operators import accounting as ac
from voxloom.operators import compose as co
from voxloom.operators import cuts as cu
from voxloom.operators import intervals as iv
from voxloom.operators import relational as re_
from voxloom.operators import scoring as sc
from voxloom.operators import vocab as vo
from voxloom.operators import voting as vt


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def plain_distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def test_vote_reasons(spark):
    pairs = [("Xin chào.", "xin chào"), ("a b", "a c"), ("", "x"), ("", " "), ("x", "y"), ("một", "hai"), ("x", "")]
    df = spark.createDataFrame([(f"{i}.wav", a, b) for i, (a, b) in enumerate(pairs)], "denoised_path string, zipformer_text string, gipformer_text string")
    found = {r["denoised_path"]: r for r in vt.vote_exact(df).collect()}
    assert [found[f"{i}.wav"]["decision_reason"] for i in range(7)] == ["exact", "mismatch", "zip_empty", "both_empty", "mismatch", "mismatch", "gip_empty"]
    assert found["0.wav"]["final_text"] == "xin chào" and found["1.wav"]["final_wav"] == ""


def test_text_functions(spark):
    df = spark.createDataFrame([("Hai MƯƠI 3,5 quả, và ½ kg",)], "t string")
    one = df.select(
        tx.normalize_words("t").alias("n"), tx.collapse_numbers(tx.canonical_tokens("t")).alias("c"), tx.drop_numbers(tx.canonical_tokens("t")).alias("d"), tx.number_words("t").alias("w"), tx.punct_count("t").alias("p")
    ).first()
    assert one["n"] == "hai mươi 3 5 quả và ½ kg"
    assert one["c"] == ["<num>", "quả", "và", "½", "kg"] and one["d"] == ["quả", "và", "½", "kg"] and one["w"] and one["p"] == 2
    df = spark.createDataFrame([("anh nam nói. nam đi về! và lan đi, lan ở", "<think>x</think>```\nNormalized: \"ok\"", "fall")], "t string, m string, f string")
    one = df.select(tx.finalize_text("t").alias("t"), tx.clean_model_output("m", "f").alias("m"), tx.clean_model_output(F.lit("<think>only"), "f").alias("e")).first()
    assert one["t"] == "Anh Nam nói. Nam đi về! Và Lan đi, Lan ở" and one["m"] == "ok" and one["e"] == "fall"
    df = spark.createDataFrame([("[\"a\",\"b\"]", "nan", "YES"), ("oops", "2.5", None)], "j string, x string, b string")
    found = df.select(tx.parse_json_list("j").alias("j"), tx.safe_time("x", 7.0).alias("x"), tx.as_bool("b").alias("b")).collect()
    assert [tuple(r) for r in found] == [(["a", "b"], 7.0, True), ([], 2.5, False)]


def test_names(spark):
    df = spark.createDataFrame([("x_12.50_15.75.wav", "vietspeech", "d__s__VI_07_9", "/a/b.wav"), ("y.wav", "vivos", "d__VIVOSSPK01_R002", "/z/VI_3_x.wav")], "n string, d string, u string, p string")
    found = df.select(names.parse_seg_times("n").alias("t"), names.speaker_of("d", "u", "p").alias("s"), names.normalize_split(F.lit(" Dev ")).alias("v"), names.split_from_filename("n").alias("f")).collect()
    assert tuple(found[0]["t"]) == (12.5, 15.75) and tuple(found[1]["t"]) == (None, None)
    assert [r["s"] for r in found] == ["VI_07", "VIVOSSPK01"] and found[0]["v"] == "val" and found[0]["f"] == "unknown"
    assert df.select(names.parse_dataset_name(F.lit("train_rng5")).alias("x")).first()["x"] == ("train", 5)
    with pytest.raises(Exception):
        df.select(names.parse_dataset_name(F.lit("test_rng5"))).collect()


def test_distances_against_plain_code(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 7))], [rng.choice("abc") for _ in range(rng.randint(0, 7))]) for _ in range(120)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    found = df.select("i", align.edit_distance("a", "b").alias("d"), align.native_edit_distance(F.col("a"), F.col("b")).alias("n"), align.error_breakdown("a", "b").alias("e")).collect()
    for r in found:
        a, b = pairs[r["i"]]
        want = plain_distance(a, b)
        assert r["d"] == r["n"] == want == sum(tuple(r["e"])[:3])
        assert r["e"]["ref_words"] == len(a) and len(a) - r["e"]["dels"] + r["e"]["ins"] == len(b)
    ops = df.select("i", align.word_opcodes("a", "b").alias("o"), align.word_diff("a", "b").alias("d")).collect()
    for r in ops:
        a, b = pairs[r["i"]]
        at = (0, 0)
        for tag, a1, a2, b1, b2 in r["o"]:
            assert (a1, b1) == at and (tag == "equal") == (a[a1:a2] == b[b1:b2] and a2 > a1) and (a2 > a1 or b2 > b1)
            assert tag == "equal" or tag == ("replace" if a2 > a1 and b2 > b1 else "delete" if a2 > a1 else "insert")
            at = (a2, b2)
        assert at == (len(a), len(b))
        same = sum(o["a2"] - o["a1"] for o in r["o"] if o["tag"] == "equal")
        assert r["d"]["ratio"] == pytest.approx(2 * same / (len(a) + len(b)) if a or b else 1.0) and len(r["d"]["ops"]) == sum(o["tag"] != "equal" for o in r["o"])


def plain_path(a, b):
    """From the end of the full table: the same words, then another word, a word more, a word less."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    i, j, out = len(a), len(b), ""
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j, out = i - 1, j - 1, "=" + out
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            i, j, out = i - 1, j - 1, "s" + out
        elif j and d[i][j] == d[i][j - 1] + 1:
            j, out = j - 1, "i" + out
        else:
            i, out = i - 1, "d" + out
    return out


@pytest.mark.parametrize("kept", [2, 3, 256])
def test_alignment_path(kept, monkeypatch):
    monkeypatch.setattr(align, "KEPT", kept)
    rng = random.Random(kept)
    for _ in range(600):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 11))] for _ in "ab")
        assert align.path(a, b) == plain_path(a, b) and align.distance(a, b) == plain_distance(a, b)
    a = [str(rng.randrange(50)) for _ in range(700)]
    b = [x if rng.random() < 0.9 else "new" for x in a if rng.random() < 0.95]
    assert align.path(a, b) == plain_path(a, b)


def test_best_order_of_speakers():
    rng = random.Random(8)
    for _ in range(150):
        ref, hyp = ([[rng.choice("ab") for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(1, 4))] for _ in "rh")
        n = max(len(ref), len(hyp))
        padded, words = hyp + [[]] * (n - len(hyp)), [w for r in ref for w in r]
        cost = {p: plain_distance(words, [w for i in p for w in padded[i]]) for p in itertools.permutations(range(n))}
        errors, size, *counts, order = align.best_order(ref, hyp)
        assert errors == sum(counts) == min(cost.values()) == cost[tuple(order)] and size == len(words)
    many = [[f"{i}{j}" for j in range(6)] for i in range(9)]
    assert align.best_order(many, many[::-1])[0] == 0


def test_error_rates(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), ([], ["x"]), (["a", "b"], ["a"])], "ref array<string>, hyp array<string>")
    assert tuple(sc.wer(df).first()) == (3, 3, 4, 75.0)
    df = spark.createDataFrame([(1, [["a", "b"], ["c"]], [["c"], ["a", "x"]])], "id int, ref_per_speaker array<array<string>>, hyp_per_speaker array<array<string>>")
    one = sc.cpwer(df).first()
    assert (one["errors"], one["ref_words"], one["best_perm"]) == (1, 3, [1, 0])


def test_timed_words_and_runs(spark):
    words = vt.timed_words(["▁xin", "▁ch", "ào", "<blk>", "▁bạn"], [0.0, 0.5, 0.7, 0.8, 1.0])
    assert [(w.raw, w.start, w.end) for w in words] == [("xin", 0.0, 0.5), ("chào", 0.5, 0.8), ("bạn", 1.0, 1.05)]
    assert [(w.raw, w.end) for w in vt.timed_words(["a", "b"], [0.0, 1.0])] == [("a", 1.0), ("b", 1.05)]
    df = spark.createDataFrame([(1, ["▁xin", "▁ch", "ào", "<blk>", "▁bạn"], [0.0, 0.5, 0.7, 0.8, 1.0], "Xin khác, bạn"), (2, ["▁a"], [0.0], " "), (3, None, None, "x")], "i int, tokens array<string>, timestamps array<double>, other_text string")
    found = {r["i"]: r for r in vt.consensus_runs(df, 0.1).collect()}
    assert [(r["text"], r["start_time"], round(r["end_time"], 3), r["start_word_idx"], r["end_word_idx"]) for r in found[1]["runs"]] == [("xin", 0.0, 0.6, 0, 0), ("bạn", 1.0, 1.15, 2, 2)]
    assert (found[1]["matched"], found[1]["mismatched"]) == (2, 1) and not found[2]["runs"] and not found[3]["runs"] and not found[3]["mismatched"]
    trimmed = {r["i"]: r for r in vt.consensus_runs(df, 0.1, 0.2, 0.1).collect()}[1]["runs"]
    assert [(round(r["start_time"], 3), round(r["end_time"], 3)) for r in trimmed] == [(0.2, 0.5), (1.0, 1.15)]
    df = spark.createDataFrame([("k", "a.wav", 2.0, False)], "k string, denoised_path string, duration_sec double, accepted boolean")
    cached = spark.createDataFrame([("k", ["▁xin", "▁bạn"], [0.0, 1.0], "xin bạn")], "k string, tokens array<string>, timestamps array<double>, other_text string")
    accepted, run_rows, debug = vt.salvage(df, cached, "k")
    assert accepted.first()["final_text"] == "xin bạn" and run_rows.count() == 1 and debug.first()["matched"] == 2


def merged(regions, gap):
    out = []
    for s, e in sorted(regions):
        if out and s - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def packed(regions, least, gap):
    out, i, regions = [], 0, sorted(regions)
    while i < len(regions):
        s, e = regions[i]
        while e - s < least and i + 1 < len(regions) and regions[i + 1][0] - e <= gap:
            i += 1
            e = regions[i][1]
        out.append((s, e))
        i += 1
    return out


def test_intervals_against_plain_code(spark):
    rng = random.Random(5)
    every = {k: [(float(s), float(s + rng.randint(1, 40) / 10)) for s in rng.sample(range(0, 9000), 80)] for k in ("a", "b")}
    df = spark.createDataFrame([(k, s, e) for k, r in every.items() for s, e in r], "src string, start_sec double, end_sec double")
    found = iv.merge_nearby(df, 20.0).collect()
    for k, r in every.items():
        assert sorted((x["start_sec"], x["end_sec"]) for x in found if x["src"] == k) == merged(r, 20.0)
    apart = spark.createDataFrame([(k, s, e) for k, r in every.items() for s, e in merged(r, 0.0)], "src string, start_sec double, end_sec double")
    found = iv.pack_short(apart, 30.0, 1.0, 60.0).collect()
    for k, r in every.items():
        assert sorted((x["start_sec"], x["end_sec"]) for x in found if x["src"] == k) == packed(merged(r, 0.0), 30.0, 60.0)
    long = spark.createDataFrame([("a", 0.0, 45.5), ("a", 50.0, 55.0)], "src string, start_sec double, end_sec double")
    assert rows(iv.split_long(long), "start_sec") == [("a", 0.0, 20.0), ("a", 20.0, 40.0), ("a", 40.0, 45.5), ("a", 50.0, 55.0)]
    energy = spark.createDataFrame([("a", i / 10, abs(i / 10 - 19.0)) for i in range(0, 460)], "src string, at_sec double, energy double")
    cut = rows(iv.split_long(long, energy), "start_sec")
    assert cut[0] == ("a", 0.0, 19.0) and cut[-1] == ("a", 50.0, 55.0)


def test_overlap_and_silence(spark):
    df = spark.createDataFrame([("m", "x", 0.0, 10.0), ("m", "y", 5.0, 15.0), ("m", "x", 20.0, 30.0)], "meeting string, speaker string, start_sec double, end_sec double")
    assert rows(iv.overlap_ratios(df, "meeting")) == [("m", 0.2, 0.0, 2)]
    quiet = iv.silence(df.withColumn("total", F.lit(40.0)), "meeting", "total")
    assert rows(quiet, "start_sec") == [("m", 15.0, 20.0, 5.0), ("m", 30.0, 40.0, 10.0)]
    assert [x[-1] for x in rows(iv.segment_lengths(df, "meeting", 1), "start_sec")] == [5.0, 5.0, 10.0]


def test_turn_states(spark):
    turns = [("m", 0, "A", 0, 10), ("m", 1, "B", 12, 20), ("m", 2, "A", 14, 16), ("m", 3, "A", 18, 25), ("m", 4, "A", 26, 30)]
    df = spark.createDataFrame(turns, "meeting string, place int, speaker string, start int, end int")
    states = iv.turn_states(df, "meeting")
    assert [r[3] for r in rows(states, "place")] == ["TS", "BC", "OV", "TH"]
    matrix = {(a, b): p for a, b, p in rows(iv.turn_transitions(states))}
    assert matrix["TH", "TS"] == 1.0 and matrix["BC", "OV"] == 1.0 and len(matrix) == 16


def test_composition_invariants(spark):
    people = [(i, f"s{i % 7}", "d") for i in range(21)]
    df = spark.createDataFrame(people, "utt_id int, speaker_id string, dataset string")
    groups, rest = co.compose_disjoint(df, 3)
    found = groups.collect()
    assert rest.count() == 0 and len(found) == 21 and len({r["utt_id"] for r in found}) == 21
    for g in range(7):
        assert len({r["speaker_id"] for r in found if r["group"] == g}) == 3
    each = co.compose_each(df, 2).collect()
    for slot in (0, 1):
        assert sorted(r["utt_id"] for r in each if r["slot"] == slot) == list(range(21))
    assert not any(r["repeats_speaker"] for r in each)
    short, long = ({(r["group"], r["slot"]): r["utt_id"] for r in co.compose_n(df, 3, n).collect()} for n in (4, 9))
    assert len(long) == 27 and all(long[k] == x for k, x in short.items())
    skewed = spark.createDataFrame([(i, "one" if i < 15 else f"s{i}", "d") for i in range(20)], "utt_id int, speaker_id string, dataset string")
    groups, rest = co.compose_disjoint(skewed, 2)
    found = groups.collect()
    assert all(len({r["speaker_id"] for r in found if r["group"] == g}) == 2 for g in {r["group"] for r in found})
    assert len(found) + rest.count() == 20


def test_pools_and_counts(spark, sf_dir):
    df = spark.createDataFrame([(f"u{i}", "a", "train") for i in range(500)], "utt_id string, audio_path string, split string")
    pools = co.assign_pool(df, 0.5, 0.2, 0.1)
    again = co.assign_pool(df.repartition(7), 0.5, 0.2, 0.1)
    assert pools.exceptAll(again).isEmpty()
    assert rows(co.mix_counts(spark.createDataFrame([(5,)], "total int"), 0.5, 0.3)) == [(5, 2, 2, 1)]
    weights = co.log_weights(spark.createDataFrame([(1, 3)], "example_id int, num_speakers int"), "constant", weights=[1, 2, 3, 4, 5]).first()
    assert weights["log_weights"] == [-1.0, 0.0, 1.0]


def test_accounting(spark):
    df = spark.createDataFrame([("d", "train", "u1", "a.wav", "3600"), ("d", "train", "u1", "b.wav", "3600"), ("d", "val", "", "c.wav", "x")], "dataset string, split string, utt_id string, audio_path string, duration_sec string")
    total = [r for r in ac.hours(df).collect() if r["level"] == 3][0]
    assert (total["rows"], total["unique_rows"], total["duplicates"], total["bad"], total["hours"]) == (3, 2, 1, 1, 1.0)
    h = ac.histogram(spark.createDataFrame([(-30,), (30,), (130,), (170,)], "x int"), "x", 100, negative=True)
    assert rows(h.select("bin", "prob"), "bin") == [(-50.0, 0.25), (50.0, 0.25), (150.0, 0.5)]
    with pytest.raises(Exception):
        ac.histogram(spark.createDataFrame([(-30,)], "x int"), "x", 100).collect()


def test_slots_and_cuts(spark):
    sups = spark.createDataFrame([("c", 0, "B", 0.3, 0.9, "second"), ("c", 1, "A", 0.1, 0.5, "first")], "cut string, place int, speaker string, start double, end double, text string")
    slots = cu.arrival_slots(sups, 3)
    assert {r["speaker"]: r["slot"] for r in slots.collect()} == {"A": 0, "B": 1}
    assert rows(cu.slot_texts(sups, slots), "slot") == [("c", 0, "first"), ("c", 1, "second")]
    assert rows(cu.slot_frames(sups, slots, 60), "slot") == [("c", 0, 10, 50), ("c", 1, 30, 60)]
    picked = {cu.target_slot(slots, e).first()["target_slot"] for e in (0, 1)}
    assert picked == {0, 1}
    wide = spark.createDataFrame([("u", "a.wav", "x y", "s", 16000, 8000)], "utt_id string, audio_path string, text string, speaker_id string, sample_rate int, num_samples long")
    cut = cu.build_cuts(wide).withColumn("tracks", F.lit(None).cast("array<struct<cut:struct<supervisions:array<struct<id:string,text:string>>>>>"))
    up = cu.upper_supervisions(cut).first()
    assert up["supervisions"][0]["text"] == "X Y" and up["changed"] and up["duration"] == 0.5
    assert cu.prefix_ids(cut, "p-").first()["supervisions"][0]["recording_id"] == "p-u"


def test_vocabulary(spark):
    vocab = spark.createDataFrame([("<blk>", 0), ("<unk>", 1), ("▁", 2), ("▁XIN", 3), ("▁CH", 4), ("À", 5), ("O", 6)], "token string, id int")
    df = spark.createDataFrame([(1, "xin chào z"), (2, "")], "id int, text string")
    found = {r["id"]: r for r in vo.encode_tokens(df, vocab).collect()}
    assert found[1]["tokens"] == ["▁XIN", "▁CH", "À", "O", "▁", "<unk>"] and found[2]["ids"] == []
    total = [r for r in vo.vocab_coverage(df.withColumn("file", F.lit("f")), vocab).collect() if r["file"] is None][0]
    assert (total["supervisions"], total["blank"], total["tokens"], total["unknown"], total["covered"]) == (2, 1, 6, 1, 0)
    assert spark.createDataFrame([([3, 4, 5, 6],)], "i array<int>").select(tx.decode_tokens("i", {3: "▁XIN", 4: "▁CH", 5: "À", 6: "O"})).first()[0] == "XIN CHÀO"
    model = vo.ngram_model(spark.createDataFrame([(["a", "b"],), (["a", "c"],)], "tokens array<string>"), 2)
    score = vo.ngram_score(spark.createDataFrame([(1, ["a", "b"])], "id int, tokens array<string>"), model, 2).first()
    import math

    assert abs(score["score"] - (math.log(1) + math.log(0.5) + math.log(1))) < 1e-6


def test_relational(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, x string, o int")
    assert rows(re_.dedupe(df, ["k"], ["o"], "last"), "k") == [(1, "b", 2), (2, "c", 1)]
    assert rows(re_.dedupe(df, ["k"], ["o"], "first"), "k") == [(1, "a", 1), (2, "c", 1)]
    files = spark.createDataFrame([("/a.wav",), ("/a_16k.wav",), ("/b.wav",)], "path string")
    assert rows(re_.prefer_variant(files), "path") == [("/a_16k.wav",), ("/b.wav",)]
    numbered = re_.global_number(spark.range(100).repartition(5), ["id"])
    assert rows(numbered.filter("number <> id + 1")) == []
    assert {r["chunk"] for r in re_.chunk_rows(spark.range(10), 3, ["id"]).collect()} == {0, 1, 2}
    good, bad = re_.row_guard(spark.createDataFrame([("u", 1.0), ("", 1.0), ("v", -1.0)], "utt_id string, sec double"), ["utt_id"], ["sec"])
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["invalid sec", "missing utt_id"]


def test_select_candidate(spark):
    df = spark.createDataFrame([("hai mươi quả", "hai mươi quả", None, "20 quả", None), ("xin chào bạn", "xin chào", "Xin chào bạn", None, "Xin chào, bạn.")], "raw string, main string, strict string, number string, punctuated string")
    assert [(r["kind"], r["chosen"]) for r in re_.select_candidate(df).collect()] == [("number", "20 quả"), ("strict+punct", "Xin chào, bạn.")]


def test_batches_keep_the_limit(spark):
    rng = random.Random(3)
    rows_ = [(f"u{i}", float(rng.choice((2, 30, 250, 400))), "x") for i in range(1500)] + [("long", 900.0, "x")]
    df = spark.createDataFrame(rows_, "id string, duration_sec double, text string")
    found = co.plan_batches(df, 600.0, 3).collect()
    assert sorted(r["id"] for r in found) == sorted(r[0] for r in rows_)
    sums = {}
    for r in found:
        sums.setdefault(r["batch"], []).append(r["duration_sec"])
    assert all(sum(x) <= 600 or len(x) == 1 for x in sums.values())
    whole = co.plan_batches(df, 600.0, 3, drop_last=True).collect()
    assert len(whole) < len(found) and {r["batch"] for r in whole} < set(sums)


def test_pronounced_punctuation_and_ids(spark):
    df = spark.createDataFrame([(1, "HELLO ,COMMA THERE"), (2, "HELLO, THERE"), (3, None), (4, "(PAREN X")], "i int, text string")
    assert sorted(r["i"] for r in re_.drop_pronounced_punct(df).collect()) == [2, 3]
    one = spark.createDataFrame([("d", "train", "S1", 7), ("d", "train", "", 7), ("d", "train", None, 12)], "d string, s string, sid string, r int")
    assert [r[0] for r in one.select(names.sid_utt_id("d", "s", "sid", "r")).collect()] == ["d__train__S1", "d__train__r00000007", "d__train__r00000012"]


def test_manifests_from_lines_and_accepted_rows(spark):
    lines = spark.createDataFrame([("f.tsv", 0, "a-b-c", " x "), ("f.tsv", 1, "", "y"), ("f.tsv", 2, "d-e-f", "z"), ("f.tsv", 3, "g", None)], "file string, line int, utt_id string, text string")
    listing = spark.createDataFrame([("/r/train/a/b/a-b-c.wav",)], "path string")
    good, bad = re_.build_manifest(lines, "ds", "train", "/r", listing)
    assert [(r["utt_id"], r["audio_path"], r["text"], r["recording_id"], r["source_row"]) for r in good.collect()] == [("ds__train__a-b-c", "/r/train/a/b/a-b-c.wav", "x", "ds::a-b-c", 0)]
    assert sorted((r["source_row"], r["reason"]) for r in bad.collect()) == [(1, "missing utt_id"), (2, "missing audio"), (3, "missing text")]
    accepted = spark.createDataFrame([("/a/b.wav", " hi "), ("", "x"), ("/c.wav", None)], "final_wav string, final_text string")
    found = re_.manifest_from_accepted(accepted, "yt", "train").collect()
    assert [(r["utt_id"], r["text"]) for r in found] == [("yt__train__b__" + hashlib.md5(b"/a/b.wav").hexdigest()[:8], "hi")]


def test_spans_of_time_change_nothing(spark, monkeypatch):
    rng = random.Random(11)
    frames = spark.createDataFrame([("a", i, rng.random() < 0.3) for i in range(2000)], "src string, frame_idx long, is_speech boolean")
    whole = sorted(rows(iv.frames_to_regions(frames, 48.0)))
    turns = spark.createDataFrame([("m", "x", s, s + rng.randint(1, 300)) for s in (rng.randint(0, 9000) for _ in range(300))], "meeting string, speaker string, start_sec int, end_sec int")
    swept = sorted(rows(iv.sweep(turns, "meeting")))
    monkeypatch.setattr(iv, "FRAME_SPAN", 37)
    monkeypatch.setattr(iv, "SPAN", 101.0)
    assert sorted(rows(iv.frames_to_regions(frames, 48.0))) == whole
    assert sorted(rows(iv.sweep(turns, "meeting"))) == swept
    long = spark.createDataFrame([("a", 10.0, 260.0)], "src string, start_sec double, end_sec double")
    energy = spark.createDataFrame([("a", i / 2, float((i * 7) % 11)) for i in range(0, 600)], "src string, at_sec double, energy double")
    cuts = rows(iv.split_long(long, energy), "start_sec")
    assert cuts[0][1] == 10.0 and cuts[-1][2] == 260.0 and all(1.0 <= e - s <= 20.0 for _, s, e in cuts) and all(x[2] == y[1] for x, y in zip(cuts, cuts[1:]))


def test_turn_states_over_many_batches(spark):
    rng = random.Random(5)
    turns = []
    for m in range(40):
        at = 0
        for place in range(60):
            at += rng.randint(-3, 4)
            turns.append((m, place, rng.choice("AB"), max(0, at), max(0, at) + rng.randint(1, 9)))
    df = spark.createDataFrame(turns, "meeting int, place int, speaker string, start int, end int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = {(r["meeting"], r["place"]): r for r in iv.turn_states(df, "meeting").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 40 * 59
    for m in range(40):
        own = sorted(t for t in turns if t[0] == m)
        speaker, end, last = own[0][2], own[0][4], "TH"
        for _, place, who, start, stop in own[1:]:
            want = "TH" if who == speaker else "TS" if start > end else "OV" if stop > end else "BC"
            r = found[m, place]
            assert (r["from_state"], r["to_state"]) == (last, want) and r["silence"] == (start - end if want in ("TH", "TS") else None)
            speaker, end, last = (speaker, end, want) if want == "BC" else (who, stop, want)
