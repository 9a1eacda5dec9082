"""Order MinHash at its threshold, in large buckets at default limits, and the growth of what it moves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import _words as words
from voxloom.llm import order_minhash as om

SCHEMA = "doc_id bigint, text string"


def spread_edits(rng, text, share):
    out = []
    for w in text:
        kind = rng.choice("sid") if rng.random() < share else "="
        out += {"=": [w], "s": [f"n{rng.randrange(5000)}"], "i": [w, f"n{rng.randrange(5000)}"], "d": []}[kind]
    return out


def hashed(text):
    return words.hashes([w.encode() for w in text])


def linked(a, b, similarity=0.8):
    return words.edit_distance(a, b, om.most_edits(len(a), len(b), similarity)) is not None


def linkable_pairs(rng, size, share, n):
    while n:
        a = [f"w{rng.randrange(5000)}" for _ in range(size)]
        b = spread_edits(rng, a, share)
        if linked(hashed(a), hashed(b)):
            n -= 1
            yield a, b


@pytest.mark.parametrize("size", [60, 150, 600])
@pytest.mark.parametrize("share", [0.10, 0.14, 0.17, 0.19])
def test_recall_of_spread_edits(size, share):
    rng = random.Random(size)
    found = [bool((om.sketch(hashed(a)) == om.sketch(hashed(b))).any()) for a, b in linkable_pairs(rng, size, share, 200)]
    assert sum(found) >= 0.9 * len(found)


def test_pairs_at_the_threshold_end_in_one_class(spark):
    rng = random.Random(8)
    pairs = [p for size in (60, 150, 600) for p in linkable_pairs(rng, size, 0.18, 40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, p in enumerate(pairs) for i, t in ((2 * i, p[0]), (2 * i + 1, p[1]))], SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(docs).collect()}
    same = sum(got[2 * i] == got[2 * i + 1] for i in range(len(pairs)))
    assert same >= 0.9 * len(pairs) and len(set(got.values())) == 2 * len(pairs) - same


def classes_by_all_pairs(texts):
    """The least index of each text's class: all pairs that share a key are aligned."""
    all_hashed = [hashed(t) for t in texts]
    keys, root = np.array([om.sketch(h) for h in all_hashed]), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    compared = 0
    for i in range(len(texts)):
        for j in (i + 1 + np.flatnonzero((keys[i + 1 :] == keys[i]).any(1))).tolist():
            compared += 1
            if find(i) != find(j) and linked(all_hashed[i], all_hashed[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], compared


def test_bucket_of_2000_texts_at_default_limits(spark):
    """Texts around one passage: alone, in families, and in chains whose ends are not alike."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    while len(texts) < 2000:
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 90))]
        kind = rng.random()
        if kind < 0.6:
            texts.append(own + passage)
        elif kind < 0.8:
            texts += [spread_edits(rng, own + passage, rng.choice([0.05, 0.12])) for _ in range(rng.randrange(2, 8))]
        else:
            chain = own + passage
            for _ in range(6):
                texts.append(chain)
                chain = spread_edits(rng, chain, 0.1)
    texts = texts[:2000]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(docs).collect()}
    want, compared = classes_by_all_pairs(texts)
    assert [got[i] for i in range(len(texts))] == want and compared > 500_000 and 300 < len(set(want)) < 1900


def large_of(spark, n):
    """A bucket of `n` nodes that no link joins."""
    return spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("nid"), F.col("id").alias("root"), (F.lit(100) + F.col("id") % 7).cast("int").alias("words"), F.lit(n).cast("long").alias("n"), F.lit(0).cast("long").alias("hub"))


def test_profiles_of_a_family_without_links_move_once(spark):
    rows = {n: om.dealt(large_of(spark, n), om.Scale(n)).count() for n in (1000, 2000, 4000)}
    assert rows == {n: n for n in rows}
    assert 12_000 < om.dealt(large_of(spark, 12_000), om.Scale(12_000)).count() <= 12_000 * -(-12_000 // om.BLOCK)


def test_texts_of_buckets_that_overlap_move_once_a_bucket(spark):
    """A text comes into as many cells as it has buckets, however many other buckets these meet."""
    rng = random.Random(31)
    rows = [(k, i, i, 100 + i % 40, 0, min(i, k)) for i in range(2000) for k in rng.sample(range(200), 6)]
    large = spark.createDataFrame(rows, "key long, nid long, root long, words int, n long, hub long")
    assert om.dealt(large, om.Scale(2000)).count() == len(rows)


def test_bags_bound_distances():
    rng = random.Random(4)
    for _ in range(200):
        a = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 300))]
        b = spread_edits(rng, a, rng.random() * 0.5) or ["x"]
        x, y = hashed(a), hashed(b)
        bags = [om.bag(x), om.bag(y)]
        table = om.folded(bags, min(map(len, bags)))
        assert om.fewest_edits(table[0], table[1:])[0] <= words.edit_distance(x, y, max(len(x), len(y)))
