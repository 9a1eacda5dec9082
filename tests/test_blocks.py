"""Longest common blocks, orders of many speakers, the prefix tree, and views of very long texts, against plain code."""

import itertools
import random

import pytest

from voxloom.functions import align
from voxloom.operators import vocab as vo
from voxloom.plans import catalog, views


def plain_blocks(a, b, a1=0, b1=0):
    """The longest block, the first in `a`, then in `b`; then what is before and behind it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    i, j, n = best
    if not n:
        return []
    return plain_blocks(a[:i], b[:j], a1, b1) + [(a1 + i, b1 + j, n)] + plain_blocks(a[i + n :], b[j + n :], a1 + i + n, b1 + j + n)


def touching(blocks):
    out = []
    for i, j, n in blocks:
        if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (i, j):
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


@pytest.mark.parametrize("few", [0, 60, 1 << 18])
@pytest.mark.parametrize("letters", [1, 2, 4, 25])
def test_blocks_against_plain_search(letters, few, monkeypatch):
    monkeypatch.setattr(align, "FEW", few)
    rng = random.Random(letters)
    for _ in range(60):
        a, b = ([str(rng.randrange(letters)) for _ in range(rng.randrange(0, 40))] for _ in "ab")
        if rng.random() < 0.5:
            b = [w for w in a if rng.random() < 0.9] + b[:3]
        assert align.common_blocks(a, b) == touching(plain_blocks(a, b))


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_blocks_of_200_words(few, monkeypatch):
    monkeypatch.setattr(align, "FEW", few)
    rng = random.Random(9)
    for _ in range(6):
        a = [str(int(rng.paretovariate(0.6))) for _ in range(200)]
        b = [w if rng.random() < 0.85 else "new" for w in a if rng.random() < 0.95]
        assert align.common_blocks(a, b) == touching(plain_blocks(a, b))
        ops = align.opcodes(a, b)
        assert [w for tag, _, _, x, y in ops for w in b[x:y]] == b and all(a[i:j] == b[x:y] for tag, i, j, x, y in ops if tag == "equal")


def test_blocks_of_20000_words():
    rng = random.Random(4)
    a = [f"w{i}" for i in range(20_000)]
    b = [w if i % 7 else "new" for i, w in enumerate(a) if i % 11]
    kept = [w for i, w in enumerate(a) if i % 7 and i % 11]
    found = align.common_blocks(a, b)
    assert [w for i, _, n in found for w in a[i : i + n]] == kept
    same = ["a"] * 20_000
    assert align.common_blocks(same, same[:-3]) == [(0, 0, 19_997)]
    assert align.common_blocks([f"{w}{i}" if i % 2 else w for i, w in enumerate(same)], same)[0] == (0, 0, 1)
    assert len(align.common_blocks(rng.choices("abcdef", k=20_000), rng.choices("abcdef", k=20_000))) > 50


def test_orders_against_all_permutations():
    rng = random.Random(1)
    for n in (0, 1, 3, 5, 6):
        ref, hyp = ([rng.choices("abcde", k=rng.randrange(0, 5)) for _ in range(n)] for _ in "rh")
        if n > 2:
            hyp[2] = list(hyp[0])
        words = [w for r in ref for w in r]
        cost = {p: align.distance(words, [w for q in p for w in hyp[q]]) for p in itertools.permutations(range(n))}
        first = min(cost, key=lambda p: (cost[p], p))
        found = align.best_order(ref, hyp)
        assert found[0] == cost[first] and tuple(found[5]) == first
    assert align.best_order([["a"], ["b"]], [["b"]])[5] == [0, 1] and align.best_order([["a"]], [["b"], ["a"], []])[0] == 1


def test_ten_speakers_without_a_common_word_order():
    rng = random.Random(3)
    ref, hyp = ([[f"w{int(rng.paretovariate(0.8))}" for _ in range(40)] for _ in range(10)] for _ in "rh")
    errors, size, *counts, order = align.best_order(ref, hyp)
    words = [w for r in ref for w in r]
    assert errors == align.distance(words, [w for p in order for w in hyp[p]]) and sorted(order) == list(range(10))
    for _ in range(300):
        other = rng.sample(range(10), 10)
        assert align.distance(words, [w for p in other for w in hyp[p]]) >= errors


def test_many_alike_speakers_and_many_silent_ones():
    rng = random.Random(6)
    ref = [[f"w{int(rng.paretovariate(0.8))}" for _ in range(120)] for _ in range(16)]
    order = rng.sample(range(16), 16)
    hyp = [[w for w in ref[i] if rng.random() < 0.8] for i in order]
    assert align.best_order(ref, hyp)[5] == [order.index(i) for i in range(16)]
    assert align.best_order(ref, hyp[:2])[0] == sum(map(len, ref)) - sum(map(len, hyp[:2]))


def plain_pieces(word, tokens):
    text, out, at = "▁" + word, [], 0
    while at < len(text):
        piece = next((text[at:e] for e in range(len(text), at, -1) if text[at:e] in tokens), None)
        out.append(piece or "<unk>")
        at += len(piece or "x")
    return out


def test_prefix_tree_against_plain_search():
    rng = random.Random(2)
    for _ in range(80):
        tokens = {"".join(rng.choices("▁AB", k=rng.randrange(1, 6))): i for i in range(rng.randrange(0, 25))} | {"<unk>": 99}
        trie = vo.Trie(tokens)
        for _ in range(20):
            word = "".join(rng.choices("ABC▁", k=rng.randrange(0, 12)))
            found = trie.pieces(word)
            assert [trie.names[p] for p in found] == plain_pieces(word, tokens)
            assert [trie.ids[p] for p in found] == [tokens[trie.names[p]] for p in found]
    assert len(vo.Trie({"▁": 0}).pieces("x" * 100_000)) == 100_001


def test_encoded_rows_carry_clashing_names(spark):
    vocab = spark.createDataFrame([("▁A", 7)], "token string, id int")
    rows = vo.encode_tokens(spark.createDataFrame([("a b", "mine"), (None, "x")], "text string, _upper string"), vocab).collect()
    assert [(r["_upper"], r["tokens"], r["ids"]) for r in rows] == [("mine", ["▁A", "<unk>", "<unk>"], [7, 2, 2]), ("x", [], [])]


@pytest.mark.parametrize("numbered", [False, True])
def test_view_of_very_long_texts(spark, tmp_path, numbered):
    rows = [(i, " ".join(f"w{k % 97}" for k in range(20_000)), "s", 100_000) for i in range(4)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    for r in views.hyp(spark, str(tmp_path), numbered).collect():
        edits = [i for i in range(20_000) if r["doc_id"] % 4 != 3 and (r["doc_id"] * 7919 + i * i * 31 + i * 17) % 97 < 10]
        assert len(r["a"]) == 20_000 and (len(edits) > 500) == (r["doc_id"] != 3)
        changed = sum(r["doc_id"] == 0 or i % 3 == 1 for i in edits)
        want = {0: (changed, 0, 0), 1: (changed, len(edits) - changed, 0), 2: (changed, 0, len(edits) - changed), 3: (0, 0, 0)}[r["doc_id"]]
        assert align.breakdown(r["a"], r["b"]) == want
    assert catalog.hours_and_acceptance(spark, str(tmp_path)).count() > 0
