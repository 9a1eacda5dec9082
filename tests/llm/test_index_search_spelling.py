"""The digest index, lexical search and spelling variants against plain code and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxloom.llm import exact_dedup, lexical_search, oracles, queries, spelling

TEXTS = "doc_id bigint, text string"
ODD = [(1, None), (2, ""), (3, " "), (None, "x"), (None, "x"), (4, "x"), (4, "x"), (5, "\n\t "), (6, "a b"), (7, "a b"), (8, "a \x0b b"), (9, "word " * 100_000)]


def index_of(spark, tmp_path, **options):
    return exact_dedup.open_index(spark, str(tmp_path / "index"), **options)


def decided(spark, index, rows):
    return [tuple(r) for r in exact_dedup.decisions(index, rows).select("id", "keep_id", "group_size", "kept", "text_sha256").collect()]


def plain_dedup(rows):
    """Rows (id, text) to their decisions: ids before null ids, one row kept of each text."""
    groups = {}
    for place, (key, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((key is None, key or 0, place, key))
    out = []
    for text, own in groups.items():
        first = min(own)
        out += [(k, first[3], len(own), (no, n, p, k) == first, hashlib.sha256(text.encode()).hexdigest()) for no, n, p, k in own]
    return out


def test_decisions_of_odd_rows(spark, tmp_path):
    index = index_of(spark, tmp_path, buckets=3)
    rows = exact_dedup.digests(spark.createDataFrame(ODD, TEXTS), "one")
    exact_dedup.add(index, rows)
    assert Counter(decided(spark, index, rows)) == Counter(plain_dedup(ODD))


def test_deliveries_in_order_keep_the_least_id(spark, tmp_path):
    made = random.Random(4)
    rows = [(i, made.choice("abcdefgh") * made.choice([1, 1, 2]) if i % 3 else "copied") for i in range(300)]
    index = index_of(spark, tmp_path, buckets=4)
    docs = spark.createDataFrame(rows, TEXTS).withColumn("part", (F.col("doc_id") / 100).cast("int").cast("string"))
    every = exact_dedup.digests(docs, F.col("part"))
    for part in "012":
        exact_dedup.add(index, every.filter(F.col("delivery") == part))
        exact_dedup.add(index, every.filter(F.col("delivery") == part))
    assert Counter(decided(spark, index, every)) == Counter(plain_dedup(rows))
    assert index.table(spark).count() == len({t for _, t in rows})


def test_index_outlives_its_session_and_is_not_shuffled(spark, tmp_path):
    first = index_of(spark, tmp_path, buckets=5)
    assert exact_dedup.drop_copies(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], TEXTS), first, "monday").count() == 2
    again = index_of(spark, tmp_path)
    assert again.buckets == 5 and again.name != first.name
    docs = spark.createDataFrame([(9, "a ", "x"), (8, "c", "y"), (8, "c", "y"), (7, "b", "z")], TEXTS + ", digest string")
    assert [tuple(r) for r in exact_dedup.drop_copies(docs, again, "tuesday").orderBy("doc_id").collect()] == [(8, "c", "y"), (9, "a ", "x")]
    assert again.table(spark).count() == 4
    new = exact_dedup.digests(docs, "new").groupBy("digest").count()
    plan = new.join(again.table(spark).hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_empty_deliveries(spark, tmp_path):
    index = index_of(spark, tmp_path, buckets=2)
    rows = exact_dedup.digests(spark.createDataFrame([], TEXTS), "none")
    exact_dedup.add(index, rows)
    assert index.table(spark).count() == 0 and exact_dedup.decisions(index, rows).count() == 0


def plain_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    many, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * many) // length
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -score) for rank, (score, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def searched(docs, items, **options):
    return [tuple(r) for r in lexical_search.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()]


@pytest.mark.parametrize("seed_rows", [50, 20_000])
def test_search_against_plain_code(spark, monkeypatch, seed_rows):
    monkeypatch.setattr(lexical_search, "SEED_ROWS", seed_rows)
    made = random.Random(seed_rows)
    words = [f"w{int(made.paretovariate(0.7))}" for _ in range(600)] + ["Straße", "日本", "Ab-c", "x\x00y"]
    docs = [(i, " ".join(made.choices(words, k=made.choice([0, 3, 30, 120])))) for i in range(400)]
    docs += [(1000 + i, "w1 w2 w3 copied text") for i in range(80)] + [(None, "w1 w2 w3"), (7, "w1 w2 w3"), (2000, None), (2001, "..."), (2002, "w3 " * 50_000)]
    items = [(i, " ".join(made.choices(words, k=12))) for i in range(23)] + [(90, "w1 w2 w3"), (91, None), (92, "nowhere"), (93, "W1! w1"), (94, "copied text"), (None, "w2 w5")]
    found = searched(spark.createDataFrame(docs, TEXTS).repartition(3), spark.createDataFrame(items, "item_id int, text string"), k=9, shape=lexical_search.Shape(2, 4, 2, 37, 300))
    assert Counter(found) == Counter(plain_search(docs, items, 9))


def test_search_of_repeated_items_parts_and_odd_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], TEXTS).withColumns({"n": F.lit(1), "score": F.lit("x"), "id": F.lit(2.0), "terms": F.lit(0)})
    items = spark.createDataFrame([(1, "b"), (1, "b"), (2, "a zz"), (3, "c")], "item_id bigint, text string").withColumn("rank", F.lit("r"))
    every = searched(docs, items)
    assert Counter((r[0], r[1], r[2]) for r in every) == Counter([(1, 1, 1), (1, 2, 2), (1, 1, 1), (1, 2, 2), (2, 1, 1), (3, 1, 2)])
    monkeypatch.setattr(lexical_search, "PART_CHARS", 30)
    assert Counter(searched(docs, items)) == Counter(every)
    assert searched(docs.limit(0), items) == searched(docs, items.limit(0)) == searched(docs.withColumn("text", F.lit("?")), items) == []
    dated = docs.withColumn("doc_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int")))
    assert [str(r[2]) for r in searched(dated, items.filter("item_id = 1").limit(1))] == ["2024-01-02", "2024-01-03"]


def test_pairs_of_nodes_are_left_out(spark, monkeypatch):
    """Most documents of a topic are never scored for items of another one, and answers are the same."""
    made = random.Random(11)
    docs = [(i, " ".join(f"t{i % 8}x{made.randrange(40)}" for _ in range(25)) + " common") for i in range(2000)]
    items = [(t, " ".join(f"t{t}x{made.randrange(40)}" for _ in range(8)) + " common") for t in range(8)]
    scored = []
    whole = lexical_search.Search.scored
    shape = lexical_search.Shape(item_leaf=1)
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, x in items for t in lexical_search.terms_of(x)}))}
    weights = lexical_search.np.full(len(vocabulary), 1000, lexical_search.np.int64)
    weights[vocabulary[b"common"]] = 1
    lists = [[vocabulary[t] for t in set(lexical_search.terms_of(x))] for _, x in items]
    search = lexical_search.Search(lexical_search.Items.ordered(lexical_search.pa.array([i for i, _ in items]), lists, weights, shape), 5, lexical_search.pa.int64())
    monkeypatch.setattr(lexical_search.Search, "scored", lambda self, leaf, nodes, rows: scored.append(len(nodes)) or whole(self, leaf, nodes, rows))
    best = {}
    for a in range(0, 2000, 500):
        doc, term, value = [], [], []
        for i, (d, text) in enumerate(docs[a : a + 500]):
            for t, n in Counter(t for t in lexical_search.terms_of(text) if t in vocabulary).items():
                doc.append(i), term.append(vocabulary[t]), value.append(1000 * n)
                for item, own in enumerate(lists):
                    if vocabulary[t] in own:
                        best.setdefault(item, Counter())[d] += int(weights[vocabulary[t]]) * 1000 * n
        arrays = [lexical_search.np.array(x, lexical_search.np.int64) for x in (doc, term, value)]
        search.batch(lexical_search.pa.array([d for d, _ in docs[a : a + 500]]), *arrays)
    found = search.best.to_pylist()
    for place, item in enumerate(search.items.ids.to_pylist()):
        own = [(r["id"], r["score"]) for r in found if r["item"] == place]
        assert own == sorted(best[item].items(), key=lambda r: (-r[1], r[0]))[:5]
    assert sum(scored) < 0.4 * len(items) * 2000 / shape.doc_leaf


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, ratio=5):
    forms, rows = {}, {}
    for w, n in words.items():
        others = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        forms[w] = others[0] if others and words[others[0]] >= ratio * n else None
        rows[w] = len(others)
    out = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, rows[w], words[forms[w]] if forms[w] else None))
    return out


@pytest.mark.parametrize("block", [3, 16_384])
def test_variants_against_plain_code(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "DENSE", 3 if block == 3 else 64)
    made = random.Random(block)
    words = {}
    for _ in range(260):
        w = "".join(made.choices("abé", k=made.randrange(1, 9)))
        words[w] = 5 ** made.randrange(0, 6) * made.randrange(1, 4)
    words |= {"long" * 50: 3, "long" * 49 + "lang": 40, "long" * 50 + "s": 900, "ending": 5, "endings": 25, "endingss": 125}
    found = spelling.group_variants(spark.createDataFrame([(w, n, "extra") for w, n in words.items()], "word string, n bigint, form string"))
    assert {tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_variants(words)


def test_very_long_words(spark):
    a, b = "a" * 200_000, "a" * 100_000 + "b" + "a" * 99_999
    found = spelling.group_variants(spark.createDataFrame([(a, 100), (b, 2), (a + "z", 7)], "word string, n bigint"))
    assert {(len(r["word"]), r["n"], r["n_near"], r["form_n"]) for r in found.collect()} == {(200_000, 100, 2, None), (200_000, 2, 1, 100), (200_001, 7, 1, 100)}


def test_counts_against_plain_code(spark):
    made = random.Random(3)
    texts = ["Wörter, und ÄHNLICHE wörter: naïve×÷ ŝed", None, "", "x", "don't ABCDEFG abcdefg", "abcdefg " * 30_000]
    docs = [(i, " ".join(made.choices(["abcdefg", "hijklmnop", "Ünïcode", "short", texts[0]], k=40))) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(texts)] + [(None, "abcdefg nothing"), (5, "abcdefg"), (5, "abcdefg")]
    want = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            want[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    found = spelling.count_words(spark.createDataFrame(docs, TEXTS).withColumns({"word": F.lit(0), "n": F.lit("n"), "id": F.lit(None)}))
    assert {r["word"]: r["n"] for r in found.collect()} == want
    assert spelling.count_words(spark.createDataFrame(docs, TEXTS), slips=None).filter("word = 'abcdefg'").first()["n"] == sum((t or "").lower().split().count("abcdefg") for _, t in docs)
    assert spelling.group_variants(spelling.count_words(spark.createDataFrame([], TEXTS))).count() == 0


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_lexical_search", "op13_exact_dedup"])
def test_new_queries_same_as_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = queries.queries()[name](spark, sf_dir)
    result = con.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(result.fetchall())
