"""Ranked lexical search of all documents for each item of a query set, by two trees at once.

Documents become vectors: for each term of the query set that a document holds, the whole number that
it adds to a score for each unit of the term's weight. Items are vectors of weights. Over both stand
hierarchies: a node holds, term by term, the largest value of its documents, or the terms of its
items. The product of two nodes, then, is at least the score of any item below the one with any document
below the other. From the roots down, a pair of nodes is left where that bound falls short of the weakest
kth score of its items; so whole batches of documents go at once, and no document that belongs to an
answer does. Pairs of leaves are scored exactly.

Spark deals the documents out. Each task takes its vectors in batches of bounded size, orders a batch
by the terms that weigh most so that alike documents share leaves, walks both trees, and keeps the best
of what it has seen for each item: its kth scores rise from batch to batch. To start from good ones, a bounded
sample of the documents is searched first; the kth score of a sample is never above that of all. A task returns k rows an item
at most, and a ranked window with a limit before the shuffle picks the k best of all. All scores are whole numbers, so that
sums in any order are equal.

Items are collected in parts of bounded size (PART_CHARS characters by hash of their text), each of which is one broadcast and
one pass over the texts; a query set of 20 million characters or less is one part.

Null texts have no terms, and rows without terms count for nothing. Repeated documents are ranked each; null ids come after
others where scores are equal. Repeated items get their ranks each. Items without a term in any document have no rows. Very
long texts are read whole. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm._spark import checkpoint, map_texts

#: Letters and digits of ASCII (A-Z lower-cased) and all bytes beyond ASCII belong to terms, all else parts them.
TERM_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: How many documents an item gets, and by how much the length of a document counts, in hundredths.
K, LENGTH_SHARE = 50, 50

#: Characters of the items that are held at a time.
PART_CHARS = 20_000_000
#: Vectors searched for first kth scores.
SEED_ROWS = 20_000


@dataclass(frozen=True)
class Shape:
    """Items and documents of a leaf, nodes of a node, and documents and terms of a batch."""

    item_leaf: int = 8
    doc_leaf: int = 32
    fan: int = 4
    batch_docs: int = 2048
    batch_terms: int = 1_000_000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TERM_BYTES).split()


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def spans(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that belong to `rows`, one row after the other, and where each begins among them."""
    size = starts[rows + 1] - starts[rows]
    own = starts_of(size)
    return np.repeat(starts[rows] - own[:-1], size) + np.arange(own[-1]), own


@dataclass
class Items:
    """The query set of a task: the terms of each item (`terms` from `starts`), weights, first kth scores, and the nodes of each level, leaves first."""

    ids: pa.Array
    terms: np.ndarray
    starts: np.ndarray
    weights: np.ndarray
    floors: np.ndarray
    shape: Shape
    levels: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def ordered(cls, ids: pa.Array, lists: list[list[int]], weights: np.ndarray, shape: Shape = Shape()) -> Items:
        """Items by their heaviest terms, so that alike ones are neighbours, with nodes over them."""
        keys = [sorted(own, key=lambda t: (-weights[t], t)) for own in lists]
        order = sorted((i for i, own in enumerate(lists) if own), key=lambda i: keys[i])
        lists = [sorted(lists[i]) for i in order]
        starts = starts_of(np.array([len(x) for x in lists], np.int64))
        items = cls(ids.take(pa.array(order, pa.int64())), np.array([t for x in lists for t in x], np.int64), starts, weights, np.zeros(len(lists), np.int64), shape)
        sets, size = lists, shape.item_leaf
        while len(sets) > 1 or not items.levels:
            sets = [sorted(set().union(*sets[i : i + size])) for i in range(0, len(sets), size)]
            items.levels.append((np.array([t for x in sets for t in x], np.int64), starts_of(np.array([len(x) for x in sets], np.int64))))
            size = shape.fan
        return items

    def __len__(self) -> int:
        return len(self.starts) - 1

    def weakest(self, kth: np.ndarray) -> list[np.ndarray]:
        """For each level the least kth score of each node's items."""
        out, size = [], self.shape.item_leaf
        for _ in self.levels:
            kth = np.minimum.reduceat(kth, np.arange(0, len(kth), size))
            out.append(kth)
            size = self.shape.fan
        return out


def maxima(node: np.ndarray, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest value of each pair of node and term, in their order."""
    order = np.lexsort((term, node))
    node, term, value = node[order], term[order], value[order]
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])]) if len(node) else np.empty(0, np.int64)
    return node[first], term[first], np.maximum.reduceat(value, first) if len(first) else value


class Search:
    """The answers of a task as they grow: at most `k` documents an item."""

    def __init__(self, items: Items, k: int, id_type: pa.DataType):
        self.items, self.k, self.shape = items, k, items.shape
        self.kth = items.floors.copy()
        self.best = pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": pa.array([], id_type)})
        self.dense = np.zeros(len(items.weights), np.int64)
        self.place = np.zeros(len(items.weights), np.int64)

    def batch(self, ids: pa.Array, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Search documents: their ids, and for each of their terms document, term and value."""
        if not len(doc):
            return
        weight = self.items.weights[term] * value
        by_weight = np.lexsort((term, -weight, doc))
        first = np.flatnonzero(np.r_[True, doc[by_weight][1:] != doc[by_weight][:-1]])
        heaviest = np.full(len(ids), len(self.items.weights))
        heaviest[doc[by_weight][first]] = term[by_weight][first]
        order = np.argsort(heaviest, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc = rank[doc]
        size = self.shape.doc_leaf
        levels = [maxima(doc // size, term, value)]
        while levels[-1][0][-1] > 0:
            levels.append(maxima(levels[-1][0] // self.shape.fan, *levels[-1][1:]))
        by_doc = np.argsort(doc, kind="stable")
        leaves = (doc[by_doc], term[by_doc], value[by_doc])
        leaf_starts = np.searchsorted(leaves[0], np.arange(0, len(ids) + size, size))
        found = [self.scored(leaf, nodes, [x[leaf_starts[leaf] : leaf_starts[leaf + 1]] for x in leaves]) for leaf, nodes in self.walk(levels)]
        if found:
            item, score, spot = (np.concatenate(x) for x in zip(*found))
            self.keep(item, score, ids.take(pa.array(order[spot])))

    def walk(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves of documents, each with the leaves of items that it may matter to."""
        weakest = self.items.weakest(self.kth)
        depth, fan = len(self.items.levels), self.shape.fan
        bounds = [np.searchsorted(node, np.arange(node[-1] + 2)) for node, _, _ in levels]
        todo = [(len(levels) - 1, depth - 1, 0, np.array([0]))]
        while todo:
            level, height, node, asked = todo.pop()
            a, b = bounds[level][node], bounds[level][node + 1]
            terms, values = levels[level][1][a:b], levels[level][2][a:b]
            asked = asked[self.bound(height, asked, terms, values) >= np.maximum(weakest[height][asked], 1)]
            if not len(asked):
                continue
            if level == 0 and height == 0:
                yield node, asked
                continue
            if height:
                below = len(self.items.levels[height - 1][1]) - 1
                asked = (asked[:, None] * fan + np.arange(fan)).ravel()
                asked = asked[asked < below]
            nodes = [node]
            if level:
                nodes = range(node * fan, min((node + 1) * fan, len(bounds[level - 1]) - 1))
            todo += [(max(0, level - 1), max(0, height - 1), n, asked) for n in nodes]

    def bound(self, height: int, asked: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """At most what any item of each node can score with any document that these largest values stand for."""
        own, starts = self.items.levels[height]
        places, begin = spans(starts, asked)
        self.dense[terms] = values * self.items.weights[terms]
        out = np.add.reduceat(self.dense[own[places]], begin[:-1])
        self.dense[terms] = 0
        return out

    def scored(self, leaf: int, nodes: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, score and place of each document of a leaf that is as good as the kth of an item of the nodes."""
        items = (nodes[:, None] * self.shape.item_leaf + np.arange(self.shape.item_leaf)).ravel()
        items = items[items < len(self.items)]
        (doc, term, value), size = rows, self.shape.doc_leaf
        known, spot = np.unique(term, return_inverse=True)
        block = np.zeros((len(known) + 1, size), np.int64)
        block[spot + 1, doc - leaf * size] = value * self.items.weights[term]
        self.place[known] = np.arange(1, len(known) + 1)
        places, begin = spans(self.items.starts, items)
        where = self.place[self.items.terms[places]]
        scores = np.add.reduceat(block[where], begin[:-1], axis=0)
        self.place[known] = 0
        item, at = np.nonzero((scores > 0) & (scores >= self.kth[items, None]))
        return items[item], scores[item, at], leaf * size + at

    def keep(self, item: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        both = pa.concat_tables([self.best, pa.table({"item": pa.array(item, pa.int64()), "score": pa.array(score, pa.int64()), "id": ids})]).combine_chunks()
        both = both.take(pc.sort_indices(both, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")]))
        item = both.column("item").to_numpy()
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        self.best = both.filter(pa.array(rank < self.k))
        last = both.filter(pa.array(rank == self.k - 1))
        own = last.column("item").to_numpy()
        self.kth[own] = np.maximum(self.kth[own], last.column("score").to_numpy())


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """`id`, the number `n` of all terms, and those of the vocabulary (`terms`) with their occurrences (`tf`), for documents with a term."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null")

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        number = held.value.get
        sizes, terms, counts, ends = [], [], [], [0]
        for text in batch.column("text").to_pylist():
            words = terms_of(text)
            own, n = np.unique(np.array([t for t in map(number, words) if t is not None], np.int32), return_counts=True)
            sizes.append(len(words))
            terms.append(own)
            counts.append(n.astype(np.int32))
            ends.append(ends[-1] + len(own))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x), pa.int32())) for x in (terms, counts)]
        out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "tf"])
        return [out.filter(pc.greater(out.column("n"), 0))]

    return map_texts(docs, "text", run, f"id {dict(docs.dtypes)['id']}, n bigint, terms array<int>, tf array<int>")


def searched(found: DataFrame, items: Items, total: tuple[int, int], k: int, item_type: str) -> DataFrame:
    """`item`, `item_id`, `doc_id` and `score`: from each task at most `k` rows of vectors for each item. `total` holds documents and terms of the corpus."""
    held = found.sparkSession.sparkContext.broadcast(items)
    many, length = total
    kind = dict(found.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, search = held.value, None
        for batch in batches:
            if search is None:
                search = Search(items, k, batch.column("id").type)
            n, terms, counts = (batch.column(c) for c in ("n", "terms", "tf"))
            starts = starts_of(pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
            term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, counts))
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n.to_numpy() * many) // length
            doc = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            value = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
            a = 0
            while a < batch.num_rows:
                b = int(np.searchsorted(starts, starts[a] + items.shape.batch_terms, "right")) - 1
                b = min(max(b, a + 1), a + items.shape.batch_docs, batch.num_rows)
                own = slice(starts[a], starts[b])
                search.batch(batch.column("id").slice(a, b - a), doc[own] - a, term[own], value[own])
                a = b
        if search is not None and search.best.num_rows:
            best = search.best.combine_chunks()
            item = best.column("item")
            columns = [item, pa.chunked_array([items.ids]).take(item), best.column("id"), best.column("score")]
            yield from pa.table(columns, names=["item", "item_id", "doc_id", "score"]).to_batches()

    return found.mapInArrow(run, f"item bigint, item_id {item_type}, doc_id {kind}, score bigint")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_part(docs: DataFrame, part: DataFrame, k: int, key: str, text: str, shape: Shape) -> DataFrame:
    """The ranks of the items of one part."""
    spark, item_type = docs.sparkSession, dict(part.dtypes)["item_id"]
    taken = part.toArrow()
    lists = [set(terms_of(t)) for t in taken.column("text").to_pylist()]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*lists)))}
    none = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {dict(docs.dtypes)[key]}, score bigint")
    if not vocabulary:
        return none
    found = checkpoint(vectors(docs, vocabulary, key, text))
    many, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not many:
        return none
    weight = F.floor(1000 * F.log((2.0 * many + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = np.full(len(vocabulary), -1, np.int64)
    for row in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).toLocalIterator():
        weights[row["term"]] = row["w"]
    lists = [[vocabulary[t] for t in own if weights[vocabulary[t]] > 0] for own in lists]
    items = Items.ordered(taken.column("item_id").combine_chunks(), lists, np.maximum(weights, 0), shape)
    if not len(items):
        return none
    if many > SEED_ROWS:
        some = found.filter(F.pmod(F.xxhash64("id", "n"), F.lit(many)) < SEED_ROWS)
        seeds = ranked(searched(some, items, (many, length), k, item_type), k).filter(F.col("rank") == k)
        for row in seeds.select("item", "score").collect():
            items.floors[row["item"]] = row["score"]
    rows = searched(found, items, (many, length), k, item_type)
    return ranked(rows, k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """`item_id`, `rank` from 1, `doc_id` and `score` of the `k` best documents of each item with a score above 0; of equal scores the least id is first."""
    items = items.select(F.col(item_key).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-chars // PART_CHARS))
    out = None
    for i in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == i)
        own = search_part(docs, part, k, key, text, shape)
        out = own if out is None else out.union(own)
    return out
