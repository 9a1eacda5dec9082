"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, then exact edit distances.

An item leaks into a document if some run of the document's words is within an edit
distance, in words, of (1 - SIMILARITY) of the item's words. The CGK embedding walks
through a window of words, copying the word it stands on and moving on or not by a random
bit for each step and word. Two windows with few edits between them then agree at most
steps. For each of WALKS embeddings, SAMPLES sets of PICKED steps are hashed. A window of
`size` steps reads about size / 2 words, so an item has keys from several anchors, which
together reach from its first word to its last; a window that shares a hash with any of them
is a candidate for the item, shifted by the anchor's place. Edits that gather in one part of
an item thus leave its other anchors whole.

Windows are embedded only where the q-gram lemma allows a match: a run of words within d
edits of an item of n words holds at least n - 1 - 2 d of the item's word pairs, so a stretch
of n + d words with fewer pairs of any item cannot match. Candidates are verified by the
exact edit distance of the item and the closest run of words.

Items are read in blocks of at most ITEM_BLOCK items and ITEM_CHARS characters, each a broadcast, and
each block is one pass over all documents, so that a task holds one block whatever the benchmark's size.
Item ids may be of any type.

Null and empty texts match nothing, as do items without words; items of fewer than five
words match exactly. Repeated documents are told each; of several matches of an item in a
document the closest is told, then the first. Extra columns are ignored by `find_leaks` and
carried by `drop_leaks`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voxloom.llm._spark import map_texts
from voxloom.llm._words import hashes, mixed, shared, words_of

SIMILARITY = 0.8
WALKS, SAMPLES, PICKED = 16, 8, 3
#: Items, and characters of their texts, in a broadcast at most; a longer text is a block of its own.
ITEM_BLOCK, ITEM_CHARS = 10_000, 20_000_000
BINS = 128
FILTER_BITS = 22
#: Windows that a task embeds at a time.
WINDOWS = 1024


class Need(NamedTuple):
    """What a window must have to match an item of `n` words: `pairs` known pairs in a stretch of `width`; and where, from there, keys may start."""

    n: int
    width: int
    pairs: int
    first: np.ndarray
    last: np.ndarray


class Items(NamedTuple):
    """A block of the benchmark."""

    ids: pa.Array
    words: list[np.ndarray]
    bags: np.ndarray
    edits: np.ndarray
    pairs: np.ndarray
    filter: np.ndarray
    #: By size class: what its items need, and sorted keys with their items and anchors.
    classes: dict[int, tuple[list[Need], np.ndarray, np.ndarray, np.ndarray]]


def pairs_of(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each two neighbouring words."""
    return (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) * np.uint64(0xD6E8FEB86659FD93)


def bag(words: np.ndarray) -> np.ndarray:
    """How many words fall into each of BINS bins."""
    return np.bincount(words & np.uint32(BINS - 1), minlength=BINS)


@functools.lru_cache(64)
def picked(size: int) -> np.ndarray:
    """The steps of each walk and sample for windows of `size` words at least."""
    rng = np.random.default_rng(size)
    return np.stack([np.sort(rng.choice(size, min(PICKED, size), False)) for _ in range(WALKS * SAMPLES)])


def embedded(words: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """The embedding of the window at each start: (walk, window, step). No walk passes `steps` words."""
    walk = np.arange(WALKS, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate([words.astype(np.uint64), np.zeros(steps + 1, np.uint64)])
    at = np.repeat(starts[None], WALKS, 0)
    out = np.empty((WALKS, len(starts), steps), np.uint64)
    for j in range(steps):
        out[:, :, j] = padded[at]
        at = at + (mixed(out[:, :, j] * np.uint64(0x9E3779B97F4A7C15) + walk + np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return out


def keys(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """(walk and sample, window) keys."""
    steps, code = picked(size), embedded(words, starts, size)
    number = np.arange(len(steps), dtype=np.uint64)
    key = np.repeat(mixed(number + np.uint64(1))[:, None], len(starts), 1)
    for j in range(steps.shape[1]):
        key = mixed(key * np.uint64(0x100000001B3) + code[np.arange(len(steps)) // SAMPLES, :, steps[:, j]])
    return key


def size_class(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def anchors(n: int, size: int) -> np.ndarray:
    """Words of an item of `n` words at which its keys start: about size / 2 apart, the last with room for most walks of `size` steps."""
    last = max(0, n - (size * 5 + 7) // 8)
    return np.unique(np.linspace(0, last, -(-last * 2 // size) + 1).round().astype(np.int64))


def block_of(ids: pa.Array, texts: Sequence[str | None], similarity: float = SIMILARITY) -> Items:
    words = [hashes(words_of(t)) for t in texts]
    ids = ids.filter(pa.array([len(w) > 0 for w in words], pa.bool_()))
    words = [w for w in words if len(w)]
    edits = np.array([int((1 - similarity) * len(w) + 1e-9) for w in words], np.int64)
    pairs = np.unique(np.concatenate([pairs_of(w) for w in words] or [np.empty(0, np.uint64)]))
    flags = np.zeros(2**FILTER_BITS, bool)
    flags[pairs >> np.uint64(64 - FILTER_BITS)] = True
    classes = {}
    for size in sorted({size_class(len(w)) for w in words}):
        own = np.array([i for i, w in enumerate(words) if size_class(len(w)) == size])
        places = [anchors(len(words[i]), size) for i in own]
        key = np.concatenate([keys(words[i], p, size) for i, p in zip(own, places)], 1)
        owner = np.broadcast_to(np.repeat(own, [len(p) for p in places]), key.shape).ravel()
        anchor = np.broadcast_to(np.concatenate(places), key.shape).ravel()
        order = key.ravel().argsort(kind="stable")
        needs = [need_of(n, e, size) for n, e in sorted({(len(words[i]), int(edits[i])) for i in own})]
        classes[size] = (needs, key.ravel()[order], owner[order], anchor[order])
    bags = np.stack([bag(w) for w in words]) if words else np.empty((0, BINS), np.int64)
    return Items(ids, words, bags, edits, pairs, flags, classes)


def need_of(n: int, edits: int, size: int) -> Need:
    at = anchors(n, size)
    shift = np.where(at > 0, edits, 0)
    return Need(n, n + edits - 2, max(1, n - 1 - 2 * edits), at - shift, at + shift + 1)


def allowed_starts(hits: np.ndarray, needs: list[Need], n_words: int) -> np.ndarray:
    """Where an anchor's window may start so that a match of one of these sizes is possible; `hits` are the places of known pairs."""
    least, widest = min(x.pairs for x in needs), max(x.width for x in needs)
    if len(hits) < least or not (hits[least - 1 :] - hits[: len(hits) - least + 1] <= widest).any():
        return np.empty(0, np.int64)
    lows, highs = [], []
    for need in needs:
        if len(hits) >= need.pairs:
            first, last = hits[: len(hits) - need.pairs + 1], hits[need.pairs - 1 :]
            fits = np.flatnonzero(last - first <= need.width)
            if len(fits):
                lows.append((np.maximum(0, last[fits] - need.width)[:, None] + need.first).ravel())
                highs.append((first[fits][:, None] + need.last).ravel())
    if not lows:
        return np.empty(0, np.int64)
    ends = [np.bincount(np.minimum(np.maximum(np.concatenate(x), 0), n_words), minlength=n_words + 1) for x in (lows, highs)]
    return np.flatnonzero(np.cumsum(ends[0] - ends[1])[:-1] > 0)


def candidates(words: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Items and starts, sorted, of pairs that share a key; the start as it would be if no word before the anchor were edited."""
    if len(words) < 2:
        found = np.array([i for i, w in enumerate(items.words) if len(w) == 1 and len(words) and w[0] == words[0]], np.int64)
        return found, np.zeros_like(found)
    h = pairs_of(words)
    hits = np.flatnonzero(items.filter[h >> np.uint64(64 - FILTER_BITS)])
    if len(hits):
        spot = np.minimum(np.searchsorted(items.pairs, h[hits]), len(items.pairs) - 1)
        hits = hits[items.pairs[spot] == h[hits]]
    found = []
    for size, (needs, table, owner, anchor) in items.classes.items():
        starts = np.arange(len(words)) if needs[0].n == 1 else allowed_starts(hits, needs, len(words))
        for a in range(0, len(starts), WINDOWS):
            part = starts[a : a + WINDOWS]
            key = keys(words, part, size)
            low = np.searchsorted(table, key)
            _, window = match = np.nonzero(table[np.minimum(low, len(table) - 1)] == key)
            if len(window):
                low = low[match]
                count = np.searchsorted(table, key[match], "right") - low
                spot = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                found.append(owner[spot] << 32 | np.maximum(0, part[np.repeat(window, count)] - anchor[spot]))
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF


def stretches(words: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item, low, high): the stretches of the text in which an item's candidates lie, those that reach into each other as one."""
    item, start = candidates(words, items)
    if not len(item):
        return
    edits, size = items.edits[item], np.array([len(w) for w in items.words])[item]
    apart = np.flatnonzero((item[1:] != item[:-1]) | (np.diff(start) > (size + 3 * edits)[:-1])) + 1
    first, last = np.r_[0, apart], np.r_[apart, len(item)] - 1
    low = np.maximum(0, start[first] - edits[first])
    high = start[last] + size[last] + 2 * edits[last]
    yield from zip(item[first].tolist(), low.tolist(), high.tolist())


def distances(item: np.ndarray, words: np.ndarray, free_start: bool) -> np.ndarray:
    """The edit distance of the item to the run of words that ends before each place, from the start or from the best place."""
    n = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64) if free_start else n.copy()
    for word in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        np.minimum(row[:-1] + (words != word), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - n) + n
    return row


def closest(item: np.ndarray, words: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the closest run of words, the first of several, if it is within `edits`."""
    ends = distances(item, words, True)
    end = int(ends.argmin())
    if ends[end] > edits:
        return None
    back = distances(item[::-1], words[:end][::-1], False)
    size = min(np.flatnonzero(back == ends[end]), key=lambda s: abs(s - len(item)))
    return int(ends[end]), end - int(size), end


def leaks(text: str | None, items: Items) -> list[tuple[int, int, int, int, float]]:
    """(item, start, end, distance, similarity) for each item of the block that the text holds, in words."""
    words = hashes(words_of(text))
    best: dict[int, tuple[int, int, int]] = {}
    for item, low, high in stretches(words, items):
        own, edits, stretch = items.words[item], int(items.edits[item]), words[low:high]
        if len(own) - np.minimum(items.bags[item], bag(stretch)).sum() > edits or len(own) - shared(own, stretch) > edits:
            continue
        if hit := closest(own, stretch, edits):
            hit = (hit[0], hit[1] + low, hit[2] + low)
            best[item] = min(best.get(item, hit), hit)
    return [(i, start, end, distance, 1 - distance / len(items.words[i])) for i, (distance, start, end) in sorted(best.items())]


def blocks(benchmark: DataFrame, item_id: str, text: str, similarity: float) -> Iterator[Items]:
    """The benchmark in blocks of at most ITEM_BLOCK items and about ITEM_CHARS characters."""
    kind = to_arrow_type(benchmark.schema[item_id].dataType)
    ids, texts, held = [], [], 0
    for row in benchmark.select(item_id, text).filter(F.col(text).isNotNull()).toLocalIterator():
        if texts and (len(texts) == ITEM_BLOCK or held + len(row[1]) > ITEM_CHARS):
            yield block_of(pa.array(ids, kind), texts, similarity)
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1])
    if texts:
        yield block_of(pa.array(ids, kind), texts, similarity)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """`key`, `item_id`, start_word, end_word, distance and similarity of each item found in each row of `docs`."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = dict(source.dtypes)["key"], dict(benchmark.dtypes)[item_id]
    schema = f"key {kinds[0]}, item {kinds[1]}, start_word int, end_word int, distance int, similarity double"
    found = None
    for items in blocks(benchmark, item_id, "text", similarity):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batch: pa.RecordBatch, held=held) -> list[pa.RecordBatch]:
            rows = [leaks(t, held.value) for t in batch.column("text").to_pylist()]
            own = np.repeat(np.arange(batch.num_rows), [len(r) for r in rows])
            flat = [x for r in rows for x in r]
            if not flat:
                return []
            item, start, end, distance, share = zip(*flat)
            ids = held.value.ids.take(pa.array(item))
            columns = [batch.column("key").take(pa.array(own)), ids, pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(distance, pa.int32()), pa.array(share, pa.float64())]
            return [pa.RecordBatch.from_arrays(columns, names=["key", "item", "start_word", "end_word", "distance", "similarity"])]

        part = map_texts(source, "text", run, schema)
        found = part if found is None else found.union(part)
    if found is None:
        found = source.filter("false").select("key", *[F.lit(None).cast(t).alias(c) for c, t in (("item", kinds[1]), ("start_word", "int"), ("end_word", "int"), ("distance", "int"), ("similarity", "double"))])
    return found.withColumnsRenamed({"key": key, "item": item_id})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that hold no item: each block of items is one pass over the texts."""
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in docs.columns)
    for items in blocks(benchmark, item_id, "text", similarity):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batch: pa.RecordBatch, held=held) -> list[pa.RecordBatch]:
            return [batch.filter(pa.array([not leaks(t, held.value) for t in batch.column(text).to_pylist()], pa.bool_()))]

        docs = map_texts(docs, text, run, schema)
    return docs
