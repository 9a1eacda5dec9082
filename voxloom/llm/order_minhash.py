"""Near-duplicates of documents by order MinHash, verified by banded alignment.

Sketch: shingles of K words are labelled with their occurrence, so that repeated ones
count as often as they stand. For each of BANDS random orders the ELL least shingles are
taken and put back into text order; their hash is the band's key. Two texts meet in a band
if they share these shingles in the same order, which happens often for a high edit
similarity and seldom for texts that share words alone.

Candidates: exact copies (equal words) are one node from the start, and a node is a number. Keys and numbers
are shuffled once; what stays are the buckets of two nodes or more, each with its least node, the hub. Each node is
first aligned with the least of its hubs, which joins families; then with those of its other hubs that are in
another component by then. Then the pairs of a bucket that these links leave in different components are compared, whatever the
bucket's size. Buckets of up to SMALL nodes are joined row by row. Larger ones come into cells: a bucket that fits in a block is one cell; the nodes of
others are split by length, as they can be linked only within a class of lengths or across neighbouring ones, and dealt into blocks, which are held
against each other once, unless both are of one component. A task holds the words of the nodes of a cell. It aligns the pairs that are in different components
and whose lengths and bags of words, counted in about as many bins as there are words, allow a link, and joins components by the links that it finds.
A pair with several large buckets is left to the first of them. So each pair that shares a key is aligned, ruled out by an exact bound, or in one component already;
no cap drops a pair.

Growth: a text is read into words once. Words of a large bucket move once for each cell, which is once for a bucket of up to BLOCK nodes, and no row is made for a pair; beyond
BLOCK nodes of like length, rows grow with the square of the bucket over BLOCK, and so does the time of comparison over all. Alignments, too, grow with the
square of a family whose bags are alike and whose texts are not.

Two nodes are linked if 1 - (edit distance in words) / (words of the longer) is at least
SIMILARITY; limits of the alignment's band follow from it. Classes are the connected
components of the links: each root goes to the least one it is linked with, again and again.

Recall of a pair is about 1 - (1 - J ** ELL) ** BANDS for the Jaccard index J of their
shingles, before links by way of third texts. For edits spread at random over a fifth of the words J is about 0.2, and nine pairs of
ten or more are found (`test_recall_of_spread_edits`); more where edits are fewer or gathered.

Null texts are classes of their own. Texts without a word are copies if they are equal.
Texts of fewer than K words are near only to copies. Very long texts are sketched and
aligned whole. `near_duplicates` tells repeated rows and repeated or null ids each; the class id is the least
id of the class. `keep_first` keeps one row of a class; it carries other columns, whatever their names,
and does not read them.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm._spark import checkpoint, map_texts, small, unused, written
from voxloom.llm._words import edit_distance, hashes, mixed, shingles, words_of

K, ELL, BANDS, SIMILARITY = 5, 2, 64, 0.8
#: Buckets up to this size are joined row by row; larger ones are compared in blocks of about BLOCK nodes and BLOCK_WORDS words.
SMALL, BLOCK, BLOCK_WORDS = 16, 4096, 4_000_000
#: Bins of a bag, as powers of two: at least and at most.
BINS = (6, 12)
#: The group of blocks that may hold several components.
MIXED = "-"
#: Longest to shortest text of a class of lengths: linkable texts lie in one class or in neighbouring ones for any similarity of 1 / LENGTHS or more.
LENGTHS = 1.25
#: Nodes in pairs up to which their ids are broadcast to pick their texts: some 150 MB at most.
BROADCAST_NODES = 2_000_000
#: Values that a task holds while it orders shingles.
HELD = 4_000_000

#: Rows of a partition of tables about nodes.
PART_ROWS = 20_000

_rng = np.random.default_rng(20190731)
MULTIPLIERS = _rng.integers(1, 2**63, BANDS, np.uint64) | np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, BANDS, np.uint64)


def fingerprint(text: str, words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words) if words else b"\0" + text.encode("utf-8", "replace")).digest()


def sketch(words: np.ndarray) -> np.ndarray:
    """A key for each band; none for fewer than K words."""
    if len(words) < K:
        return np.empty(0, np.int64)
    h = shingles(words, K)
    if len(np.unique(h)) < len(h):
        order = np.argsort(h, kind="stable")
        first = np.r_[True, h[order][1:] != h[order][:-1]]
        spot = np.arange(len(h))
        occurrence = np.empty(len(h), np.uint64)
        occurrence[order] = spot - np.maximum.accumulate(np.where(first, spot, 0))
        h = np.where(occurrence > 0, mixed(h + occurrence * np.uint64(0x9E3779B97F4A7C15)), h)
    keys = np.empty(BANDS, np.uint64)
    step = max(1, HELD // len(h))
    for a in range(0, BANDS, step):
        value = (h ^ SHIFTS[a : a + step, None]) * MULTIPLIERS[a : a + step, None]
        band, spots = np.arange(len(value)), []
        for _ in range(min(ELL, len(h))):
            spots.append(value.argmin(1))
            value[band, spots[-1]] = np.uint64(2**64 - 1)
        key = band.astype(np.uint64) + np.uint64(a + 1)
        for spot in np.sort(np.stack(spots), 0):
            key = mixed(key * np.uint64(0x100000001B3) + h[spot])
        keys[a : a + step] = key
    return keys.view(np.int64)


def bag(words: np.ndarray) -> bytes:
    """How many words fall into each bin, up to 255; the bins are a power of two."""
    bins = 1 << min(max(len(words).bit_length(), BINS[0]), BINS[1])
    return np.minimum(np.bincount(words % bins, minlength=bins), 255).astype(np.uint8).tobytes()


def folded(bags: list[bytes], bins: int) -> np.ndarray:
    """Bags as rows of a table with fewer bins. A word's edit changes no more of them than before."""
    return np.stack([np.frombuffer(b, np.uint8).reshape(-1, bins).sum(0, dtype=np.uint16) for b in bags])


def fewest_edits(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distances of a bag's text and others: an edit takes a word from one bin at most, and adds one to one."""
    both = np.minimum(own, others).sum(1, dtype=np.int64)
    return np.maximum(own.sum(dtype=np.int64), others.sum(1, dtype=np.int64)) - both


def sketched(docs: DataFrame) -> DataFrame:
    """`id`, `node`, `words` and `keys` of the rows (`id`, `text`) of `docs`; `node` is null where the text is."""

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        texts = batch.column("text").to_pylist()
        words = [words_of(t) for t in texts]
        nodes = [None if t is None else fingerprint(t, w) for t, w in zip(texts, words)]
        keys = [sketch(hashes(w)) for w in words]
        columns = [batch.column("id"), pa.array(nodes, pa.binary()), pa.array([len(w) for w in words], pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
        return [pa.RecordBatch.from_arrays(columns, names=["id", "node", "words", "keys"])]

    return map_texts(docs, "text", run, f"id {dict(docs.dtypes)['id']}, node binary, words int, keys array<bigint>")


def may_match(n: Column, m: Column, similarity: float) -> Column:
    """Whether lengths allow a pair to be linked."""
    return F.greatest(n, m) - F.least(n, m) <= F.floor((1 - similarity) * F.greatest(n, m) + 1e-9)


def texts_of(wanted: DataFrame, docs: DataFrame, scale: Scale) -> DataFrame:
    """`nid` and `hashed` (the bytes of its words) of the rows (`nid`, `node`, `id`) of `wanted`."""
    ids = scale.look(wanted.select(F.col("id").alias("wanted_id")))
    source = docs.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        texts = [t for t in batch.column("text").to_pylist() if t is not None]
        words = [words_of(t) for t in texts]
        columns = [pa.array([fingerprint(t, w) for t, w in zip(texts, words)], pa.binary()), pa.array([hashes(w).tobytes() for w in words], pa.binary())]
        return [pa.RecordBatch.from_arrays(columns, names=["node", "hashed"])]

    texts = map_texts(source, "text", run, "node binary, hashed binary").join(scale.look(wanted.select("node", "nid")), "node")
    return checkpoint(texts.groupBy("nid").agg(F.any_value("hashed").alias("hashed")))


def most_edits(n: int, m: int, similarity: float) -> int:
    return int((1 - similarity) * max(n, m) + 1e-9)


def aligned(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (`a`, `b`) whose texts are similar enough, written once."""
    both = pairs.join(texts.select(F.col("nid").alias("a"), F.col("hashed").alias("words_a")), "a")
    both = both.join(texts.select(F.col("nid").alias("b"), F.col("hashed").alias("words_b")), "b")

    def align(batches):
        for batch in batches:
            found = []
            for x, y in zip(batch.column("words_a"), batch.column("words_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                found.append(edit_distance(x, y, most_edits(len(x), len(y), similarity)) is not None)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(found, pa.bool_()))

    return checkpoint(both.select("a", "b", "words_a", "words_b").mapInArrow(align, "a bigint, b bigint"))


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


@dataclass(frozen=True)
class Scale:
    """How tables of at most `rows` rows are joined and held: looked up in a broadcast copy where that is small enough, in partitions of PART_ROWS rows at most."""

    rows: int

    def look(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.rows <= BROADCAST_NODES else df

    def pack(self, df: DataFrame) -> DataFrame:
        """`df`, written, in no more partitions than its rows need."""
        return written(df.coalesce(max(1, -(-self.rows // PART_ROWS))))


def forest(parents: DataFrame, scale: Scale) -> DataFrame:
    """`node` and `root` of trees whose links lead from each `node` to one lesser `parent`, by steps that double."""
    known = scale.pack(parents.select("node", F.col("parent").alias("root")))
    while True:
        further = known.select(F.col("node").alias("root"), F.col("root").alias("next"))
        stepped = scale.pack(known.join(scale.look(further), "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        known = stepped.select("node", "root")
        if stepped.filter("moved").isEmpty():
            return known


def rooted_by(roots: DataFrame, links: DataFrame, scale: Scale) -> DataFrame:
    """`roots` (`nid`, `root`) after more links between their nodes.

    Links are led to the roots of their ends. Each root goes to the least one that it is linked with, which makes trees; their roots take
    the place of all in them, at most half as many as before, until no link joins two.
    """
    own = lambda end: scale.look(roots.select(F.col("nid").alias(end), F.col("root").alias(f"root_{end}")))
    edges = links.select("a", "b").join(own("a"), "a").join(own("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    while True:
        edges = written(edges.filter("a != b"))
        if edges.isEmpty():
            return roots
        parents = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent")).filter("parent < node")
        trees = forest(parents, scale)
        moved = lambda end: scale.look(trees.select(F.col("node").alias(end), F.col("root").alias("to")))  # noqa: B023, E731
        roots = scale.pack(roots.join(moved("root"), "root", "left").select("nid", F.coalesce("to", "root").alias("root")))
        edges = edges.join(moved("a"), "a", "left").select(F.coalesce("to", "a").alias("a"), "b")
        edges = edges.join(moved("b"), "b", "left").select("a", F.coalesce("to", "b").alias("b")).distinct()


def classes(docs: DataFrame, rows: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`nid` and `root` of the nodes that share a key with another one. Nodes have the same root if links join them.

    `rows` has `rid` and `keys`, `nodes` has `nid` (the `rid` of one of its rows), `node`, `id` and `words`.
    """
    scale = Scale(nodes.count())
    firsts = rows.join(scale.look(nodes.select("nid")), F.col("rid") == F.col("nid"), "left_semi")
    members = firsts.select(F.col("rid").alias("nid"), "words", F.explode("keys").alias("key"))
    own = Window.partitionBy("key")
    members = members.withColumns({"hub": F.min(F.struct("nid", "words")).over(own), "n": F.count("*").over(own)}).filter("n > 1")
    members = checkpoint(members.select("key", "nid", "words", "n", F.col("hub.nid").alias("hub"), F.col("hub.words").alias("hub_words")))
    wanted = scale.pack(nodes.join(scale.look(members.select("nid").distinct()), "nid", "left_semi"))
    texts = texts_of(wanted, docs, scale)
    near = may_match(F.col("words"), F.col("hub_words"), similarity)
    to_hub = checkpoint(members.filter((F.col("nid") != F.col("hub")) & near).select(F.col("hub").alias("a"), F.col("nid").alias("b")).distinct())
    first = scale.pack(to_hub.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    trees = forest(aligned(first, texts, similarity).select(F.col("b").alias("node"), F.col("a").alias("parent")), scale)
    roots = scale.pack(wanted.select("nid").join(scale.look(trees), F.col("nid") == F.col("node"), "left").select("nid", F.coalesce("root", "nid").alias("root")))
    tried = scale.look(first.select("b", F.col("a").alias("tried")))
    rest = apart(to_hub.join(tried, "b", "left").filter("tried is null or tried != a").select("a", "b"), roots, scale)
    roots = rooted_by(roots, aligned(rest, texts, similarity), scale)
    large, pairs = parted(members, roots, similarity, scale)
    more = aligned(pairs.join(to_hub, ["a", "b"], "left_anti"), texts, similarity)
    many = large.count()
    if not many:
        return rooted_by(roots, more, scale)
    if similarity < 1 / LENGTHS:
        raise ValueError(f"similarities under {1 / LENGTHS} are not supported")
    links = links_in_cells(checkpoint(dealt(large, Scale(many))), texts, roots, similarity, scale)
    return rooted_by(roots, more.union(links), scale)


def apart(pairs: DataFrame, roots: DataFrame, scale: Scale) -> DataFrame:
    """The pairs whose nodes have different roots."""
    for end in ("a", "b"):
        pairs = pairs.join(scale.look(roots.select(F.col("nid").alias(end), F.col("root").alias(f"root_{end}"))), end)
    return checkpoint(pairs.filter("root_a != root_b").select("a", "b"))


def parted(members: DataFrame, roots: DataFrame, similarity: float, scale: Scale) -> tuple[DataFrame, DataFrame]:
    """Of the buckets that hold several roots: the rows of large ones, and the pairs of small ones that have different roots and lengths that allow a link."""
    rooted = members.filter("n > 2").select("key", "nid", "words", "n", "hub").join(scale.look(roots), "nid")
    own = Window.partitionBy("key")
    rooted = checkpoint(rooted.withColumns({"low": F.min("root").over(own), "high": F.max("root").over(own)}).filter("low != high").drop("low", "high"))
    return rooted.filter(F.col("n") > SMALL), checkpoint(pairs_within(rooted.filter(F.col("n") <= SMALL), similarity).distinct())


def pairs_within(rooted: DataFrame, similarity: float) -> DataFrame:
    """The pairs of rows with the same key and other roots, if their lengths allow a link."""
    others = rooted.select("key", F.col("nid").alias("x"), F.col("words").alias("x_words"), F.col("root").alias("x_root"))
    fits = (F.col("x") < F.col("nid")) & (F.col("x_root") != F.col("root")) & may_match(F.col("x_words"), F.col("words"), similarity)
    return rooted.join(others, "key").filter(fits).select(F.col("x").alias("a"), F.col("nid").alias("b"))


def dealt(large: DataFrame, scale: Scale) -> DataFrame:
    """The rows of each cell (`key`, `low`, `high`): `nid`, `hub`, and `upper` for those of the second of its two blocks. A cell is a pair of blocks of one bucket.

    A bucket that fits in a block is one cell. The rows of others are dealt by their class of lengths, which spans a factor of LENGTHS, and blocks meet only
    inside a class or across neighbouring ones. A component that fills half a block has blocks of its own, which need not meet each other.
    """
    size = F.floor(F.log(F.greatest(F.col("words"), F.lit(1)).cast("double")) / math.log(LENGTHS)).cast("long")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("words") / BLOCK_WORDS)).alias("blocks")
    many = scale.pack(large.groupBy("key").agg(blocks).filter("blocks > 1").select("key"))
    rows = large.select("key", "nid", "root", "words", "hub", size.alias("size"))
    whole = rows.join(scale.look(many), "key", "left_anti").select("key", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(False).alias("upper"), "nid", "hub")
    rows = rows.join(scale.look(many), "key", "left_semi")
    alike = rows.groupBy("key", "size", "root").agg(F.count("*").alias("rows")).filter(F.col("rows") >= BLOCK // 2).select("key", "size", "root", F.hex("root").alias("group"))
    rows = scale.pack(rows.join(scale.look(alike), ["key", "size", "root"], "left").withColumn("group", F.coalesce("group", F.lit(MIXED))))
    parts = scale.pack(rows.groupBy("key", "size", "group").agg(blocks))
    label = lambda part: F.xxhash64("key", "size", "group", part).alias("label")
    rows = scale.pack(rows.join(scale.look(parts), ["key", "size", "group"]).select("key", "nid", "hub", label(F.pmod(F.xxhash64("nid"), "blocks"))))
    meet = scale.pack(parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("key", "size", "group", label(F.col("part"))))
    both = meet.toDF("key", "low_size", "low_group", "low").join(meet.toDF("key", "high_size", "high_group", "high"), "key")
    useful = (F.col("low") <= F.col("high")) & (F.abs(F.col("low_size") - F.col("high_size")) <= 1) & ((F.col("low_group") != F.col("high_group")) | (F.col("low_group") == F.lit(MIXED)))
    cells = scale.pack(both.filter(useful).select("key", "low", "high"))
    first = rows.withColumnRenamed("label", "low").join(cells, ["key", "low"]).select("key", "low", "high", F.lit(False).alias("upper"), "nid", "hub")
    second = rows.withColumnRenamed("label", "high").join(cells.filter("low < high"), ["key", "high"]).select("key", "low", "high", F.lit(True).alias("upper"), "nid", "hub")
    return whole.union(first).union(second)


def links_in_cells(rows: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float, scale: Scale) -> DataFrame:
    """The links (`a`, `b`) in the cells of `rows` that join different roots, written once.

    Texts move once for each cell, whatever the number of pairs; they are joined to the list of a node's cells. Hubs stay out, as they have met all of their buckets.
    """
    cells = F.collect_list(F.when(F.col("nid") != F.col("hub"), F.struct("key", "low", "high", "upper"))).alias("cells")
    own = checkpoint(rows.groupBy("nid").agg(cells, F.array_sort(F.collect_set("key")).alias("keys")).filter(F.size("cells") > 0))
    held = texts.join(scale.look(own.select("nid")), "nid", "left_semi")
    full = own.join(scale.look(roots), "nid").join(held, "nid").select("nid", "root", "keys", "hashed", F.explode("cells").alias("cell"))
    full = full.select("cell.*", "nid", "root", "keys", "hashed").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches):
        cell, held = None, []
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high"))))
            start = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[start]:
                    if cell is not None and names[start] != cell:
                        yield links_of(held, cell, similarity)
                        held = []
                    cell = names[start]
                    held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield links_of(held, cell, similarity)

    return checkpoint(full.mapInArrow(run, "a bigint, b bigint"))


def links_of(held: list[pa.RecordBatch], cell: tuple[int, int, int], similarity: float) -> pa.RecordBatch:
    """The links that join roots of a cell: inside its only block, or between its two. A pair is left to the least key that it shares."""
    key, single = cell[0], cell[1] == cell[2]
    table = pa.Table.from_batches(held)
    table = table.take(np.argsort(pc.binary_length(table.column("hashed")).to_numpy(), kind="stable"))
    nids, roots = (table.column(c).to_numpy().astype(np.int64) for c in ("nid", "root"))
    hashed = [np.frombuffer(t.as_buffer(), np.uint32) for t in table.column("hashed")]
    size = np.array([len(h) for h in hashed])
    upper = table.column("upper").to_numpy(zero_copy_only=False)
    keys = table.column("keys").to_pylist()
    bags = [bag(h) for h in hashed]
    bins = np.array([len(b) for b in bags])
    tables = {n: (first, folded(bags[first:], n)) for n in np.unique(bins).tolist() if (first := int(np.argmax(bins >= n))) >= 0}
    coarse = folded(bags, 1 << BINS[0])
    ours, theirs = (np.arange(len(nids)),) * 2 if single else (np.flatnonzero(~upper), np.flatnonzero(upper))
    theirs_size = size[theirs]
    found: list[tuple[int, int]] = []
    for place, i in enumerate(ours):
        low, high = np.searchsorted(theirs_size, [size[i] * similarity - 1, size[i] / similarity + 1])
        spot = theirs[max(low, place + 1) if single else low : high]
        spot = spot[roots[spot] != roots[i]]
        limit = np.floor((1 - similarity) * np.maximum(size[i], size[spot]) + 1e-9)
        near = np.abs(size[i] - size[spot]) <= limit
        spot, limit = spot[near], limit[near]
        if not len(spot):
            continue
        near = fewest_edits(coarse[i], coarse[spot]) <= limit
        spot, limit = spot[near], limit[near]
        if not len(spot):
            continue
        skip, rows = tables[min(int(bins[i]), int(bins[spot].min()))]
        spot = spot[fewest_edits(rows[i - skip], rows[spot - skip]) <= limit]
        own = set(keys[i])
        for j in spot.tolist():
            if roots[j] == roots[i] or next(k for k in keys[j] if k in own) != key:
                continue
            if edit_distance(hashed[i], hashed[j], most_edits(size[i], size[j], similarity)) is not None:
                found.append((min(nids[i], nids[j]), max(nids[i], nids[j])))
                roots[roots == roots[j]] = roots[i]
    return pa.RecordBatch.from_arrays([pa.array([f[x] for f in found], pa.int64()) for x in (0, 1)], names=["a", "b"])


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """`node` and `root`, the least node of its component, for all nodes of the pairs (`a`, `b`)."""
    edges = checkpoint(edges.select("a", "b"))
    nodes = checkpoint(edges.select(F.col("a").alias("nid")).union(edges.select("b")).distinct())
    return rooted_by(nodes.select("nid", F.col("nid").alias("root")), edges, Scale(nodes.count())).withColumnRenamed("nid", "node")


def classified(docs: DataFrame, key: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows (`id`, `node`), and for each node its least `id`, `root` and `class_id`."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = checkpoint(sketched(docs).withColumn("rid", F.monotonically_increasing_id()))
    nodes = checkpoint(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("rid").alias("nid"), F.min("id").alias("id"), F.max("words").alias("words")))
    classed = nodes.select("node", "nid", "id").join(classes(docs, rows, nodes, similarity), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    least = classed.groupBy("root").agg(F.min("id").alias("class_id"))
    return rows.select("id", "node"), classed.join(least, "root").select("node", "id", "root", "class_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of `docs`: `key`, `class_id` (the least key of its class) and `node` (equal for equal words)."""
    rows, classed = classified(docs, key, text, similarity)
    out = rows.join(classed.select("node", "class_id"), "node", "left")
    return out.select(F.col("id").alias(key), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "node")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of `docs` for each class, of those with its least key the one with the least node, then text; and all rows with null texts."""
    rows, classed = classified(docs, key, text, similarity)
    id_, node, copies, place = unused(docs, "id", "node", "copies", "place")
    first = classed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("first")).select(F.col("first.id").alias(id_), F.col("first.node").alias(node))
    rows = rows.toDF("own_id", "own_node")
    kept = rows.join(first, F.col("own_id").eqNullSafe(F.col(id_)) & (F.col("own_node") == F.col(node))).groupBy(id_, node).agg(F.count("*").alias(copies))
    kept = checkpoint(kept)
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in docs.columns), f"`{node}` binary"])

    def own(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        texts, nodes = batch.column(text).to_pylist(), batch.column(node).to_pylist()
        return [batch.filter(pa.array([fingerprint(t, words_of(t)) == n for t, n in zip(texts, nodes)], pa.bool_()))]

    def rows_of(kept: DataFrame) -> DataFrame:
        some = docs.filter(F.col(text).isNotNull()).join(small(kept, BROADCAST_NODES), F.col(key).eqNullSafe(F.col(id_)))
        return map_texts(some.select(*[F.col(f"`{c}`") for c in docs.columns], node), text, own, schema)

    often = rows_of(kept.filter(F.col(copies) > 1)).withColumn(place, F.row_number().over(Window.partitionBy(node).orderBy(text)))
    out = rows_of(kept.filter(F.col(copies) == 1)).drop(node).union(often.filter(F.col(place) == 1).drop(node, place))
    return out.union(docs.filter(F.col(text).isNull()))
