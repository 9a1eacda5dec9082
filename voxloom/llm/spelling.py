"""Spelling variants: words one edit apart, each led to the far more frequent form.

Words are counted first. `count_words` reads whole texts, adds up counts inside tasks, and
Spark adds up those of the tasks.

Near words are found in a bit-sliced position index: for each position and letter a set, kept as the
bits of one whole number, of the words that have the letter there. A word is read letter by letter,
and a few operations on these numbers move sets of all words of the index at once: those without
an error so far, and those with one, where the error was another letter (same position), a letter more in
the indexed word (positions shifted by one to the right) or a letter less (to the left). What is left at the end are the
near words. Indexed words stand by falling frequency, so that the best one is the lowest bit.

The vocabulary is cut so that no index holds all of it and no pair is lost: of two words one edit apart, the
shorter of n letters, either the first n // 2 letters are equal or the last n - n // 2. Words meet where one of these halves is
equal, under the length of the shorter; pairs that are equal in the first half count there alone. Groups of many words are
split into blocks of bounded size on both sides, which meet in cells, so that hot halves are spread over tasks.

Forms lead to words at least RATIO times as frequent, so chains of them are short; roots are found by
joins that double the steps.

Null texts have no words and null ids count as empty in the hash of `slips`. Words of any length are taken whole; beyond
DENSE letters sets are made when they are needed. Repeated rows count each. Empty tables give empty results. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm._spark import checkpoint, chunks, small

#: Letters of a run (A-Z, a-z, U+00C0 to U+00FF), as bytes of Latin-1; A-Z lower-cased, all else a space.
RUNS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))
#: Letters and occurrences of a word, how often more frequent a form is, and how many hashes have one slip.
LEAST_LETTERS, LEAST_COUNT, RATIO, SLIPS = 6, 5, 5, 199

#: Distinct words that a task counts before it hands them on.
HELD = 500_000
#: Words and letters of a block.
BLOCK, LETTERS = 16_384, 4_000_000
#: Positions whose sets are kept.
DENSE = 64
#: Groups of several blocks up to which their table is broadcast.
BIG_GROUPS = 100_000


def runs_of(text: str | None) -> list[bytes]:
    """The runs of letters of a text, lower-cased, in Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(RUNS).split()


def utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, slips: int | None = SLIPS) -> DataFrame:
    """`word` and `n` of all runs of at least `letters` letters that occur at least `least` times.

    With `slips`, a run loses a letter in documents where the hash of id and run is a multiple of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in chunks(batch, "text"):
                for doc, own in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    start = zlib.crc32(f"{doc}:".encode())
                    for word, n in Counter(runs_of(own)).items():
                        if len(word) < letters:
                            continue
                        if slips:
                            h = zlib.crc32(word if word.isascii() else utf8(word), start)
                            if not h % slips:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < letters:
                                    continue
                        total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield rows()
                    total = {}
        yield rows()

    docs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).filter("text is not null")
    return docs.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class PositionIndex:
    """The sets of a block of words: for each position and letter the words that have it there, as bits."""

    def __init__(self, words: list[str], first: int):
        """`first` is the first position that will be asked for."""
        self.words = words
        self.all = (1 << len(words)) - 1
        self.sets: list[dict[str, int]] = []
        self.first = first
        self.long = [k for k, w in enumerate(words) if len(w) > first + DENSE]
        for k, word in enumerate(words):
            for place, letter in enumerate(word[first : first + DENSE]):
                if place == len(self.sets):
                    self.sets.append({})
                own = self.sets[place]
                own[letter] = own.get(letter, 0) | 1 << k
        self.sizes: dict[int, int] = {}
        for k, word in enumerate(words):
            self.sizes[len(word)] = self.sizes.get(len(word), 0) | 1 << k

    def at(self, position: int, letter: str) -> int:
        place = position - self.first
        if place < 0:
            return 0
        if place < DENSE:
            return self.sets[place].get(letter, 0) if place < len(self.sets) else 0
        return sum(1 << k for k in self.long if position < len(self.words[k]) and self.words[k][position] == letter)

    def near_of_shorter(self, word: str, start: int, stop: int) -> tuple[int, int]:
        """Words of the same length with another letter, or with a letter more, from `start` to before `stop`, where all else is equal; and those equal there."""
        none, other, more = self.all, 0, 0
        for i in range(start, stop):
            here, after = self.at(i, word[i]), self.at(i + 1, word[i])
            none, other, more = none & here, (other & here) | (none & ~here), (more | none) & after
            if not (none | other | more):
                break
        same, longer = self.sizes.get(len(word), 0), self.sizes.get(len(word) + 1, 0)
        return (other & same) | ((more | none) & longer), none

    def near_of_longer(self, word: str, start: int, stop: int) -> tuple[int, int]:
        """Words with a letter less, likewise; and those equal in all but the last letter."""
        none, less, before = self.all, 0, self.all
        for i in range(start, stop):
            before = none
            less, none = (less & self.at(i - 1, word[i]) if i > start else 0) | none, none & self.at(i, word[i])
            if not (none | less):
                break
        else:
            return less & self.sizes.get(len(word) - 1, 0), before
        return 0, before


def near_in_cell(size: int, by_end: bool, indexed: list[tuple[int, str]], asked: Iterator[str]) -> Iterator[tuple[str, int, int, str]]:
    """For each word of `asked` with near words among `indexed`: how many, and count and word of the best.

    All words of a cell are of `size` letters or one more, and equal in their first half, or, with `by_end`, in their last.
    """
    indexed = sorted(indexed, key=lambda r: (-r[0], r[1]))
    half = size // 2
    index = PositionIndex([w for _, w in indexed], 0 if by_end else half)
    for word in asked:
        start, stop = (0, half + len(word) - size) if by_end else (half, len(word))
        near, equal = (index.near_of_shorter if len(word) == size else index.near_of_longer)(word, start, stop)
        if by_end:
            near &= ~equal
        if near:
            n, best = indexed[(near & -near).bit_length() - 1]
            yield word, near.bit_count(), n, best


def cells(words: DataFrame) -> DataFrame:
    """The rows of each cell (`size`, `by_end`, `half`, `own`, `other`): `word`, `n`, and whether it is `indexed` there or asked for."""
    length = F.length("word")
    halves = []
    for size in (length, length - 1):
        half = F.floor(size / 2).cast("int")
        for by_end, part in ((False, F.substr("word", F.lit(1), half)), (True, F.substr("word", length - size + half + 1))):
            halves.append(F.struct(size.alias("size"), F.lit(by_end).alias("by_end"), part.alias("half")))
    rows = words.select("word", "n", F.inline(F.array(*halves)))
    count = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("word")) / LETTERS))
    big = checkpoint(rows.groupBy("size", "by_end", "half").agg(count.alias("blocks")).filter("blocks > 1"))
    rows = rows.join(small(big, BIG_GROUPS), ["size", "by_end", "half"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), "blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    meets = F.array(F.transform(every, lambda b: F.struct(F.col("block").alias("own"), b.alias("other"), F.lit(True).alias("indexed"))), F.transform(every, lambda b: F.struct(b.alias("own"), F.col("block").alias("other"), F.lit(False).alias("indexed"))))
    return rows.select("size", "by_end", "half", "word", "n", F.inline(F.flatten(meets)))


def near_words(words: DataFrame) -> DataFrame:
    """For each of the `words` (`word`, `n`) that has any: `n_near`, and `best` (`n`, `word`) of its near words, the most frequent, of several the least."""
    parts = ["size", "by_end", "half", "own", "other"]
    rows = cells(words).repartition(*parts).sortWithinPartitions(*parts, F.desc("indexed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, indexed, asked = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            if indexed and asked:
                near = list(near_in_cell(cell[0], cell[1], indexed, asked))
                if near:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*near), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "n", "best"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*parts, "indexed", "word", "n")]
            for *own, is_indexed, word, n in zip(*columns):
                if own != cell:
                    yield from found()
                    cell, indexed, asked = own, [], []
                if is_indexed:
                    indexed.append((n, word))
                else:
                    asked.append(word)
        yield from found()

    found = rows.mapInArrow(run, "word string, n_near bigint, n bigint, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("best").alias("word"))).alias("best")).select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), "best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """`word` and `root`, the last of its chain of forms, for rows (`word`, `form`) without circles."""
    known = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = checkpoint(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if known.filter("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """For each row of `words` (`word`, `n`): `form`, `root`, `n`, `n_near` and `form_n`."""
    words = checkpoint(words.select("word", "n"))
    near = words.join(near_words(words), "word", "left")
    taken = F.col("best.n") >= ratio * F.col("n")
    found = checkpoint(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, F.col("best.n")).alias("form_n")))
    last = roots(found.filter("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
