"""Arrow functions over pairs of word lists: distances, breakdowns, opcodes and orders of speakers.

A column of the table of edit distances is kept as two whole numbers, whose bits say where the
distance grows or falls from one word of the first list to the next. A column follows from the one
before by a few operations on these numbers, so that lists of 20,000 words need no table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions import text as tx
from voxloom.functions.udf import arrow, arrow_arrays

#: Columns whose numbers are held at a time on the way back; of all others, one in so many is.
KEPT = 256
#: Bits of a column times columns that are held at once where that is more than KEPT columns: some 40 MB, as a column is five whole numbers.
KEPT_BITS = 64_000_000
#: Pairs of words up to which the longest block is found word by word.
FEW = 1 << 18
#: Words of the lists that are aligned together, and the equal windows of two lists up to which they are aligned with others.
WORDS, TOGETHER = 1 << 14, 1 << 17
#: Words of the windows by which blocks are found first: few windows come again, and what is left between the blocks is short.
WINDOW = 4


class Edge(NamedTuple):
    """A column: where the distance grows and falls, and its value at the end of the first list."""

    up: int
    down: int
    score: int


class Table:
    """Edit distances of the beginnings of one list and of others."""

    def __init__(self, words: Sequence[str]):
        self.n = len(words)
        self.full = (1 << self.n) - 1
        self.last = 1 << self.n >> 1
        self.spots: dict[str, int] = {}
        for i, word in enumerate(words):
            self.spots[word] = self.spots.get(word, 0) | 1 << i

    def first(self) -> Edge:
        return Edge(self.full, 0, self.n)

    def steps(self, at: Edge, words: Sequence[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """For each word: growth and fall along the column, growth and fall since the column before, and the value at the end."""
        up, down, score = at
        spots, full, last = self.spots, self.full, self.last
        for word in words:
            same = spots.get(word, 0)
            across = (((same & up) + up) ^ up) | same
            more, less = down | (full & ~(across | up)), up & across
            if not last:
                score += 1
            elif more & last:
                score += 1
            elif less & last:
                score -= 1
            more, less = more << 1 | 1, less << 1
            up, down = (less | ~(same | down | more)) & full, more & (same | down) & full
            yield up, down, more, less, score

    def after(self, at: Edge, words: Sequence[str]) -> Edge:
        for up, down, _, _, score in self.steps(at, words):
            at = Edge(up, down, score)
        return at


def distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Words to change, add or leave out; equal beginnings and ends cost nothing."""
    a, b = list(a), list(b)
    most = min(len(a), len(b))
    end = 0
    while end < most and a[-1 - end] == b[-1 - end]:
        end += 1
    start = 0
    while start < most - end and a[start] == b[start]:
        start += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    table = Table(a)
    return table.after(table.first(), b).score


def path(a: Sequence[str], b: Sequence[str]) -> str:
    """The fewest edits from `a` to `b`, from first to last: `=` the same, `s` another word, `i` a word more, `d` a word less.

    Of several ways the one is taken that, read from the end, keeps words as early as it can, then
    changes, then adds them.
    """
    a, b = list(a), list(b)
    end, most = 0, min(len(a), len(b))
    while end < most and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    table = Table(a)
    kept = max(KEPT, KEPT_BITS // (len(a) + 1))
    edges = [table.first()]
    for j in range(kept, len(b), kept):
        edges.append(table.after(edges[-1], b[j - kept : j]))
    out: list[str] = ["="] * end
    i, j = len(a), len(b)
    columns: list[tuple[int, int, int, int, int]] = []
    held = len(b)
    while i and j:
        if j <= held:
            k = (j - 1) // kept
            held = k * kept
            columns = list(table.steps(edges[k], b[held : held + kept]))
        if a[i - 1] == b[j - 1]:
            out.append("=")
            i, j = i - 1, j - 1
            continue
        up, down, more, less, _ = columns[j - 1 - held]
        here, above = i - 1, i - 1
        grown = (up >> here & 1) - (down >> here & 1) + (more >> above & 1) - (less >> above & 1)
        if grown == 1:
            out.append("s")
            i, j = i - 1, j - 1
        elif more >> i & 1:
            out.append("i")
            j -= 1
        else:
            out.append("d")
            i -= 1
    return "i" * j + "d" * i + "".join(reversed(out))


class Windows:
    """Numbers for the windows of two lists of words: two windows of a length are equal if they have the same number.

    Windows of 1, 2, 4, ... words are numbered in turn, from the numbers of their halves; a window of any other length is the pair of the two longest
    of these at its ends.
    """

    def __init__(self, a: Sequence[str], b: Sequence[str]):
        known: dict[str, int] = {}
        both = [known.setdefault(w, len(known)) for w in (*a, *b)]
        self.cut, self.levels = len(a), [np.array(both, np.int64)]

    def numbers(self, length: int, low: int, high: int, second: bool) -> np.ndarray:
        """The numbers of the windows of `length` inside the words from `low` to before `high` of the first list, or of the `second`."""
        k = length.bit_length() - 1
        while len(self.levels) <= k:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            pairs = last[: max(0, len(last) - step)] * (1 << 31) + last[step:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1])
        shift = self.cut if second else 0
        start, count = low + shift, high - low - length + 1
        level, rest = self.levels[k], length - (1 << k)
        return level[start : start + count] if not rest else level[start : start + count] * (1 << 31) + level[start + rest : start + rest + count]

    def longest(self, a1: int, a2: int, b1: int, b2: int, most: int) -> int:
        """The length of the longest common window, up to `most`."""
        low, high = 0, min(most, a2 - a1, b2 - b1)
        step = 1
        while low < high:
            length = min(low + step, high)
            if np.isin(self.numbers(length, a1, a2, False), self.numbers(length, b1, b2, True)).any():
                low, step = length, step * 2
            else:
                high, step = length - 1, max(1, (length - low) // 2)
                step = min(step, max(1, (high - low + 1) // 2))
        return low


def longest_of_few(a: list, a1: int, a2: int, spots: dict[str, list[int]]) -> tuple[int, int, int]:
    """The longest common block as (words, start in `a`, start in `b`), from how long the runs that end at each word of `b` are; `spots` has the places of each word of `b`."""
    best, ending = (0, a1, 0), {}
    for i in range(a1, a2):
        here = {}
        for j in spots.get(a[i], ()):
            n = here[j] = ending.get(j - 1, 0) + 1
            if n > best[0]:
                best = (n, i - n + 1, j - n + 1)
        ending = here
    return best


def common_blocks(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int, int]]:
    """Blocks (start in `a`, start in `b`, words) that both lists share in the same order, longest first.

    The longest common block is taken, of several the first in `a`, then the first in `b`; what stands before and behind it is treated likewise.
    Blocks that touch in both lists are one. All blocks of a length that follow each other are found in one pass, and what is left between them
    has shorter ones only.
    """
    a, b = list(a), list(b)
    windows, found, todo = None, [], [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while todo:
        a1, a2, b1, b2, most = todo.pop()
        if a1 == a2 or b1 == b2 or not most:
            continue
        if (a2 - a1) * (b2 - b1) <= FEW:
            spots: dict[str, list[int]] = {}
            for j in range(b1, b2):
                spots.setdefault(b[j], []).append(j)
            n, i, j = longest_of_few(a, a1, a2, spots)
            if n:
                found.append((i, j, n))
                todo += [(a1, i, b1, j, n - 1), (i + n, a2, j + n, b2, n)]
            continue
        windows = windows or Windows(a, b)
        blocks, x, y = blocks_of_length(windows, a1, a2, b1, b2, most), a1, b1
        if not blocks:
            continue
        found += blocks
        for i, j, n in blocks:
            todo.append((x, i, y, j, n - 1))
            x, y = i + n, j + n
        todo.append((x, a2, y, b2, n - 1))
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


class Blocks(NamedTuple):
    """Common blocks of many pairs of lists: the pair's number, starts in both lists, and words; sorted by pair and place."""

    pair: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n: np.ndarray


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def windows_of(words: np.ndarray, own: np.ndarray, kinds: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of `length` words inside their lists (`own` has the list of each word), and the number of each window; `kinds ** length` is under 2 ** 63."""
    last = max(0, len(words) - length + 1)
    at = np.flatnonzero(own[:last] == own[length - 1 :][:last])
    number = words[at]
    for k in range(1, length):
        number = number * kinds + words[at + k]
    return at, number


def equal_windows(a: np.ndarray, a_own: np.ndarray, b: np.ndarray, b_own: np.ndarray, pairs: int, length: int) -> tuple[np.ndarray, ...]:
    """Places in `a` of the windows that `b` has too, their pairs, where those of `b` stand in the order of `at`, and how many each pair has."""
    kinds, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    while len(kinds) ** length >= 1 << 63:
        length -= 1
    (i, x), (j, y) = (windows_of(w, own, len(kinds), length) for w, own in ((both[: len(a)], a_own), (both[len(a) :], b_own)))
    kinds, both = np.unique(np.concatenate([x, y]), return_inverse=True)
    ours, theirs = a_own[i] * len(kinds) + both[: len(x)], b_own[j] * len(kinds) + both[len(x) :]
    order = np.argsort(theirs, kind="stable")
    ranked = theirs[order]
    low, high = np.searchsorted(ranked, ours, "left"), np.searchsorted(ranked, ours, "right")
    return i, low, high - low, j[order], np.bincount(a_own[i], high - low, pairs).astype(np.int64), length


def runs_of_windows(i: np.ndarray, low: np.ndarray, count: np.ndarray, at: np.ndarray, own: np.ndarray, size: int, length: int) -> tuple[np.ndarray, ...]:
    """All runs of equal words, as long as they go, of `length` words at least: pair, place in `a`, place in `b`, words. Pairs stand one place apart."""
    x, y = np.repeat(i, count), at[ranges(low, count)]
    pair = own[x]
    x, y = x + pair, y + pair
    by = np.argsort((y - x + size) * np.int64(2 * size + 2) + x, kind="stable")
    x, y, pair = x[by], y[by], pair[by]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 1) | (np.diff(y) != 1)])) if len(x) else np.zeros(0, np.int64)
    return pair[starts], x[starts], y[starts], np.diff(np.append(starts, len(x))) + length - 1


def blocks_of_runs(own: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Pair, places in `a` and `b` and length of the blocks of `common_blocks` of `least` words and more, for many pairs at once.

    Of the runs of each stretch the longest is a block; the others are cut to what is before it or behind it in both lists, which are the next stretches.
    """
    order = np.argsort(own, kind="stable")
    own, x, y, n = own[order], x[order], y[order], n[order]
    part, found = own, []
    while len(n):
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.append(starts, len(n)))
        longest = np.maximum.reduceat(n, starts)
        first = np.minimum.reduceat(np.where(n == np.repeat(longest, sizes), x << 31 | y, np.iinfo(np.int64).max), starts)
        i, j = first >> 31, first & ((1 << 31) - 1)
        found.append((own[starts], i, j, longest))
        number = np.repeat(np.arange(len(starts)), sizes)
        i, j, ends = i[number], j[number], longest[number]
        left = np.minimum(n, np.minimum(i - x, j - y))
        skip = np.maximum(0, np.maximum(i + ends - x, j + ends - y))
        before = left > 0
        x, y, n = np.where(before, x, x + skip), np.where(before, y, y + skip), np.where(before, left, n - skip)
        part = 2 * number + ~before
        order = np.flatnonzero(n >= least)
        order = order[np.argsort(part[order], kind="stable")]
        part, own, x, y, n = part[order], own[order], x[order], y[order], n[order]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    pair, i, j, n = map(np.concatenate, zip(*found))
    return pair, i - pair, j - pair, n


def blocks_together(a: np.ndarray, b: np.ndarray, todo: np.ndarray, length: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of `length` words and more in stretches of pairs, given as rows (pair, from, to, from, to), as rows (stretch, place, place, words), and the stretches with over `most` equal windows."""
    found, many = [np.zeros((0, 4), np.int64)], [np.zeros(0, np.int64)]
    sizes = np.cumsum(todo[:, 2] - todo[:, 1] + todo[:, 4] - todo[:, 3])
    first = 0
    while first < len(todo):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + WORDS, "right")))
        own = todo[first:last]
        number, ours, theirs = np.arange(len(own)), own[:, 2] - own[:, 1], own[:, 4] - own[:, 3]
        a_own, b_own = np.repeat(number, ours), np.repeat(number, theirs)
        i, low, count, at, met, used = equal_windows(a[ranges(own[:, 1], ours)], a_own, b[ranges(own[:, 3], theirs)], b_own, len(own), length)
        heavy = met > most
        count = np.where(heavy[a_own[i]], 0, count)
        runs = runs_of_windows(i, low, count, at, a_own, len(a_own) + len(b_own) + len(own), used)
        kept = runs[3] >= length
        pair, i, j, n = blocks_of_runs(*(c[kept] for c in runs), length)
        i, j = i - (np.cumsum(ours) - ours)[pair] + own[pair, 1], j - (np.cumsum(theirs) - theirs)[pair] + own[pair, 3]
        found.append(np.stack([pair + first, i, j, n], 1))
        many.append(np.flatnonzero(heavy) + first)
        first = last
    return np.concatenate(found), np.concatenate(many)


def split_by_windows(a: np.ndarray, b: np.ndarray, todo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (pair, place, place, words) of stretches with many equal words, and the short stretches between them."""
    found, short = [np.zeros((0, 4), np.int64)], [np.zeros((0, 5), np.int64)]
    for k, a1, a2, b1, b2 in todo.tolist():
        blocks, rest = stretches(a[a1:a2], b[b1:b2])
        found.append(np.array([(k, a1 + i, b1 + j, n) for i, j, n in blocks], np.int64).reshape(-1, 4))
        short.append(np.array([(k, a1 + s, a1 + t, b1 + u, b1 + v) for s, t, u, v in rest], np.int64).reshape(-1, 5))
    return np.concatenate(found), np.concatenate(short)


def stretches(a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Blocks of two long lists, as far as windows find them, and the stretches between them that are short."""
    windows, found, short, todo = Windows(a.tolist(), b.tolist()), [], [], [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while todo:
        a1, a2, b1, b2, most = todo.pop()
        if a1 == a2 or b1 == b2 or not most:
            continue
        if (a2 - a1) * (b2 - b1) <= FEW:
            short.append((a1, a2, b1, b2))
            continue
        blocks = blocks_of_length(windows, a1, a2, b1, b2, most)
        found += blocks
        x, y = a1, b1
        for i, j, n in blocks:
            todo.append((x, i, y, j, n - 1))
            x, y = i + n, j + n
        if blocks:
            todo.append((x, a2, y, b2, blocks[0][2] - 1))
    return found, short


def blocks_of_length(windows: Windows, a1: int, a2: int, b1: int, b2: int, most: int) -> list[tuple[int, int, int]]:
    """The longest common blocks of a stretch that follow each other, the first in `a` first, then the first in `b`."""
    length = windows.longest(a1, a2, b1, b2, most)
    if not length:
        return []
    ours, theirs = windows.numbers(length, a1, a2, False), windows.numbers(length, b1, b2, True)
    spots = np.flatnonzero(np.isin(ours, theirs))
    order = np.argsort(theirs, kind="stable")
    ranked = theirs[order]
    lows, highs = (np.searchsorted(ranked, ours[spots], side).tolist() for side in ("left", "right"))
    order, x, y, found = order.tolist(), a1, b1, []
    for spot, low, high in zip(spots.tolist(), lows, highs):
        if a1 + spot < x:
            continue
        at = bisect_left(order, y - b1, low, high)
        if at == high:
            continue
        found.append((a1 + spot, b1 + order[at], length))
        x, y = a1 + spot + length, b1 + order[at] + length
    return found


def many_blocks(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Blocks:
    """`common_blocks` of many pairs of lists of numbers; the lists stand behind each other, list k from `ends[k]` to `ends[k + 1]`.

    Blocks of WINDOW words and more come first, then shorter ones between them. Pairs with very many equal windows are split by `stretches`.
    """
    pairs = np.arange(len(a_ends) - 1)
    todo = np.stack([pairs, a_ends[:-1], a_ends[1:], b_ends[:-1], b_ends[1:]], 1)
    todo = todo[(todo[:, 1] < todo[:, 2]) & (todo[:, 3] < todo[:, 4])]
    blocks, many = blocks_together(a, b, todo, WINDOW, TOGETHER)
    blocks[:, 0] = todo[blocks[:, 0], 0]
    light = np.delete(todo, many, 0)
    edges = np.concatenate([np.stack([light[:, 0], light[:, 1], light[:, 3], light[:, 1] * 0], 1), blocks, np.stack([light[:, 0], light[:, 2], light[:, 4], light[:, 1] * 0], 1)])
    edges = edges[np.lexsort((np.repeat([0, 1, 2], [len(light), len(blocks), len(light)]), edges[:, 1], edges[:, 0]))]
    gaps = np.stack([edges[:-1, 0], edges[:-1, 1] + edges[:-1, 3], edges[1:, 1], edges[:-1, 2] + edges[:-1, 3], edges[1:, 2]], 1)[edges[:-1, 0] == edges[1:, 0]]
    split, short = split_by_windows(a, b, todo[many])
    todo = np.concatenate([gaps, short])
    todo = todo[(todo[:, 1] < todo[:, 2]) & (todo[:, 3] < todo[:, 4])]
    found = [blocks, split]
    for most in (TOGETHER, np.inf):
        blocks, many = blocks_together(a, b, todo, 1, most)
        blocks[:, 0] = todo[blocks[:, 0], 0]
        split, todo = split_by_windows(a, b, todo[many])
        found += [blocks, split]
    found = np.concatenate(found)
    pair, i, j, n = found[np.lexsort((found[:, 1], found[:, 0]))].T
    i, j = i - a_ends[pair], j - b_ends[pair]
    starts = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (i[1:] != i[:-1] + n[:-1]) | (j[1:] != j[:-1] + n[:-1])])[: len(n)])
    return Blocks(pair[starts], i[starts], j[starts], np.add.reduceat(n, starts) if len(n) else n)


def opcodes(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, int, int, int, int]]:
    """Stretches of both lists: equal, as in `common_blocks`, or replace, delete or insert between them."""
    out, i, j = [], 0, 0
    for x, y, n in [*common_blocks(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if n:
            out.append(("equal", x, x + n, y, y + n))
        i, j = x + n, y + n
    return out


def breakdown(ref: Sequence[str], hyp: Sequence[str]) -> tuple[int, int, int]:
    """Substitutions, insertions and deletions."""
    way = path(ref, hyp)
    return way.count("s"), way.count("i"), way.count("d")


@arrow("int")
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words to change, add or leave out; null where a list is."""
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def native_edit_distance(a: Column, b: Column) -> Column:
    """The same as an expression, for short lists and as a cross-check: a fold over `a` of a fold over `b`."""
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda i: i)

    def row(before: Column, word: Column) -> Column:
        start = F.array(F.get(before, 0) + 1)
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            start,
            lambda out, j: F.concat(out, F.array(F.least(F.get(before, j) + 1, F.element_at(out, -1) + 1, F.get(before, j - 1) + F.when(F.get(b, j - 1) == word, 0).otherwise(1)))),
        )

    return F.when(F.size(b) == 0, F.size(a)).otherwise(F.element_at(F.aggregate(a, first, row), -1))


@arrow("subs int, ins int, dels int, ref_words int")
def error_breakdown(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Null lists count as empty ones."""
    rows = [(*breakdown(x if x is not None else (), y if y is not None else ()), 0 if x is None else len(x)) for x, y in zip(ref, hyp)]
    return pd.DataFrame(rows, columns=["subs", "ins", "dels", "ref_words"], dtype="int32")


def numbered_lists(*lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each array of lists its words as numbers, equal words by equal ones, and where the lists end; a null list is empty."""
    flat = [x.flatten() for x in lists]
    codes = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.cumsum([0, *map(len, flat)])
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    return [(codes[cuts[k] : cuts[k + 1]], np.concatenate([[0], np.cumsum(s)])) for k, s in enumerate(sizes)]


#: What stretches are called, by number.
TAGS = ("equal", "replace", "delete", "insert")


def opcode_rows(a: pa.Array, b: pa.Array, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `opcodes` of pairs of lists where `both` is true, as pairs and rows (tag, from, to, from, to)."""
    (ours, a_ends), (theirs, b_ends) = numbered_lists(a, b)
    pairs = np.arange(len(a))
    pair, i, j, n = (np.concatenate(c) for c in zip(many_blocks(ours, a_ends, theirs, b_ends), (pairs, np.diff(a_ends), np.diff(b_ends), np.zeros(len(a), np.int64))))
    order = np.argsort(pair, kind="stable")
    pair, i, j, n = pair[order], i[order], j[order], n[order]
    fresh = np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)]
    x, y = (np.where(fresh, 0, np.concatenate([[0], (s + n)[:-1]])[: len(s)]) for s in (i, j))
    rows = np.stack([np.where((x < i) & (y < j), 1, np.where(x < i, 2, 3)), x, i, y, j, np.zeros_like(n), i, i + n, j, j + n], 1).reshape(-1, 5)
    kept = (np.stack([(x < i) | (y < j), n > 0], 1) & both[pair][:, None]).reshape(-1)
    return np.repeat(pair, 2)[kept], rows[kept].astype(np.int32)


@arrow_arrays("array<struct<tag:string,a1:int,a2:int,b1:int,b2:int>>")
def word_opcodes(a: pa.Array, b: pa.Array) -> pa.Array:
    """The stretches of `opcodes`; none where a list is null."""
    pair, rows = opcode_rows(a, b, pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False))
    ends = np.concatenate([[0], np.cumsum(np.bincount(pair, minlength=len(a)))]).astype(np.int32)
    tags = pa.array(TAGS).take(pa.array(rows[:, 0]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([tags, *map(pa.array, np.ascontiguousarray(rows[:, 1:].T))], ["tag", "a1", "a2", "b1", "b2"]))


def word_diff(a: Column | str, b: Column | str) -> Column:
    """How alike two lists are (twice their equal words, of all words), and what differs, to read."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    ops = word_opcodes(a, b)
    words = lambda x, i, j: F.array_join(F.slice(x, i + 1, j - i), " ")
    told = F.transform(F.filter(ops, lambda o: o["tag"] != "equal"), lambda o: F.concat(o["tag"], F.lit(": "), words(a, o["a1"], o["a2"]), F.lit(" -> "), words(b, o["b1"], o["b2"])))
    same = F.aggregate(F.filter(ops, lambda o: o["tag"] == "equal"), F.lit(0), lambda s, o: s + o["a2"] - o["a1"])
    total = F.size(a) + F.size(b)
    return F.struct(F.when(total > 0, 2.0 * same / total).otherwise(1.0).alias("ratio"), told.alias("ops"))


def non_number_distance(raw: Column | str, normalized: Column | str) -> Column:
    return edit_distance(tx.drop_numbers(tx.canonical_tokens(raw)), tx.drop_numbers(tx.canonical_tokens(normalized)))


def bits_of(number: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(number.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].astype(np.int32)


def values_of(at: Edge, n: int, first: int) -> np.ndarray:
    """The numbers of a column, from `first` on."""
    return first + np.concatenate([[0], np.cumsum(bits_of(at.up, n) - bits_of(at.down, n))])


def edge_of(values: np.ndarray) -> Edge:
    steps = np.diff(values)
    number = lambda flags: int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    return Edge(number(steps > 0), number(steps < 0), int(values[-1]))


class Orders:
    """Orders of `hyp` lists, one after the other, against all `ref` words.

    The distance to a list is the least over all ways through the table, and so is that of the best order of a set: the columns of a set's
    orders can be replaced by their least values, one column a set. Sets are grown from the end of the words, one list at a time; equal
    lists are one kind. A set is left where its column and a bound for what is before it exceed the distance of an order that
    is known: the words before it cost at least as many edits as the larger of both sides has words that the other lacks.
    """

    def __init__(self, ref: Sequence[Sequence[str]], hyp: Sequence[Sequence[str]]):
        n = max(len(ref), len(hyp))
        self.words = [w for r in ref for w in r]
        self.hyp = [list(h) for h in hyp] + [[]] * (n - len(hyp))
        self.ref = list(ref)
        self.kinds = sorted({tuple(h) for h in self.hyp}, key=lambda k: self.hyp.index(list(k)))
        self.kind_of = [self.kinds.index(tuple(h)) for h in self.hyp]
        self.counts = tuple(self.kind_of.count(k) for k in range(len(self.kinds)))
        self.bags = [Counter(k) for k in self.kinds]
        self.forward, self.backward = Table(self.words), Table(self.words[::-1])
        seen: Counter = Counter()
        self.copy = np.zeros(len(self.words), np.int64)
        for i, w in enumerate(self.words):
            self.copy[i] = seen[w]
            seen[w] += 1
        names = {w: k for k, w in enumerate(seen)}
        self.number = np.array([names[w] for w in self.words], np.int64)
        self.bag_rows = np.zeros((len(self.kinds), len(names)), np.int64)
        for k, bag in enumerate(self.bags):
            for w, c in bag.items():
                if w in names:
                    self.bag_rows[k, names[w]] = c
        self.sizes = np.array([len(k) for k in self.kinds], np.int64)

    def known(self) -> int:
        """The distance of the better of two orders: the one that is given, and one by the words each list shares with a reference."""
        left, greedy = list(range(len(self.hyp))), []
        for r in self.ref:
            bag = Counter(r)
            p = max(left, key=lambda p: (sum((bag & self.bags[self.kind_of[p]]).values()), -p))
            left.remove(p)
            greedy.append(p)
        return min(self.forward.after(self.forward.first(), [w for p in order for w in self.hyp[p]]).score for order in (range(len(self.hyp)), greedy + left))

    def before(self, rest: np.ndarray) -> np.ndarray:
        """For each beginning of the reference, the fewest edits to the lists in `rest`."""
        have = rest @ self.bag_rows
        both = np.concatenate([[0], np.cumsum(self.copy < have[self.number])])
        return np.maximum(np.arange(len(self.words) + 1), int(rest @ self.sizes)) - both

    def columns(self) -> dict[tuple[int, ...], np.ndarray]:
        """The column of each set that a best order may end with, by how many of each kind it has."""
        n, most, every = len(self.words), self.known(), np.array(self.counts)
        empty = (0,) * len(self.kinds)
        out = {empty: np.arange(n + 1)}
        layer = dict(out)
        for _ in self.hyp:
            grown: dict[tuple[int, ...], np.ndarray] = {}
            for have, values in layer.items():
                edge, size = edge_of(values), int(values[0])
                for k, c in enumerate(have):
                    if c < self.counts[k]:
                        more = (*have[:k], c + 1, *have[k + 1 :])
                        column = values_of(self.backward.after(edge, self.kinds[k][::-1]), n, size + len(self.kinds[k]))
                        grown[more] = column if more not in grown else np.minimum(grown[more], column)
            layer = {have: v for have, v in grown.items() if (v + self.before(every - np.array(have))[::-1]).min() <= most}
            out |= layer
        return out

    def best(self) -> list[int]:
        """The first order with the fewest errors."""
        columns = self.columns()
        most = int(columns[self.counts][-1])
        at, order, left = self.forward.first(), [], list(self.counts)
        size = 0
        while len(order) < len(self.hyp):
            for p, k in enumerate(self.kind_of):
                if p in order or any(q < p and self.kind_of[q] == k and q not in order for q in range(p)):
                    continue
                rest = (*left[:k], left[k] - 1, *left[k + 1 :])
                if rest not in columns:
                    continue
                after = self.forward.after(at, self.hyp[p])
                if (values_of(after, len(self.words), size + len(self.hyp[p])) + columns[rest][::-1]).min() == most:
                    at, left, size = after, list(rest), size + len(self.hyp[p])
                    order.append(p)
                    break
        return order


def best_order(ref: Sequence[Sequence[str]], hyp: Sequence[Sequence[str]]) -> tuple[int, int, int, int, int, list[int]]:
    """Errors, reference words, substitutions, insertions, deletions and the order of `hyp` with the fewest errors; the first of several.

    At most 2 ** n sets of n speakers are looked at, instead of all orders, and far fewer where lists are alike to their references.
    """
    orders = Orders(ref, hyp)
    best = orders.best()
    counts = breakdown(orders.words, [w for p in best for w in orders.hyp[p]])
    return sum(counts), len(orders.words), *counts, best


@arrow("errors int, ref_words int, subs int, ins int, dels int, best_perm array<int>")
def permuted_errors(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = [best_order(x, y) for x, y in zip(ref, hyp)]
    return pd.DataFrame(rows, columns=["errors", "ref_words", "subs", "ins", "dels", "best_perm"])
