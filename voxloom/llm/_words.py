"""Words of texts as arrays of 32-bit hashes, and bounded edit distances between them."""

from __future__ import annotations

import zlib

import numpy as np

#: Marks of ASCII count as spaces; all other bytes stay.
WORD_BYTES = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text: what stands between spaces and marks of ASCII."""
    return (text or "").lower().encode("utf-8", "replace").translate(WORD_BYTES).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values spread over their whole range."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words from each position on; of all words where there are fewer."""
    k = min(k, len(words))
    if not k:
        return np.empty(0, np.uint64)
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i]
    return mixed(h)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Words that both have, each as often as in the one that has it less often."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.minimum(n, m[spot])[y[spot] == x].sum())


BLOCK = np.arange(16)
#: Columns of a bit-parallel alignment that take about as long as one more edit along the diagonals.
COLUMNS_AN_EDIT = 12


def columnwise(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The edit distance, or None if it is over `limit`, from differences of neighbouring cells kept as bits, a column for each word of the shorter."""
    if len(a) < len(b):
        a, b = b, a
    spots: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        spots[word] = spots.get(word, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = full, 0, len(a), len(b)
    for word in b.tolist():
        same = spots.get(word, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        left -= 1
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        if score - left > limit:
            return None
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(same | down | more)) & full, more & (same | down) & full
    return score if score <= limit else None


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The edit distance of two arrays of words, or None if it is over `limit`.

    Banded alignment: of the diagonals within `limit` of the main one, it keeps how far each
    is reached with 0, 1, 2, ... edits. Texts that are still apart after as many edits as cost
    less than all columns are aligned column by column instead.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    start = n if same.all() else int(same.argmin())
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    end = n if same.all() else int(same.argmin())
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a) or not len(b):
        return max(len(a), len(b)) if max(len(a), len(b)) <= limit else None
    if max(len(a), len(b)) - shared(a, b) > limit:
        return None
    n, m = len(a), len(b)
    left = np.concatenate([a.astype(np.int64), np.full(len(BLOCK), -1)])
    right = np.concatenate([b.astype(np.int64), np.full(len(BLOCK), -2)])

    def slide(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Each row as far down its diagonal as words are equal."""
        todo = np.flatnonzero((x < n) & (x + k < m) & (x + k >= 0) & (x >= 0))
        todo = todo[left[x[todo]] == right[(x + k)[todo]]]
        while len(todo):
            same = left[x[todo, None] + BLOCK] == right[(x + k)[todo, None] + BLOCK]
            ran = np.where(same.all(1), len(BLOCK), same.argmin(1))
            x[todo] += ran
            todo = todo[ran == len(BLOCK)]
        return x

    k = np.array([0])
    reached = slide(np.array([0]), k)
    most = min(limit, min(n, m) // COLUMNS_AN_EDIT)
    for edits in range(1, most + 1):
        k = np.arange(max(-edits, -n), min(edits, m) + 1)
        low = k[0] - 1
        before = np.full(len(k) + 2, -1 << 40)
        first = max(-(edits - 1), -n)
        before[first - low : first - low + len(reached)] = reached
        new = np.maximum(np.maximum(before[1:-1] + 1, before[:-2]), before[2:] + 1)
        new = np.minimum(np.minimum(new, n), m - k)
        reached = slide(new, k)
        goal = m - n - k[0]
        if 0 <= goal < len(k) and reached[goal] >= n:
            return edits
    return columnwise(a, b, limit) if most < limit else None
