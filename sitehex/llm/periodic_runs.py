"""Runs of repeated word sequences in documents, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal) of at least
``max(MIN_WORDS, 2 * q)`` words that no neighbouring word extends. The documents of a batch are laid end to end, words of
different documents count as different, and then, for all of them at once:

1. Prefix doubling names the stretches of 1, 2, 4, .. words from every position until no two names are equal, and so
   yields the suffix array. A longest common extension to either side is a walk down the lengths of these names.
2. Blocks of ``2^k`` words at regular distances look for their own next occurrences in a neighbouring window: a run of
   period ``q`` holds a block of about ``q / 4`` to ``q / 2`` words whose copy ``q`` words on lies in the run as well. The
   occurrences of a block are an interval of the suffix array, and the next one from a position is a range successor
   in a wavelet tree over that array.
3. Occurrences no further apart than half a block form an arithmetic progression, as long as the stretch keeps that
   period. A progression that the block is itself part of has that shorter period, and is left to it; any other one
   gives its terms as candidate periods.
4. A candidate is extended to both sides. What reaches two periods is a run; of equal stretches the smallest period stays.

Documents never leave their partition. A task holds about ``WORDS_AT_ONCE`` words at a time, or one document if that is
longer; candidates number at most two a word and block length.

Rows: one for every input row, repeated and null ids included. Null, empty or blank texts have no words and no run; very
long texts are taken whole. Only the named columns are read, so others may be called anything. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.llm.common import Ids, batch

MIN_WORDS = 12

WORDS_AT_ONCE = 1 << 18

# Blocks of this many words, two apart, meet every run of at most 14 words' period: it holds 6 words or more whose
# copies lie in it as well.
LEAST_BLOCK = 4

Edit = Callable[[object, list[bytes]], list[bytes]]


class Names:
    """Names of the stretches of 2^k words of a sequence, and its suffix array where words repeat.

    ``levels[k][i]`` is the place, in the order of all suffixes, of the first one that shares its ``2^k`` words with the
    suffix at ``i``; equal names are equal words.
    """

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        order = np.argsort(words, kind="stable")
        rank = self._places(words[order], np.empty(n, np.int64), order, np.zeros(n, np.int64))
        self.levels = [rank.astype(np.int32)]
        width = 1
        while True:
            sizes = np.bincount(rank, minlength=n)
            open_ = np.flatnonzero(sizes[rank] > 1)
            if 1 << len(self.levels) == 2 * LEAST_BLOCK:
                shared = open_
            if not len(open_):
                break
            ahead = open_ + width
            after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
            key = rank[open_] * (n + 1) + after
            by = np.argsort(key, kind="stable")
            at = open_[by]
            rank = self._places(key[by], rank.copy(), at, rank[at])
            self.levels.append(rank.astype(np.int32))
            width *= 2
        # Suffixes whose first LEAST_BLOCK words occur again, in suffix order.
        if len(self.levels) <= LEAST_BLOCK.bit_length() - 1:
            shared = np.empty(0, np.int64)
        self.suffixes = shared[np.argsort(rank[shared], kind="stable")]

    @staticmethod
    def _places(key: np.ndarray, rank: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Give the positions ``at``, sorted by ``key``, their places: the base of their group and their place in it."""
        if len(key):
            fresh = np.r_[True, key[1:] != key[:-1]]
            group = np.r_[True, base[1:] != base[:-1]]
            index = np.arange(len(key))
            rank[at] = base + np.maximum.accumulate(np.where(fresh, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        return rank

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on are equal; ``i < j``."""
        n = len(self.levels[0])
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            jj = j + length
            same = (jj < n) & (names[np.minimum(i + length, n - 1)] == names[np.minimum(jj, n - 1)])
            length += same.astype(np.int64) << k
        return length

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before ``i`` and before ``j`` are equal; ``i < j``."""
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[k], 1 << k
            ii = i - length - width
            same = (ii >= 0) & (names[np.maximum(ii, 0)] == names[np.maximum(j - length - width, 0)])
            length += same.astype(np.int64) << k
        return length


class WaveletTree:
    """Numbers below ``2^bits``, asked for the smallest one from a bound on within an interval of places."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.zeros: list[np.ndarray] = []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit) & 1
            self.zeros.append(np.r_[0, np.cumsum(1 - one)])
            values = np.r_[values[one == 0], values[one == 1]]

    def successor(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Smallest value of at least ``bound`` in places ``left`` to ``right`` (exclusive); -1 where there is none."""
        smaller = np.zeros(len(left), np.int64)
        lo, hi = left, right
        for level, zeros in enumerate(self.zeros):
            one = (bound >> (self.bits - 1 - level)) & 1 == 1
            z_lo, z_hi = zeros[lo], zeros[hi]
            smaller += np.where(one, z_hi - z_lo, 0)
            lo = np.where(one, zeros[-1] + lo - z_lo, z_lo)
            hi = np.where(one, zeros[-1] + hi - z_hi, z_hi)
        found = (smaller < right - left) & (bound < 1 << self.bits)
        wanted = np.where(found, smaller, 0)
        lo, hi = left, right
        value = np.zeros(len(left), np.int64)
        for zeros in self.zeros:
            z_lo, z_hi = zeros[lo], zeros[hi]
            one = wanted >= z_hi - z_lo
            wanted = np.where(one, wanted - (z_hi - z_lo), wanted)
            lo = np.where(one, zeros[-1] + lo - z_lo, z_lo)
            hi = np.where(one, zeros[-1] + hi - z_hi, z_hi)
            value = value * 2 + one
        return np.where(found, value, -1)


def _expand(start: np.ndarray, step: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The terms of all progressions, one progression after another."""
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(start, count) + nth * np.repeat(step, count)


def _candidates(names: Names, tree: WaveletTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of ``2^k`` words with a copy of themselves in their window: positions of the block and of the copy."""
    width = 1 << k
    level = names.levels[k]
    least = width == LEAST_BLOCK
    stride = width // 2 if least else width
    repeated = names.suffixes[names.suffixes % stride == 0]
    in_order = level[names.suffixes]
    left = np.searchsorted(in_order, level[repeated], "left")
    right = np.searchsorted(in_order, level[repeated], "right")
    block = repeated[right - left > 1]
    left, right = left[right - left > 1], right[right - left > 1]
    # Periods 1 to 14 for the least blocks, 2 to nearly 4 widths for the others.
    bound = block + (1 if least else 2 * width - 1)
    last = block + 4 * width - 2
    found: list[tuple[np.ndarray, np.ndarray]] = []
    first = tree.successor(left, right, bound)
    while True:
        keep = (first >= 0) & (first <= last)
        block, left, right, last, first = block[keep], left[keep], right[keep], last[keep], first[keep]
        if not len(block):
            break
        second = tree.successor(left, right, first + 1)
        step = second - first
        single = (second < 0) | (step > width // 2) | least
        found.append((block[single], first[single]))
        s = ~single
        if s.any():
            a, d, b = first[s], step[s], block[s]
            end = second[s] + names.forward(a, second[s])
            terms = (end - width - a) // d
            own = a - names.backward(a, second[s]) <= b
            count = np.where(own, 0, np.minimum(terms, (last[s] - a) // d) + 1)
            found.append((np.repeat(b, count), _expand(a, d, count)))
            second[s] = tree.successor(left[s], right[s], a + terms * d + 1)
        first = second
    blocks, copies = zip(*found) if found else ((), ())
    return np.concatenate([np.empty(0, np.int64), *blocks]), np.concatenate([np.empty(0, np.int64), *copies])


def find_runs(words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of a sequence of numbers, by start and period.

    ``min_words`` below 12 would need smaller blocks.
    """
    if min_words < MIN_WORDS:
        raise ValueError(f"runs of fewer than {MIN_WORDS} words are not looked for")
    none = np.empty(0, np.int64)
    if len(words) < min_words:
        return none, none, none
    names = Names(words)
    if not len(names.suffixes):
        return none, none, none
    tree = WaveletTree(names.suffixes, len(words).bit_length())
    starts, lengths, periods = [none], [none], [none]
    for k in range(LEAST_BLOCK.bit_length() - 1, len(names.levels)):
        block, copy = _candidates(names, tree, k)
        period = copy - block
        before = names.backward(block, copy)
        length = before + period + names.forward(block, copy)
        is_run = length >= np.maximum(min_words, 2 * period)
        starts.append((block - before)[is_run])
        lengths.append(length[is_run])
        periods.append(period[is_run])
    start, length, period = np.concatenate(starts), np.concatenate(lengths), np.concatenate(periods)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # The same stretch may be found by several blocks and at multiples of its period.
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _digest(parts: Iterable[bytes]) -> str:
    return hashlib.sha256(b"".join(parts)).hexdigest()


def _answers(held: list[tuple[object, list[bytes]]], min_words: int) -> Iterator[tuple]:
    """The result rows of some documents, whose runs are sought all at once."""
    sizes = np.array([len(words) for _, words in held], np.int64)
    ends = np.cumsum(sizes)
    ids = np.empty(int(sizes.sum()), np.int64)
    base = 0
    for (_, words), end, size in zip(held, ends, sizes):
        known = Ids()
        ids[end - size : end] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        ids[end - size : end] += base
        base += len(known)
    start, length, period = find_runs(ids, min_words)
    # A word is dropped where more dropped stretches have begun than ended.
    change = np.bincount(start + period, minlength=len(ids) + 1) - np.bincount(start + length, minlength=len(ids) + 1)
    dropped = np.cumsum(change) > 0
    lo, hi = np.searchsorted(start, ends - sizes), np.searchsorted(start, ends)
    for i, (key, words) in enumerate(held):
        begin = int(ends[i] - sizes[i])
        if lo[i] == hi[i]:
            yield key, 0, None, None, None, None, _digest(()), _digest((b" ".join(words),))
            continue
        s, n, q = (a[lo[i] : hi[i]] for a in (start, length, period))
        s = s - begin
        top = np.lexsort((q, s, -n))[0]
        kept = np.flatnonzero(~dropped[begin : begin + len(words)]).tolist()
        lines = (b"%d,%d,%d\n" % line for line in zip(s.tolist(), n.tolist(), q.tolist()))
        yield (
            key, len(s), int(s[top]), int(n[top]), int(q[top]), int(1000 * n[top] // q[top]),
            _digest(lines), _digest((b" ".join([words[k] for k in kept]),)),
        )


def periodic_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, edit: Edit | None = None
) -> DataFrame:
    """Per row: number of runs, the longest one (ties: first, then shortest period), and digests of all runs and of the
    words that stay when of each run only the first period is kept.

    Words are what lies between spaces and the ASCII characters 9 to 13. ``edit`` may change the words of a row before.
    """
    key = df.schema[id_col].dataType
    out = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    names = [id_col, *[f.split()[0] for f in out.split(", ")]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, list[bytes]]] = []
        held_words = 0
        id_type = pa.null()

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                columns = list(zip(*_answers(held, min_words)))
                types = [id_type, *[pa.int64()] * 5, pa.string(), pa.string()]
                yield batch((name, pa.array(c, t)) for name, c, t in zip(names, columns, types))

        for b in batches:
            id_type = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if edit is not None:
                    words = edit(key, words)
                held.append((key, words))
                held_words += len(words) + 1
                if held_words >= WORDS_AT_ONCE:
                    yield from flush()
                    held, held_words = [], 0
        yield from flush()

    picked = df.select(F.col(id_col), F.col(text_col).cast("string"))
    return picked.mapInArrow(rows, f"`{id_col}` {key.simpleString()}, {out}")
