"""Benchmark decontamination: rare n-gram seeds find candidates, Smith-Waterman alignment scores them.

At every word of a test item stands one seed: the shortest run of three or more words from there that at most
``RARE`` test items hold. A phrase common to many items is thus no seed by itself; it is read on until few items
are left, up to a quarter of the item's words. Rarity is counted among the items, never among the documents: an
edit destroys some seeds, and those that are left are as frequent in the corpus as the leak. So the work for a
document depends on its matches and hardly on the number of items.

A document that holds a seed of an item is a candidate if enough of the item's words stand near each other in
it to reach the least score. The words around the seeds are then aligned with the item by words: matches score
2, mismatches and gaps -1. The score is the best alignment over the best possible one, so an exact copy has 1 and
a copy with every fifth word replaced has about 0.7. A match is a score of ``least``, or an alignment worth
``PASSAGE_WORDS`` equal words, whatever the length of the item.

Test items are the stated query set. Seeds meet documents by a broadcast join in blocks of bounded items and
characters, tens of thousands of items in one pass. Documents are never shuffled, so a passage in a third of all
documents costs no more than any other.

Cases: a word is what stands between white space, in lower case and without anything but letters, digits
and underscores; what has none of these is no word. Null or
empty texts match nothing, nor do items of fewer than three words. Equal items are found alike, each under
its own id. Items above ``SEGMENT`` words are aligned in segments whose scores are added; their passages of
``PASSAGE_WORDS`` count within a segment, so of twice as many words one is always found. An edited copy whose unbroken
runs are all phrases that more than ``RARE`` items share, each shorter than a quarter of the item, has no seed.
Repeated rows give repeated results. Texts are read whole, extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.llm.common import batch, mix

SEED_WORDS = 3
#: An n-gram is rare if at most so many test items hold it.
RARE = 8
#: Bounds of the items that are sent to the tasks at once.
BLOCK_ITEMS, BLOCK_CHARS = 100_000, 16_000_000
SEGMENT = 256
#: Long documents are searched in stretches that overlap by more than an edited segment.
STRETCH, OVERLAP = 4096, 3 * SEGMENT
LEAST_SCORE = 0.5
PASSAGE_WORDS = 50
MATCH, MISMATCH, GAP = 2, -1, 1
NO_WORD = re.compile(r"\W+")
POWER = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Token to the hash of its word, 0 if it holds none; remembered up to a bound."""

    BOUND = 200_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        word = NO_WORD.sub("", token.lower())
        h = self[token] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1 if word else 0
        return h


def word_hashes(text: str | None, words: Words) -> np.ndarray:
    tokens = (text or "").split()
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    return h[h != 0]


class Lookup:
    """Which of many hashes are among known ones; a table of their low bits answers most with no."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = known
        bits = min(24, max(20, len(known).bit_length() + 4))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(known & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` of the known ones, and their places in ``known``."""
        maybe = np.flatnonzero(self.table[(hashes & self.mask).astype(np.int64)])
        if not len(maybe) or not len(self.known):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        hit = self.known[at] == hashes[maybe]
        return maybe[hit], at[hit]


def grams_of(words: np.ndarray) -> np.ndarray:
    """Unfinished hashes of the word trigrams, in order."""
    n = len(words) - SEED_WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, SEED_WORDS):
        h = longer(h, words[i : n + i])
    return h


def longer(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Unfinished hashes of the n-grams with one more word each."""
    with np.errstate(over="ignore"):
        return grams * POWER + words


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every stretch of ``counts`` places, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def common_words(item: np.ndarray, passage: np.ndarray) -> int:
    """Length of the longest common subsequence, all columns of a row in the bits of one number."""
    places: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    full = left = (1 << len(item)) - 1
    for word in passage[np.isin(passage, item)].tolist():
        hit = left & places[word]
        left = (left + hit | left - hit) & full
    return len(item) - left.bit_count()


def align(item: np.ndarray, passage: np.ndarray, need: int = 0) -> int:
    """Best local alignment score of two word sequences, given up once it cannot reach ``need``; a row is computed at once."""
    slope = GAP * np.arange(len(passage) + 1)
    row, best = np.zeros(len(passage) + 1, np.int64), 0
    for left, word in zip(range(len(item) - 1, -1, -1), item):
        reached = np.maximum(row - GAP, 0)
        reached[1:] = np.maximum(reached[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(reached + slope) - slope
        top = int(row.max())
        best = max(best, top)
        if max(best, top + MATCH * left) < need:
            break
    return best


@dataclass
class Seeds:
    """The test items of one block, cut into segments, with their seeds; all of it is sent to the tasks.

    ``grams`` holds the finished hashes of all seeds and of their beginnings. Gram ``k`` is a seed at the places
    ``first[k]`` to ``first[k + 1]`` of ``places`` (positions in ``words``), and ``open[k]`` says whether longer ones begin with it.
    """

    ids: list[list[int | None]]
    lengths: list[int]
    words: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    places: np.ndarray
    open: np.ndarray
    vocabulary: np.ndarray
    word_at: np.ndarray


def seeds_of_items(items: list[tuple[int | None, str]], rare: int = RARE) -> Seeds:
    hashes = Words()
    by_text: dict[bytes, list] = defaultdict(list)
    for item_id, text in items:
        w = word_hashes(text, hashes)
        if len(w) >= SEED_WORDS:
            by_text[w.tobytes()].append(item_id)
    each = [np.frombuffer(k, np.uint64) for k in by_text]
    parts = [(i, w[s : s + SEGMENT]) for i, w in enumerate(each) for s in range(0, len(w), SEGMENT)]
    words = np.concatenate([w for _, w in parts]) if parts else np.zeros(0, np.uint64)
    sizes = np.array([len(w) for _, w in parts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    item = np.array([i for i, _ in parts], np.int64)
    grams, places, inner = _seeds(words, bounds, item, rare)
    order = np.argsort(grams, kind="stable")
    known = np.unique(np.concatenate([grams, inner]))
    vocabulary, word_at = np.unique(words, return_inverse=True)
    return Seeds(
        list(by_text.values()), [len(w) for w in each], words, bounds, item, known,
        np.append(np.searchsorted(grams[order], known), len(grams)), places[order], np.isin(known, inner), vocabulary, word_at,
    )


def _seeds(words: np.ndarray, bounds: np.ndarray, item: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seed of every word as (hash, place), and the hashes of the n-grams that had to be read on."""
    segment = np.repeat(np.arange(len(item)), np.diff(bounds))
    room = bounds[1:][segment] - np.arange(len(words))
    limit = np.minimum(room, np.maximum(SEED_WORDS, np.diff(bounds)[segment] // 4))
    at = np.flatnonzero(room >= SEED_WORDS)
    raw, length = grams_of(words)[at], SEED_WORDS
    seeds, places, inner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while len(at):
        gram = mix(raw)
        _, number = np.unique(gram, return_inverse=True)
        pairs = np.unique(np.stack([number, item[segment[at]]]), axis=1)
        done = (np.bincount(pairs[0])[number] <= rare) | (limit[at] <= length)
        seeds.append(gram[done])
        places.append(at[done])
        inner.append(np.unique(gram[~done]))
        at = at[~done]
        raw, length = longer(raw[~done], words[at + length]), length + 1
    return np.concatenate(seeds), np.concatenate(places), np.concatenate(inner)


class Matcher:
    """Searches documents for the items of a block, in one task."""

    def __init__(self, seeds: Seeds, least: float) -> None:
        self.seeds = seeds
        self.lookup = Lookup(seeds.grams)
        self.present = np.zeros(len(seeds.vocabulary), bool)
        self.most = MATCH * np.array(seeds.lengths, np.int64)
        single = np.bincount(seeds.item, minlength=len(seeds.ids)) == 1
        #: What an alignment with a segment must reach; segments of longer items add up, so each of them counts.
        self.need = np.where(single, np.minimum(least * self.most, MATCH * PASSAGE_WORDS), 1)[seeds.item]
        self.least = least

    def matches(self, words: np.ndarray) -> list[tuple[int, float, int]]:
        """(item number, score, seeds found) of the items that a document's words hold."""
        best: dict[int, int] = {}
        found: dict[int, set[int]] = defaultdict(set)
        for start in range(0, max(1, len(words) - OVERLAP), STRETCH):
            stretch = words[start : start + STRETCH + OVERLAP]
            for segment, pairs in self._candidates(stretch):
                own = self.seeds.words[self.seeds.bounds[segment] : self.seeds.bounds[segment + 1]]
                best[segment] = self._best(own, self._passages(own, stretch, pairs), best.get(segment, 0), self.need[segment])
                found[segment].update(position for _, position in pairs)
        by_item: dict[int, list[int]] = defaultdict(list)
        for segment in best:
            by_item[int(self.seeds.item[segment])].append(segment)
        out = []
        for item, segments in sorted(by_item.items()):
            score = sum(best[s] for s in segments) / int(self.most[item])
            if score >= self.least or max(best[s] for s in segments) >= MATCH * PASSAGE_WORDS:
                out.append((item, score, sum(len(found[s]) for s in segments)))
        return out

    def _hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the document, place among the items' words) of every seed that the words hold."""
        seeds = self.seeds
        raw, length = grams_of(words), SEED_WORDS
        at = np.arange(len(raw))
        hits, places = [], []
        while len(at):
            hit, gram = self.lookup.find(mix(raw))
            counts = seeds.first[gram + 1] - seeds.first[gram]
            hits.append(np.repeat(at[hit], counts))
            places.append(seeds.places[spread(seeds.first[gram], counts)])
            on = hit[seeds.open[gram]]
            on = on[at[on] + length < len(words)]
            at = at[on]
            raw, length = longer(raw[on], words[at + length]), length + 1
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(hits), np.concatenate(places)

    def _candidates(self, words: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Segments with enough words in a stretch, with (position, position in the segment) of their seeds in order."""
        hits, places = self._hits(words)
        if not len(hits):
            return
        seeds = self.seeds
        segment = np.searchsorted(seeds.bounds, places, side="right") - 1
        order = np.lexsort((places, hits, segment))
        hits, places, segment = hits[order], places[order], segment[order]
        every, first = np.unique(segment, return_index=True)
        sizes = seeds.bounds[every + 1] - seeds.bounds[every]
        known = np.minimum(np.searchsorted(seeds.vocabulary, words), len(seeds.vocabulary) - 1)
        known = known[seeds.vocabulary[known] == words]
        self.present[known] = True
        there = self.present[seeds.word_at[spread(seeds.bounds[every], sizes)]]
        self.present[known] = False
        enough = MATCH * np.add.reduceat(there, np.cumsum(sizes) - sizes, dtype=np.int64) >= self.need[every]
        for k in np.flatnonzero(enough).tolist():
            mine = slice(first[k], first[k + 1] if k + 1 < len(first) else None)
            yield int(every[k]), list(zip(hits[mine].tolist(), (places[mine] - seeds.bounds[every[k]]).tolist()))

    @staticmethod
    def _passages(own: np.ndarray, words: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, np.ndarray]]:
        """The words around the seeds, each with a bound of its alignment: twice the words in common order. Best first."""
        out = []
        reach = len(own) + len(own) // 2
        start = 0
        for end in range(1, len(pairs) + 1):  # seeds of one occurrence lie within the segment's reach
            if end < len(pairs) and pairs[end][0] - pairs[end - 1][0] <= reach:
                continue
            passage = words[max(0, pairs[start][0] - reach) : pairs[end - 1][0] + reach]
            start = end
            out.append((MATCH * common_words(own, passage), passage))
        return sorted(out, key=lambda x: -x[0])

    @staticmethod
    def _best(own: np.ndarray, passages: list[tuple[int, np.ndarray]], best: int, need: float) -> int:
        for bound, passage in passages:
            if bound <= best or bound < need:
                break
            best = max(best, align(own, passage, need))
        return best


MATCHES = "doc_id bigint, item_id bigint, score double, seeds bigint"


def _match(documents: DataFrame, seeds: Seeds, least: float) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = Matcher(shared.value, least), Words()
        for b in batches:
            rows = [
                (doc_id, item_id, score, found)
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for item, score, found in own.matches(word_hashes(text, hashes))
                for item_id in own.seeds.ids[item]
            ]
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            names = ["doc_id", "item_id", "score", "seeds"]
            yield batch([(n, pa.array(c, k)) for n, c, k in zip(names, columns, kinds)])

    return documents.mapInArrow(run, MATCHES)


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[Seeds]:
    """The seeds of all items, of at most about ``block_items`` items and ``BLOCK_CHARS`` characters at a time."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    size = items.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.items // block_items), -(-size.chars // BLOCK_CHARS))
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        yield seeds_of_items([(r.item_id, r.text) for r in mine.collect()])


def contaminated(
    documents: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """doc_id, item_id, score, seeds for every document and test item that match."""
    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for seeds in _blocks(benchmark, block_items):
        found = _match(narrow, seeds, least)
        out = found if out is None else out.union(found)
    return out


def keep_clean(
    documents: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """The rows of ``documents`` that match no test item, with all their columns."""
    at, out = documents.columns.index("text"), documents
    for seeds in _blocks(benchmark, block_items):
        out = _without(out, seeds, at, least)
    return out


def _without(documents: DataFrame, seeds: Seeds, at: int, least: float) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = Matcher(shared.value, least), Words()
        for b in batches:
            clean = [not own.matches(word_hashes(t, hashes)) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
