"""Language identification: known words first, then ever shorter character n-grams.

A word seen in training is scored by its log frequency in each language. An unseen word falls back
to the longest n-grams of it that training knows. The evidence of all words of a text is added up.

Labelled rows and words are bounded language by language, so that a language is known however rare it is beside others.

Cases: null text, empty text and text without a letter get ``und`` and score 0. Rows without a
language are never learned from. With nothing to learn from every text is ``und``. Repeated rows
are scored alike. The text is read whole, whatever its length. Extra input columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitehex.llm.common import Ids, batch, texts

#: Letters alone: fractions, circled digits and Roman numeral signs are none.
WORD = regex.compile(r"\p{L}+")

#: Bound on the labelled rows a model is fitted on, on its words and on the n-grams of one length, shared among languages.
SAMPLE_ROWS = 20_000
MAX_WORDS = 60_000
MAX_GRAMS = 40_000
LONGEST_GRAM = 5
#: Weight, in words, of the whole corpus in a language's frequencies.
PRIOR = 20.0


@dataclass
class LanguageModel:
    """Log odds per language, one row a term; at most MAX_WORDS words and MAX_GRAMS n-grams of each length.

    ``rows`` holds a table of row numbers for whole words under 0 and for n-grams under their length.
    """

    languages: list[str]
    rows: dict[int, dict[str, int]]
    odds: np.ndarray

    def terms(self, word: str) -> list[int]:
        """Rows that speak for a word: its own, or those of its longest known n-grams."""
        known = self.rows[0].get(word)
        if known is not None:
            return [known]
        padded = f"^{word}$"
        for n in range(max(self.rows), 0, -1):
            table = self.rows[n]
            found = [r for i in range(len(padded) - n + 1) if (r := table.get(padded[i : i + n])) is not None]
            if found:
                return found
        return []

    def evidence(self, words: list[str]) -> np.ndarray:
        """Mean log odds of each word's terms; zeros for a word of unknown letters."""
        found = [self.terms(w) or [-1] for w in words]
        flat = np.fromiter((r for f in found for r in f), np.int64)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        padded = np.vstack([self.odds, np.zeros((1, self.odds.shape[1]), np.float32)])  # row -1
        sums = np.add.reduceat(padded[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        return sums / sizes[:, None]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(texts(b.column(0)), b.column(1).to_pylist()):
            counts[lang].update(WORD.findall(text.lower()))
        rows = [(lang, w, n) for lang, words in counts.items() for w, n in words.items()]
        if rows:
            langs, words, ns = zip(*rows)
            yield batch([("lang", pa.array(langs)), ("word", pa.array(words)), ("n", pa.array(ns, pa.int64()))])


def _table(counts: dict[str, dict[int, float]], languages: int, most: int) -> tuple[list[str], np.ndarray]:
    """The terms that rank highest in any language, and their log frequency in each language less the mean over languages."""
    rank: dict[str, int] = {}
    for i in range(languages):
        own = sorted(((-by[i], term) for term, by in counts.items() if i in by))
        for k, (_, term) in enumerate(own[:most]):
            rank[term] = min(k, rank.get(term, k))
    kept = [(term, counts[term]) for term in sorted(rank, key=lambda t: (rank[t], t))[:most]]
    n = np.zeros((len(kept), languages))
    for k, (_, by) in enumerate(kept):
        for i, c in by.items():
            n[k, i] = c
    if not kept:
        return [], n.astype(np.float32)
    # Every language is smoothed towards the corpus as a whole, so a little-seen one is not favoured.
    corpus = n.sum(axis=1, keepdims=True) / n.sum()
    logs = np.log((n + PRIOR * corpus) / (n.sum(axis=0) + PRIOR))
    return [term for term, _ in kept], (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def _quotas(rows: dict[str, int], most: int) -> dict[str, int]:
    """Rows to take of every language, ``most`` together: equal shares, and what small languages leave goes to the others."""
    out, left = {}, most
    for k, (lang, n) in enumerate(sorted(rows.items(), key=lambda kv: (kv[1], kv[0]))):
        out[lang] = min(n, max(1, left // (len(rows) - k)))
        left -= out[lang]
    return out


def _sample(known: DataFrame, rows: dict[str, int], most: int) -> DataFrame:
    """About ``_quotas`` rows of every language by a hash of the id; of a language that has no more, all."""
    shares = {lang: n / rows[lang] for lang, n in _quotas(rows, most).items()}
    if all(s == 1 for s in shares.values()):
        return known
    scale = 1 << 30
    # Four standard deviations more than wanted, so that a quota of a few rows isn't missed by chance.
    bound = {lang: int(min(1.0, s + 4 * math.sqrt(s / rows[lang])) * scale) for lang, s in shares.items()}
    limits = F.create_map(*[F.lit(x) for pair in bound.items() for x in pair])
    return known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(scale)) < limits[F.col("lang")])


def train(
    labelled: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    max_words: int = MAX_WORDS,
    max_grams: int = MAX_GRAMS,
    longest_gram: int = LONGEST_GRAM,
) -> LanguageModel:
    """Fit on a hash-picked sample of about ``sample_rows`` rows of ``labelled`` (doc_id, text, lang).

    Counting is a Spark aggregate. Of every language only its share of twice ``max_words`` words reaches the driver, the
    most frequent ones; n-gram counts come from those words and their counts.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    labels = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    sample = _sample(known, labels, sample_rows).select("text", "lang")
    each = max(1, 2 * max_words // max(1, len(labels)))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counted = (
        sample.mapInArrow(_count_words, "lang string, word string, n bigint")
        .groupBy("word", "lang").agg(F.sum("n").alias("n"))
        .withColumn("place", F.row_number().over(best)).where(F.col("place") <= each).collect()
    )
    languages = sorted({r.lang for r in counted})
    at = {lang: i for i, lang in enumerate(languages)}
    words: dict[str, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    grams: dict[int, dict[str, dict[int, float]]] = {
        n: defaultdict(lambda: defaultdict(float)) for n in range(1, longest_gram + 1)
    }
    for r in counted:
        i = at[r.lang]
        words[r.word][i] += r.n
        padded = f"^{r.word}$"
        weight = 1 + math.log(r.n)  # a frequent word shows its spelling no better than a rare one
        for n, table in grams.items():
            for k in range(len(padded) - n + 1):
                table[padded[k : k + n]][i] += weight
    tables = [_table(words, len(languages), max_words)]
    tables += [_table(grams[n], len(languages), max_grams) for n in range(1, longest_gram + 1)]
    rows, start = {}, 0
    for n, (terms, _) in enumerate(tables):
        rows[n] = {t: start + k for k, t in enumerate(terms)}
        start += len(terms)
    return LanguageModel(languages, rows, np.vstack([odds for _, odds in tables]))


class Scorer:
    """Scores texts in one task; the evidence of words met so far is kept up to a bound."""

    BOUND = 400_000

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.ids, self.table = Ids(), np.zeros((4096, len(self.model.languages)), np.float32)

    def _rows(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def score(self, several: list[str]) -> list[tuple[str, float, int]]:
        """Language, share of belief in it (0 to 1) and number of words of each text."""
        if not self.model.languages:
            return [("und", 0.0, len(WORD.findall(t))) for t in several]
        if len(self.ids) > self.BOUND:
            self.reset()
        start = len(self.ids)
        rows = [self._rows(t) for t in several]
        fresh = self.ids.take_fresh()
        while len(self.table) < len(self.ids):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        if fresh:
            self.table[start : start + len(fresh)] = self.model.evidence(fresh)
        return [self._best(r) for r in rows]

    def _best(self, rows: np.ndarray) -> tuple[str, float, int]:
        if not len(rows):
            return "und", 0.0, 0
        total = self.table[rows].sum(axis=0, dtype=np.float64) / math.sqrt(len(rows))
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum()), len(rows)


def predict(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, n_words for every row of ``documents`` (doc_id, text)."""
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.rows, model.odds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(LanguageModel(*shared.value))
        for b in batches:
            several = texts(b.column(1))
            found = [x for k in range(0, len(several), 256) for x in scorer.score(several[k : k + 256])]
            lang, score, n = zip(*found) if found else ((), (), ())
            yield batch([
                ("doc_id", b.column(0)),
                ("lang_pred", pa.array(lang, pa.string())),
                ("score", pa.array(score, pa.float64())),
                ("n_words", pa.array(n, pa.int64())),
            ])

    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, lang_pred string, score double, n_words bigint")
