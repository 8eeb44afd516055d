"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, replaces look-alike letters of other alphabets and digits that stand for letters, and
keeps words only. Lexicon entries are whole words, word beginnings and pairs of words; each has a weight
learned from labelled texts: the log ratio of its frequency in toxic and other texts. At every place the
longest entry counts, so a longer entry with a low weight (an exception phrase) takes its words out of a
shorter entry's reach. A text's weights, in total and per word, become a probability by logistic regression.

Cases: a null or empty text matches nothing and gets the score of a text without entries. Labels that are
null or belong to no document are not learned from; a document labelled twice counts as toxic if any label
says so. With no toxic label, or no other label, every score is the share of toxic labels (0 if there are
none). Texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.llm.common import batch, each_text, hash_share, staged, texts

#: Letters of other alphabets and the Latin letters they are drawn like.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁɡһқԛԝьαοενρτυχκι", "aeopcyxijsdghkqwbaoevptuxki")
#: Signs written instead of letters; they count only next to a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
SUBSTITUTED = re.compile(r"[0134578@$!](?=[^\W\d_])|(?<=[^\W\d_])[01345780](?![\d.])")
WORD = re.compile(r"[^\W\d_]+")

#: Bounds: labelled rows learned from, entries weighed at a time and kept, and the counts an entry needs.
SAMPLE_ROWS = 20_000
CANDIDATES_AT_ONCE = 200_000
MAX_ENTRIES = 20_000
LEAST_DOCS = 3
LEAST_WEIGHT = math.log(4)
LEAST_Z = 3.5
STEMS = range(3, 9)
THRESHOLD = 0.3


def fold(text: str) -> list[str]:
    """The words of a text after folding."""
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t).translate(HOMOGLYPHS)
    for _ in range(2):  # a substitute may stand next to another one
        if SUBSTITUTED.search(t):
            t = SUBSTITUTED.sub(lambda m: SUBSTITUTES[m[0]], t)
    return WORD.findall(t)


def padded(words: list[str]) -> str:
    """Two spaces between words, so that one entry's closing space leaves the next one its opening space."""
    return "  " + "  ".join(words) + "  "


def entries_of(words: list[str]) -> Iterator[str]:
    """Every possible entry: `` word``-beginnings, `` whole `` words and pairs of words."""
    for w in words:
        yield f" {w} "
        for n in STEMS:
            if len(w) >= n:
                yield f" {w[:n]}"
    for a, b in zip(words, words[1:]):
        yield f" {a}  {b} "


def _rows(counts: Counter) -> pa.RecordBatch:
    return batch([
        ("entry", pa.array(list(counts), pa.string())), ("n", pa.array(list(counts.values()), pa.int64())),
    ])


def _entry_counts(wanted: frozenset[str] | None, at_once: int = 100):
    """In how many texts of a few each possible entry occurs, or each wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for n, text in enumerate(each_text(batches, 0), 1):
            found = set(entries_of(fold(text or "")))
            counts.update(found if wanted is None else found & wanted)
            if n % at_once == 0 and counts:
                yield _rows(counts)
                counts = Counter()
        if counts:
            yield _rows(counts)

    return run


@dataclass
class ToxicityModel:
    """Weights by entry, and the coefficients of constant, total, total per word, and matched share."""

    weights: dict[str, float]
    coefficients: np.ndarray


class Matcher:
    """The automaton of one task."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.automaton = None
        if weights:
            self.automaton = ahocorasick.Automaton()
            for entry, weight in weights.items():
                self.automaton.add_word(entry, weight)
            self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float, float, float]:
        words = fold(text)
        found = [w for _, w in self.automaton.iter_long(padded(words))] if self.automaton and words else []
        total = max(0.0, sum(found))
        strong = sum(w > 0 for w in found)
        return 1.0, math.log1p(total), total / (len(words) + 20), math.log1p(strong) - math.log1p(len(words) / 100)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge penalty on all but the constant."""
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def labelled_sample(documents: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """text, toxic of about ``sample_rows`` labelled documents, picked by a hash of the id.

    One label per id; the picked ids are bounded by ``sample_rows`` and may be broadcast.
    """
    marks = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    picked = hash_share(marks, ["doc_id"], sample_rows, marks.count(), seed=37)
    known = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return known.join(F.broadcast(picked), "doc_id").select("text", "toxic")


def train(
    documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_entries: int = MAX_ENTRIES
) -> ToxicityModel:
    """Learn entries, weights and coefficients from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    sample = staged(labelled_sample(documents, labels, sample_rows), "toxic-sample")
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    share = bad / (bad + good) if bad + good else 0.0
    if not bad or not good:
        edge = math.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0)
        return ToxicityModel({}, np.array([edge, 0, 0, 0]))

    def counted(toxic: int, wanted: frozenset[str] | None) -> DataFrame:
        rows = sample.where(F.col("toxic") == toxic).select("text").repartition(12)
        return rows.mapInArrow(_entry_counts(wanted), "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))

    toxic_in = staged(counted(1, None).where(F.col("n") >= LEAST_DOCS), "toxic-entries")
    parts = max(1, -(-toxic_in.count() // CANDIDATES_AT_ONCE))
    scored: list[tuple[float, str, float]] = []
    for k in range(parts):  # every candidate is weighed before the surest are kept
        mine = toxic_in.where(F.pmod(F.xxhash64("entry"), F.lit(parts)) == k)
        n1 = {r.entry: r.n for r in mine.collect()}
        n0 = {r.entry: r.n for r in counted(0, frozenset(n1)).collect()}
        scored = sorted(scored + weighed(n1, n0, bad, good))[:max_entries]
    kept = {entry: weight for _, entry, weight in scored}
    weights = simplify(kept)
    weights |= exceptions(sample, weights, bad, good, max_entries)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights)
        for b in batches:
            x = list(zip(*map(matcher.features, texts(b.column(0))))) or [()] * 4
            yield batch([*[(f"x{i}", pa.array(c, pa.float64())) for i, c in enumerate(x)], ("toxic", b.column(1))])

    schema = "x0 double, x1 double, x2 double, x3 double, toxic int"
    rows = sample.repartition(12).mapInArrow(measured, schema).toPandas()
    return ToxicityModel(weights, fit_logistic(rows[["x0", "x1", "x2", "x3"]].to_numpy(), rows["toxic"].to_numpy()))


def weighed(n1: dict[str, int], n0: dict[str, int], bad: int, good: int) -> list[tuple[float, str, float]]:
    """(-z, entry, weight) of the entries that toxic texts hold far more often than others."""
    scored = []
    for entry, a in n1.items():
        b = n0.get(entry, 0)
        weight = math.log((a + 0.5) / (bad + 1)) - math.log((b + 0.5) / (good + 1))
        mean = (a + b) / (bad + good)
        z = (a / bad - b / good) / math.sqrt(mean * (1 - mean) * (1 / bad + 1 / good) + 1e-12)
        if z >= LEAST_Z and weight >= LEAST_WEIGHT:
            scored.append((-z, entry, weight))
    return scored


def simplify(kept: dict[str, float]) -> dict[str, float]:
    """Drop what shorter entries say already: words whose beginning is as strong, pairs that hold an entry."""
    out: dict[str, float] = {}
    for entry in sorted(kept, key=lambda e: ("  " in e, len(e), e)):
        if "  " in entry and any(word[:n] in out for word in _words_of(entry) for n in range(4, len(word) + 1)):
            continue
        shorter = [out[entry[:n]] for n in range(4, len(entry)) if entry[:n] in out]
        if not shorter or abs(kept[entry] - shorter[-1]) > 0.7:
            out[entry] = kept[entry]
    return out


def _words_of(pair: str) -> list[str]:
    return [f" {w} " for w in pair.split()]


def exceptions(sample: DataFrame, weights: dict[str, float], bad: int, good: int, most: int) -> dict[str, float]:
    """Whole words and pairs of words that hold an entry and yet are about as frequent in other texts."""
    if not weights:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights)
        for b in batches:
            counts: Counter = Counter()
            for text, toxic in zip(texts(b.column(0)), b.column(1).to_pylist()):
                words = fold(text)
                hit = [bool(list(matcher.automaton.iter_long(f" {w} "))) for w in words]
                held = {f" {w} " for w, h in zip(words, hit) if h}
                held |= {f" {a}  {c} " for a, c, h, k in zip(words, words[1:], hit, hit[1:]) if h or k}
                counts.update((e, toxic) for e in held)
            rows = [(e, t, n) for (e, t), n in counts.items()]
            if rows:
                entry, toxic, n = zip(*rows)
                yield batch([("entry", pa.array(entry)), ("toxic", pa.array(toxic, pa.int32())), ("n", pa.array(n, pa.int64()))])

    found = (
        sample.repartition(12).mapInArrow(run, "entry string, toxic int, n bigint").groupBy("entry")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"),
             F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0"))
        .where(F.col("n0") >= LEAST_DOCS)
        .select("entry", (F.log((F.col("n1") + 0.5) / (bad + 1)) - F.log((F.col("n0") + 0.5) / (good + 1))).alias("weight"))
        # half of a longer innocent phrase is no exception
        .where(F.col("weight") < F.when(F.col("entry").contains("  "), -LEAST_WEIGHT / 2).otherwise(LEAST_WEIGHT / 2))
        .orderBy("weight", "entry").limit(most).collect()
    )
    return {r.entry: min(0.0, r.weight) for r in found}


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted of every row of ``documents`` (doc_id, text), in one pass without a shuffle."""
    weights, coefficients = model.weights, model.coefficients

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights)
        for b in batches:
            x = np.array([matcher.features(t) for t in texts(b.column(1))]).reshape(-1, len(coefficients))
            p = 1 / (1 + np.exp(-np.clip(x @ coefficients, -30, 30)))
            yield batch([("doc_id", b.column(0)), ("score", pa.array(p, pa.float64()))])

    out = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``documents`` with a score under THRESHOLD, with all their columns."""
    weights, coefficients = model.weights, model.coefficients
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights)
        for b in batches:
            x = np.array([matcher.features(t) for t in texts(b.column(at))]).reshape(-1, len(coefficients))
            p = 1 / (1 + np.exp(-np.clip(x @ coefficients, -30, 30)))
            yield b.filter(pa.array(p < THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
