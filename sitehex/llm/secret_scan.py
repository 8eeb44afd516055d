"""Secret scans: two character Markov models compared by log-likelihood ratio, beside three fixed patterns.

One model describes random strings, the other ordinary identifiers. Both are bigram models over the
characters of secrets, fitted on labelled samples: strings that the fixed patterns find in the corpus
and seeded random strings on one side, on the other ordinary words and identifiers of the corpus and seeded
ones of common shapes (UUIDs, times, dates, versions, paths, alphabets) made of the corpus's words. A
long token that the random model explains better by more than a threshold per character is a span of
kind ``markov``. The threshold is set so that at most one in ``ONE_FALSE_IN`` ordinary tokens passes.

Cases: null and empty texts have no spans. Spans of different kinds may overlap; a markov span is not
given where a fixed pattern already has one. Offsets are code points, ends exclusive. Texts are scanned
whole. Repeated rows give repeated results, and extra columns pass by.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.llm.common import batch, hash_share, texts

KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # whole runs of 20 and more characters
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Words of letters joined by _, - or /, to numbers too, with up to three digits at the end, standing alone.
IDENTIFIER = re.compile(
    r"(?<![A-Za-z0-9+/_=-])/?[A-Za-z]{2,}(?:[_/-](?:[A-Za-z]{2,}|[0-9]{1,8}(?![A-Za-z0-9])))*[0-9]{0,3}(?![A-Za-z0-9+/_=-])"
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Bounds of the fitted sample: documents read, and strings of either label.
SAMPLE_ROWS = 20_000
SAMPLE_STRINGS = 20_000
ONE_FALSE_IN = 10_000
LEAST_RATIO = 0.5

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, in order of start, then kind."""
    found: list[tuple[int, int, int]] = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(start, end, KINDS[kind]) for start, kind, end in sorted(found)]


@dataclass
class MarkovPair:
    """Log-likelihood ratio of random against ordinary for every pair of characters, and the threshold."""

    ratio: np.ndarray
    threshold: float

    def score(self, token: str) -> float:
        """Mean ratio per character."""
        codes = _codes(token)
        return float(self.ratio[codes[:-1], codes[1:]].mean())


def _codes(token: str) -> np.ndarray:
    """Alphabet numbers with a start mark; other characters share one number."""
    raw = np.frombuffer(token.encode("latin-1", "replace"), np.uint8)
    return np.concatenate([[len(ALPHABET) + 1], _TABLE[raw]])


_TABLE = np.full(256, len(ALPHABET), np.int64)
_TABLE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def fit_pair(random_strings: list[str], ordinary: list[str]) -> MarkovPair:
    """Bigram models of both samples, smoothed by half a count."""

    def logs(strings: list[str]) -> np.ndarray:
        n = np.full((len(ALPHABET) + 2, len(ALPHABET) + 2), 0.5)
        for s in strings:
            codes = _codes(s)
            np.add.at(n, (codes[:-1], codes[1:]), 1)
        return np.log(n / n.sum(axis=1, keepdims=True))

    model = MarkovPair(logs(random_strings) - logs(ordinary), LEAST_RATIO)
    scores = sorted((model.score(s) for s in ordinary), reverse=True)
    if scores:
        model.threshold = max(LEAST_RATIO, scores[len(scores) // ONE_FALSE_IN])
    return model


def seeded_strings(count: int, seed: int = 5) -> list[str]:
    """Random strings over the alphabets that keys are written in."""
    r = random.Random(seed)
    kinds = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], ALPHABET)
    return ["".join(r.choices(kinds[i % len(kinds)], k=r.randint(16, 64))) for i in range(count)]


def seeded_identifiers(words: list[str], count: int, seed: int = 6) -> list[str]:
    """Ordinary identifiers of common shapes, with the given words in them."""
    r = random.Random(seed)
    words = words or ["file"]

    def day(sep: str) -> str:
        return f"{r.randint(1990, 2039)}{sep}{r.randint(1, 12):02}{sep}{r.randint(1, 28):02}"

    def clock(sep: str) -> str:
        return sep.join(f"{r.randrange(60):02}" for _ in range(3))

    letters = ALPHABET[26:52]
    shapes = (
        lambda: str(uuid.UUID(int=r.getrandbits(128), version=4)),
        lambda: f"{day('')}T{clock('')}Z-{r.choice(words)}",
        lambda: f"{r.choice(words)}-{day('-')}T{clock('-')}",
        lambda: f"{r.choice(words)}_{day(r.choice(('', '-', '_')))}_v{r.randrange(100)}",
        lambda: "/".join(r.choices(words, k=r.randint(2, 5))) + f"/{r.randrange(10_000)}",
        lambda: f"/{r.choice(words)}/{day('/')}/{r.choice(words)}",
        lambda: (r.choice((letters, letters.upper(), letters + letters.upper(), letters + "0123456789")) * 2)[r.randrange(4) :][:26],
    )
    return [shapes[i % len(shapes)]() for i in range(count)]


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: set[tuple[int, str]] = set()
        for text in texts(b.column(0)):
            spans = base_spans(text)
            for start, end, kind in spans:
                value = text[start:end]
                found.add((1, ASSIGN.match(value)[2] if kind == "assign" else value))
            keep, at = [], 0
            for start, end, _ in spans:
                keep.append(text[at:start])
                at = max(at, end)
            found.update((0, m) for m in IDENTIFIER.findall(" ".join([*keep, text[at:]])) if len(m) >= 6)
        if found:
            label, string = zip(*found)
            yield batch([("label", pa.array(label, pa.int32())), ("string", pa.array(string, pa.string()))])


def train(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_strings: int = SAMPLE_STRINGS) -> MarkovPair:
    """Fit on at most ``sample_strings`` strings of each label, from about ``sample_rows`` hash-picked documents."""
    known = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    sample = hash_share(known, ["doc_id"], sample_rows, known.count(), seed=23).select("text")
    strings = sample.mapInArrow(_samples, "label int, string string").distinct()
    picked = {
        label: [r.string for r in strings.where(F.col("label") == label).orderBy(F.xxhash64("string"), "string")
                .limit(sample_strings).collect()]
        for label in (0, 1)
    }
    ordinary = picked[0] + seeded_identifiers(picked[0], sample_strings // 4)
    return fit_pair(picked[1] + seeded_strings(sample_strings // 4), ordinary)


def markov_spans(text: str, model: MarkovPair, taken: list[Span]) -> list[Span]:
    """Long tokens with letters that look drawn at random, clear of ``taken``."""
    out = []
    for m in TOKEN.finditer(text):
        token = m[0].strip("=-_/+")
        if len(token) < 16 or token.isdigit() or not re.search("[A-Za-z]", token):
            continue
        if any(start < m.end() and m.start() < end for start, end, _ in taken):
            continue
        if model.score(token) > model.threshold:
            out.append((m.start(), m.end(), "markov"))
    return out


def scan_text(text: str, model: MarkovPair) -> tuple[list[Span], list[Span]]:
    """Spans of the fixed patterns, and all spans in order of start, then kind."""
    base = base_spans(text)
    return base, sorted(base + markov_spans(text, model, base), key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCANNED = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base_sha256 string, spans string"


def scan(documents: DataFrame, model: MarkovPair) -> DataFrame:
    """Spans of every row of ``documents`` (doc_id, text), in one pass without a shuffle."""
    ratio, threshold = model.ratio, model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MarkovPair(ratio, threshold)
        for b in batches:
            found = [scan_text(t, own) for t in texts(b.column(1))]
            counts = [[sum(s[2] == k for s in every) for _, every in found] for k in KINDS]
            digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            yield batch([
                ("doc_id", b.column(0)),
                *[(f"n_{k}", pa.array(c, pa.int64())) for k, c in zip(KINDS, counts)],
                ("base_sha256", pa.array(digests, pa.string())),
                ("spans", pa.array([written(every) for _, every in found], pa.string())),
            ])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCANNED)


def redact_text(text: str, spans: list[Span]) -> str:
    """Every stretch covered by spans replaced by the kind of its first one; of an assignment only the value goes."""
    out, at = [], 0
    for start, end, kind in spans:
        if kind == "assign":
            start += ASSIGN.match(text[start:end]).start(2)
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, model: MarkovPair) -> DataFrame:
    """``documents`` with secrets replaced in the text and n_chars counted anew; all rows and columns stay."""
    ratio, threshold = model.ratio, model.threshold
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MarkovPair(ratio, threshold)
        for b in batches:
            clean = [None if t is None else redact_text(t, scan_text(t, own)[1]) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(clean, b.schema.field(at).type))

    out = documents.mapInArrow(run, documents.schema)
    if "n_chars" not in documents.columns:
        return out
    kind = documents.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
