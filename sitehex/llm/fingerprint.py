"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words, each with its number of occurrences. For every term and every
one of ``SAMPLES`` slots, three seeded values decide how the term competes at its weight: r and c
drawn from Gamma(2, 1) and b from the uniform distribution. The term with the smallest value wins the
slot, and two texts agree in a slot with a probability equal to their generalised Jaccard similarity
(sum of smaller weights over sum of larger ones). A slot is kept as 16 bits of its winner.

Cases: a null text is an empty text; texts without a word share the fingerprint of zeros, are alike (1)
among each other and unlike (0) all others. Equal texts have equal fingerprints. Repeated rows and rows
with equal ids are ordered by text, a null id comes first. A single document is its own next document.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitehex.llm.common import Ids, batch, mix

SAMPLES = 64
U32 = np.uint64(0xFFFFFFFF)


def gamma_values(hashes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, log c and b of every term (rows) and slot (columns), from 64-bit term hashes alone."""
    slots = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def uniform(x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21)

    h1 = mix(hashes[:, None] ^ slots[None, :])
    h2 = mix(h1 ^ np.uint64(0xD1B54A32D192ED03))
    low = np.uint64((1 << 21) - 1)
    u = [uniform(h1 & low), uniform((h1 >> np.uint64(21)) & low), uniform((h1 >> np.uint64(42)) & low),
         uniform(h2 & low), uniform((h2 >> np.uint64(21)) & low)]
    r = -np.log(u[0] * u[1])
    c = -np.log(u[2] * u[3])
    return r, np.log(c), u[4]


class Sampler:
    """Fingerprints in one task. Terms met so far keep their values, up to a bound."""

    BOUND = 60_000

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples = samples
        self.reset()

    def reset(self) -> None:
        self.ids = Ids()
        self.score = np.zeros((4096, self.samples), np.float32)
        self.code = np.zeros((4096, self.samples), np.uint16)

    def _learn(self, start: int) -> None:
        """Value and code of fresh (word, weight) terms in every slot."""
        fresh = self.ids.take_fresh()
        if not fresh:
            return
        while len(self.score) < len(self.ids):
            self.score = np.vstack([self.score, np.zeros_like(self.score)])
            self.code = np.vstack([self.code, np.zeros_like(self.code)])
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w, _ in fresh), np.uint64, len(fresh))
        weight = np.log(np.fromiter((n for _, n in fresh), np.float32, len(fresh)))[:, None]
        r, log_c, b = gamma_values(hashes, self.samples)
        step = np.floor(weight / r + b)
        self.score[start : start + len(fresh)] = log_c - r * (step - b) - r
        won = mix(hashes[:, None] ^ mix(step.astype(np.int64).astype(np.uint64)))
        self.code[start : start + len(fresh)] = (won >> np.uint64(48)).astype(np.uint16)

    def sample(self, text: str) -> np.ndarray:
        """The text's codes, one per slot; zeros for a text without words."""
        terms = Counter(text.split())
        if not terms:
            return np.zeros(self.samples, np.uint16)
        if len(self.ids) > self.BOUND:
            self.reset()
        start = len(self.ids)
        rows = np.fromiter(map(self.ids.__getitem__, terms.items()), np.int64, len(terms))
        self._learn(start)
        winner = rows[self.score[rows].argmin(axis=0)]
        return np.maximum(self.code[winner, np.arange(self.samples)], 1)  # zeros stay apart


def as_text(codes: np.ndarray) -> str:
    return codes.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, fingerprint of every row of ``documents`` (doc_id, text), in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for b in batches:
            made = [as_text(sampler.sample(t or "")) for t in b.column(1).to_pylist()]
            yield batch([("doc_id", b.column(0)), ("fingerprint", pa.array(made, pa.string()))])

    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, fingerprint string")


def likeness_of(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal slots of two fingerprint columns."""
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(samples - 1)),
        F.lit(0),
        lambda n, i: n + (F.substring(a, i * 4 + 1, 4) == F.substring(b, i * 4 + 1, 4)).cast("int"),
    )
    return same / F.lit(samples)


def longs(values: list[int]) -> Column:
    """A constant array, as one literal however long it is."""
    return F.split(F.lit(",".join(map(str, values)) or "0"), ",").cast("array<bigint>")


def _runs(documents: DataFrame, ranges: int) -> DataFrame:
    """Rows dealt into consecutive ranges of ids; each range also gets the first id after it.

    Columns: part, edge (0 own row, 1 first row of the following range), key, doc_id, text. The bounds
    are quantiles of the ids; what reaches the driver is one number per range.
    """
    lowest = -(1 << 63)
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(lowest)).alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    cuts = [i / ranges for i in range(1, ranges)]
    found = rows.select("key").agg(F.percentile_approx("key", cuts, 10 * ranges).alias("cuts")).first().cuts or []
    bounds = sorted(set(found))
    place, width = rows.withColumn("part", F.lit(0)), 1 << max(0, len(bounds).bit_length() - 1)
    sorted_bounds = longs(bounds)
    while bounds and width:  # binary search, so a row costs the logarithm of the number of ranges
        reach = F.col("part") + F.lit(width)
        passed = (reach <= F.lit(len(bounds))) & (F.get(sorted_bounds, reach - 1) < F.col("key"))
        place = place.withColumn("part", F.when(F.coalesce(passed, F.lit(False)), reach).otherwise(F.col("part")))
        width //= 2
    firsts = {r.part: r.key for r in place.groupBy("part").agg(F.min("key").alias("key")).collect()}
    used = sorted(firsts)
    before = dict(zip(used, used[-1:] + used[:-1]))  # the first range follows the last
    every = range(len(bounds) + 1)
    first_key, earlier = longs([firsts.get(p, lowest) for p in every]), longs([before.get(p, 0) for p in every])
    edge = F.when(F.get(first_key, F.col("part")) == F.col("key"), F.get(earlier, F.col("part")))
    copies = F.array(
        F.struct(F.col("part").cast("int").alias("part"), F.lit(0).alias("edge")),
        F.struct(edge.cast("int").alias("part"), F.lit(1).alias("edge")),
    )
    dealt = place.withColumn("copy", F.explode(F.filter(copies, lambda c: c["part"].isNotNull())))
    return dealt.select("copy.part", "copy.edge", "key", "doc_id", "text")


EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_copy(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many code points from the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def next_and_edited(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its copy whose last quarter comes from the next document.

    Texts are shuffled once, into ranges of consecutive ids. A range also receives the rows of the id
    that follows it, so neighbours always meet; no window over all rows is needed.
    """
    parts = 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _runs(documents, parts)
    ordered = dealt.repartition(parts // 4, "part").sortWithinPartitions("part", "edge", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        waiting = None  # part, edge, doc_id, text, codes
        done: list[tuple] = []

        def pair(row, following, codes_next):
            _, _, doc_id, text, codes = row
            edited = edited_copy(text, following)
            other = sampler.sample(edited)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            done.append((doc_id, len(text), digest, as_text(codes), as_text(other), likeness(codes, other),
                         likeness(codes, codes_next)))

        def flush():
            columns = list(zip(*done)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [f.split(" ")[0] for f in EDITED.split(", ")]
            out = batch([(n, pa.array(c, t)) for n, c, t in zip(names, columns, types)])
            done.clear()
            return out

        for b in batches:
            part, edge, _, doc_id, text = (c.to_pylist() for c in b.columns)
            for p, e, d, t in zip(part, edge, doc_id, text):
                if waiting is not None and waiting[0] == p and waiting[1] == 1:
                    continue  # only the first row after the range is a neighbour
                codes = sampler.sample(t)
                if waiting is not None and waiting[0] == p:
                    pair(waiting, t, codes)
                waiting = (p, e, d, t, codes)
                if len(done) >= 2000:
                    yield flush()
        yield flush()

    return ordered.mapInArrow(run, EDITED)
