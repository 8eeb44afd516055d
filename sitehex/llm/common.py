"""What several operators share: staged tables, stable hashes and Arrow columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitehex.operators.atscale import new_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: later reads survive lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, f"llm-{purpose}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """While it lasts, tasks exchange at most ``rows`` rows at a time with Python, so long values stay few in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; a null id counts as the text of nothing."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def hash_share(df: DataFrame, key: Sequence[str], rows: int, total: int, seed: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, picked by a hash of ``key``: the same rows on every run."""
    if total <= rows:
        return df
    scale = 1 << 30
    share = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(scale))
    return df.where(share < F.lit(int(rows / total * scale)))


class Ids(dict):
    """Word to row number; unknown words get the next number and are kept in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def take_fresh(self) -> list:
        out, self.fresh = self.fresh, []
        return out


class WordHash(dict):
    """64-bit hash of a byte string, remembered up to a bound."""

    BOUND = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all of its bits depend on all bits of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [t or "" for t in column.to_pylist()]


def each_text(batches: Iterable[pa.RecordBatch], column: int, at_once: int = 500) -> Iterator[str | None]:
    """The texts of a column one after another; few of them are Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, at_once):
            yield from b.column(column).slice(at, at_once).to_pylist()


def batch(fields: Iterable[tuple[str, pa.Array]]) -> pa.RecordBatch:
    names, arrays = zip(*fields)
    return pa.RecordBatch.from_arrays(list(arrays), list(names))
