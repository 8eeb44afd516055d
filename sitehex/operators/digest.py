"""Tables compared by small digests instead of by their rows.

Every row is hashed once and added to the digest of its bucket, map-side and in any order, so a table of any size
shrinks to a few numbers per bucket. Two tables that differ are then read again in the buckets that differ only,
and only those rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitehex.operators.atscale import broadcast_bounded

BUCKETS = 1024
#: Hexadecimal digits of an MD5 that fit a bigint.
HASH_DIGITS = 15
ABSENT = "\x00"


def row_hash(columns: Sequence[str]) -> Column:
    """Non-negative 60-bit hash of the texts of ``columns``, each with its length; NULL differs from every text."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts += [F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit(ABSENT))]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, HASH_DIGITS), 16, 10).cast("bigint")


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(row_hash(keys), F.lit(buckets)).alias("bucket")


def table_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """bucket, row_count, hash_sum, hash_xor of the rows whose ``keys`` fall into each bucket.

    The sum tells repeated rows apart, which cancel out in the XOR. Digests of parts of a table merge by the same aggregates.
    """
    hashed = df.select(_bucket(keys, buckets), row_hash([*keys, *columns]).alias("h"))
    return hashed.groupBy("bucket").agg(
        F.count("*").alias("row_count"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor("h").alias("hash_xor")
    )


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets whose digests differ or which one side lacks, with the rows of both sides."""
    a, b = left.alias("a"), right.alias("b")
    same = F.lit(True)
    for c in ("row_count", "hash_sum", "hash_xor"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, "bucket", "full").where(~same).select(
        "bucket", F.coalesce("a.row_count", F.lit(0)).alias("left_rows"), F.coalesce("b.row_count", F.lit(0)).alias("right_rows")
    )


def changed_rows(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """keys, columns, left_rows, right_rows of every row that one table holds more often than the other."""
    found = broadcast_bounded(
        differing_buckets(table_digest(left, keys, columns, buckets), table_digest(right, keys, columns, buckets)).select("bucket"), buckets
    )

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        told = df.select(*keys, *columns, _bucket(keys, buckets)).join(found, "bucket", "left_semi").drop("bucket")
        return told.select("*", F.lit(int(is_left)).alias("l"), F.lit(int(not is_left)).alias("r"))

    both = side(left, True).unionByName(side(right, False))
    return (
        both.groupBy(*keys, *columns).agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
        .where(F.col("left_rows") != F.col("right_rows"))
    )
