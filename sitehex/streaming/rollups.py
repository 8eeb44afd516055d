"""Rollups maintained while rows arrive.

A plain file table has no merge, so every micro-batch writes its own partial aggregate into the
partition ``batch_id=<n>``. A replayed batch overwrites its own part, which makes sums and counts
exactly-once; readers merge the parts, and compaction folds them into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitehex.operators.trend import merge_momentum, momentum_rollup
from sitehex.sources.demand import capacity_rollup, merge_capacity
from sitehex.sources.publish import path_exists

Rollup = Callable[[DataFrame], DataFrame]


def part_writer(rollup: Rollup, path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function writing one partial aggregate per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            rollup(batch)
            .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    return write


def maintain(source: DataFrame, rollup: Rollup, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available and stop; run again whenever new rows have arrived."""
    return (
        source.writeStream.foreachBatch(part_writer(rollup, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def maintain_capacity(buildings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Floor area and building count per cell as footprints arrive."""
    return maintain(buildings, capacity_rollup, path, checkpoint)


def maintain_momentum(poi_history: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """First and last monthly count per (city, category) as months arrive."""
    return maintain(poi_history, momentum_rollup, path, checkpoint)


def read_capacity(spark: SparkSession, path: str, folded: str | None = None) -> DataFrame:
    return merge_capacity(parts(spark, path, folded))


def read_momentum(spark: SparkSession, path: str, folded: str | None = None) -> DataFrame:
    return merge_momentum(parts(spark, path, folded))


def parts(spark: SparkSession, path: str, folded: str | None = None) -> DataFrame:
    """All parts of a rollup: with a fold, that one and the parts written after it."""
    own = spark.read.parquet(path)
    if folded is None:
        return own
    fold = spark.read.parquet(folded)
    upto = fold.agg(F.max("batch_id").alias("upto")).first().upto
    later = own if upto is None else own.where(F.col("batch_id") > upto)
    return fold.unionByName(later)


def compact(spark: SparkSession, path: str, target: str, merge: Rollup) -> int:
    """Fold the parts of this moment into one part in a new folder and return the newest batch it holds.

    The fold carries that batch's number, and the stream goes on writing to ``path``: readers take the
    fold and the later parts, so nothing that arrives during or after the fold is lost or counted twice.
    """
    if path_exists(spark, f"{target}/_SUCCESS"):
        raise ValueError("compaction target already exists")
    upto = spark.read.parquet(path).agg(F.max("batch_id").alias("upto")).first().upto
    seen = spark.read.parquet(path).where(F.col("batch_id") <= F.lit(upto))
    merge(seen).withColumn("batch_id", F.lit(upto).cast("bigint")).write.partitionBy("batch_id").parquet(target)
    return upto
