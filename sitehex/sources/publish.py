"""Sinks: idempotent partition replacement, verified publishing, keyed deletes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitehex.operators.atscale import new_folder


class CheckFailed(RuntimeError):
    """A load did not pass its checks; nothing was published."""

    def __init__(self, failures: list):
        super().__init__("load rejected: " + "; ".join(str(f) for f in failures))
        self.failures = failures


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]


def replace_partition(
    df: DataFrame, path: str, by: str, keys: Sequence[str], cluster_by: Sequence[str] = ()
) -> int:
    """Overwrite the partitions ``keys`` of a table and nothing else; returns rows written.

    A key without rows ends up as an empty partition instead of keeping its old rows. With
    ``cluster_by`` the rows are range-split on (key, columns) and sorted: a large key is written by
    many tasks, a small one by few, so files stay few and their column ranges narrow.
    """
    spark = df.sparkSession
    seen = Observation()
    flags = [F.max((F.col(by) == k).cast("int")).alias(f"k{i}") for i, k in enumerate(keys)]
    chosen = df.where(F.col(by).isin(list(keys)))
    if cluster_by:
        chosen = chosen.repartitionByRange(by, *cluster_by).sortWithinPartitions(by, *cluster_by)
    # Observed last: the sampling pass of the range split would be counted too.
    (
        chosen.observe(seen, F.count(F.lit(1)).alias("rows"), *flags)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )
    got = seen.get
    for i, k in enumerate(keys):
        if not got[f"k{i}"]:
            delete_path(spark, f"{path}/{by}={k}")
    return got["rows"]


Check = Callable[[DataFrame], DataFrame]


def failing(checks: Sequence[Check], staged: DataFrame) -> list:
    """Rows of the checks that did not pass; each check returns a handful of rows."""
    out = []
    for check in checks:
        out += check(staged).where(~F.coalesce("passed", F.lit(False))).collect()
    return out


def load_verified(
    df: DataFrame,
    path: str,
    by: str,
    keys: Sequence[str],
    checks: Sequence[Check],
    cluster_by: Sequence[str] = (),
) -> int:
    """Write to a staging folder, run the checks there, publish only when all of them pass.

    Readers never see rejected rows, not even for a moment.
    """
    spark = df.sparkSession
    staging = new_folder(spark, "staging")
    df.write.parquet(staging)
    staged = spark.read.schema(df.schema).parquet(staging)
    try:
        bad = failing(checks, staged)
        if bad:
            raise CheckFailed(bad)
        return replace_partition(staged, path, by, keys, cluster_by)
    finally:
        delete_path(spark, staging)


def delete_rows(spark: SparkSession, path: str, by: str, keys: Sequence[str], where: Column) -> None:
    """Remove the rows matching ``where``; only the given partitions that hold such rows are rewritten.

    The kept rows are staged first, because a table cannot be overwritten while it is read.
    """
    table = spark.read.parquet(path).where(F.col(by).isin(list(keys)))
    hit = F.coalesce(where, F.lit(False))
    touched = [r[0] for r in table.where(hit).select(by).distinct().collect()]  # at most the given keys
    if not touched:
        return
    staging = new_folder(spark, "staging")
    kept = table.where(F.col(by).isin(touched)).where(~hit)
    try:
        kept.write.parquet(staging)
        replace_partition(spark.read.schema(kept.schema).parquet(staging), path, by, touched)
    finally:
        delete_path(spark, staging)
