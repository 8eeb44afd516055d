"""Building blocks that keep results exact when one key holds a large share of all rows.

``percentile`` and an unbounded window both end in one task per group. The functions here get
the same answers from partial aggregates plus a small remainder per task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A relation is hinted for broadcast only when the caller can prove at most this many short rows.
BROADCAST_ROWS = 50_000

SKETCH_ACCURACY = 10_000


def broadcast_bounded(df: DataFrame, rows_bound: int | None) -> DataFrame:
    """Broadcast hint behind a proven row bound; otherwise leave the choice to AQE."""
    if rows_bound is not None and rows_bound <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def settle(df: DataFrame) -> DataFrame:
    """Fix computed columns as values before a filter that mentions them many times.

    Catalyst moves a filter below the projection it reads from and copies the expressions into
    every mention; inside a per-vertex polygon test that repeats them for each vertex.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def linear_position(n: Column, q: float) -> Column:
    """Zero-based rank of a linearly interpolated quantile."""
    return (n - 1) * F.lit(q)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    groups_bound: int | None = None,
    position: Callable[[Column, float], Column] = linear_position,
) -> DataFrame:
    """Interpolated quantiles per group, one column per entry of ``quantiles``.

    A mergeable sketch brackets each wanted rank. A second pass collapses everything below and above
    the bracket map-side, to a count and the value next to the bracket, and keeps distinct values only
    inside it: about 0.1 % of the group, which then meet to locate the rank exactly. The plan is the
    same for every size of input. NULL values are ignored; a group without values is absent from the
    result. ``position`` gives the wanted rank from the number of values and must stay within one rank
    of the linear one.
    """
    keys = list(keys)
    margin = 4.0 / SKETCH_ACCURACY
    names = list(quantiles)
    probs: list[float] = []
    for name in names:
        probs += [max(0.0, quantiles[name] - margin), min(1.0, quantiles[name] + margin)]

    vals = settle(df.select(*keys, F.col(value).cast("double").alias("_v"))).where(F.col("_v").isNotNull())
    sketch = vals.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", probs, SKETCH_ACCURACY).alias("_q"))
    brackets = sketch.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("_name"),
                        position(F.col("_n"), quantiles[name]).cast("double").alias("_pos"),
                        F.col("_n").alias("_rows"),
                        F.get("_q", F.lit(2 * i)).alias("_lo"),
                        F.get("_q", F.lit(2 * i + 1)).alias("_hi"),
                    )
                    for i, name in enumerate(names)
                ]
            )
        ),
    )
    bound = None if groups_bound is None else groups_bound * len(names)
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    counted = (
        vals.join(broadcast_bounded(brackets, bound), keys)
        .groupBy(*keys, "_name", side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_in"))
        .agg(
            F.count("*").alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"),
            F.max("_pos").alias("_pos"), F.max("_rows").alias("_rows"),
        )
    )
    by_value = Window.partitionBy(*keys, "_name").orderBy("_side", "_in").rowsBetween(Window.unboundedPreceding, 0)
    k = F.floor(F.col("_pos"))

    def at(rank: Column) -> Column:
        # Below the bracket only the last value is known, above it only the first.
        inside = (F.col("_before") <= rank) & (rank < F.col("_upto"))
        known = (
            (F.col("_side") == 0)
            | ((F.col("_side") < 0) & (rank == F.col("_upto") - 1))
            | ((F.col("_side") > 0) & (rank == F.col("_before")))
        )
        return F.max(F.when(inside & known, F.when(F.col("_side") < 0, F.col("_last")).otherwise(F.col("_first"))))

    located = (
        counted.withColumn("_upto", F.sum("_c").over(by_value))
        .withColumn("_before", F.col("_upto") - F.col("_c"))
        .groupBy(*keys, "_name")
        .agg(at(k).alias("_x0"), at(k + 1).alias("_x1"), F.max("_pos").alias("_pos"), F.max("_rows").alias("_rows"))
    )
    missed = F.raise_error(F.lit("quantile rank fell outside its sketch bracket")).cast("double")
    x0 = F.coalesce("_x0", missed)
    x1 = F.when((k + 1 >= F.col("_rows")) | (k == F.col("_pos")), x0).otherwise(F.coalesce("_x1", missed))
    exact = located.withColumn("_value", x0 + (x1 - x0) * (F.col("_pos") - k))
    if len(names) == 1:
        return exact.select(*keys, F.col("_value").alias(names[0]))
    return exact.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in names]
    )


def bucketed_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column],
    value: Column,
    out: str,
) -> DataFrame:
    """Running sum of ``value`` per key in ``order``, from bucket offsets.

    Each bucket expression must be monotone in ``order`` among rows that share the buckets before
    it. Only bucket totals meet in a window, level by level, and rows meet only inside the finest
    bucket: a key, or a bucket of ties, that holds a third of the data still spreads over many
    tasks.
    """
    keys = list(keys)
    names = [f"_bucket{i}" for i in range(len(buckets))]
    tagged = df.withColumns(dict(zip(names, buckets))).withColumn("_value", value)
    totals = tagged.groupBy(*keys, *names).agg(F.sum("_value").alias("_total"))
    out_so_far = F.lit(0)
    offsets = totals.select(*keys, *names, "_total")
    for level, name in enumerate(names):
        # Totals of this level's buckets within the enclosing bucket, then those before each one.
        scope = keys + names[:level]
        level_totals = totals.groupBy(*scope, name).agg(F.sum("_total").alias("_t"))
        earlier = Window.partitionBy(*scope).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        before = level_totals.select(*scope, name, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias(f"_o{level}"))
        offsets = offsets.join(before, [*scope, name])
        out_so_far = out_so_far + F.col(f"_o{level}")
    offsets = offsets.select(*keys, *names, out_so_far.alias("_offset"))
    within = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.join(offsets, [*keys, *names])
        .withColumn(out, F.col("_offset") + F.sum("_value").over(within))
        .drop(*names, "_value", "_offset")
    )


def checkpoint_dir(spark) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``.

    Where the setting is absent a private folder is made, but only in local mode, where driver and
    tasks share one disk. On a cluster that would scatter the files, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: columnar, prunable and safe against lost executors."""
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Zero-based rank of every row of a key in ``order``, with keys and ties spread over range partitions.

    Partition bounds come from the data, so neither a key with most rows nor values far from all others
    fill one task. Only row counts per key and partition meet in a window.
    """
    part = "_part"
    dealt = cut_lineage(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, part).orderBy(*order)
    return (
        dealt.withColumn("_row", F.row_number().over(within))
        .join(offsets, [*keys, part])
        .withColumn(out, F.col("_offset") + F.col("_row") - 1)
        .drop(part, "_row", "_offset")
    )


def new_folder(spark, purpose: str) -> str:
    """A fresh path below the shared folder, for tables that outlive one job."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark, path: str) -> None:
    """Delete a staging folder through the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
