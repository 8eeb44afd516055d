"""Market momentum from monthly counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A trend needs a year of months, and moves past +/- 8 percent to have a direction.
MIN_MONTHS = 12
RISING_PCT = 8
SATURATING_PCT = -8


def momentum_rollup(poi_history: DataFrame) -> DataFrame:
    """First and last month with their counts; idempotent, so parts can be merged repeatedly."""
    first = F.min(F.struct("month", "count"))
    last = F.max(F.struct("month", "count"))
    return (
        poi_history.groupBy("city", "category")
        .agg(first.alias("_f"), last.alias("_l"))
        .select(
            "city", "category",
            F.col("_f.count").alias("first_count"), F.col("_l.count").alias("last_count"),
            F.col("_f.month").alias("first_month"), F.col("_l.month").alias("last_month"),
        )
    )


def merge_momentum(parts: DataFrame) -> DataFrame:
    """Finalise rollup parts written by separate batches."""
    return (
        parts.groupBy("city", "category")
        .agg(
            F.min(F.struct("first_month", "first_count")).alias("_f"),
            F.max(F.struct("last_month", "last_count")).alias("_l"),
        )
        .select(
            "city", "category",
            F.col("_f.first_count").alias("first_count"), F.col("_l.last_count").alias("last_count"),
            F.col("_f.first_month").alias("first_month"), F.col("_l.last_month").alias("last_month"),
        )
    )


def pct_change(first: str = "first_count", last: str = "last_count") -> Column:
    return F.bround(
        F.lit(100.0) * (F.col(last) - F.col(first)) / F.nullif(F.col(first), F.lit(0).cast("bigint")), 1
    )


def momentum_all(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        "city", "category", "first_count", "last_count", "first_month", "last_month",
        pct_change().alias("pct_change"),
    )


def category_trend(requests: DataFrame, poi_history: DataFrame, rollup: DataFrame) -> DataFrame:
    """Direction, change and monthly series for each requested ``(city, category)``.

    A trade without any history still answers: not enough history, no series, no change.
    """
    wanted = requests.select("city", "category").distinct()
    # One entry per calendar month: the list below is as long as the history, not as the data.
    monthly = poi_history.groupBy("city", "category", "month").agg(F.max("count").alias("count"))
    series = monthly.groupBy("city", "category").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("month", "count"))).alias("monthly"),
    )
    out = (
        wanted.join(series, ["city", "category"], "left")
        .join(rollup, ["city", "category"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
        .withColumn("pct", pct_change())
    )
    enough = F.col("n") >= MIN_MONTHS
    usable = enough & (F.coalesce("first_count", F.lit(0).cast("bigint")) > 0)
    direction = (
        F.when(~usable, F.lit("flat"))
        .when(F.col("pct") > RISING_PCT, F.lit("rising"))
        .when(F.col("pct") < SATURATING_PCT, F.lit("saturating"))
        .otherwise(F.lit("flat"))
    )
    return out.select(
        "city", "category", "n", direction.alias("direction"),
        F.when(usable, F.col("pct")).alias("pct_change"),
        F.year("first_month").cast("bigint").alias("from_year"),
        enough.alias("enough_history"),
        F.coalesce("monthly", F.array().cast("array<struct<month:date,count:bigint>>")).alias("monthly"),
    )
