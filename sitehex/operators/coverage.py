"""Population and measurement coverage, and grouping of conversations into runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City
from sitehex.operators.atscale import bucketed_running_sum
from sitehex.operators.scoring import in_cities


def population_totals(population: DataFrame) -> DataFrame:
    return population.groupBy("country").agg(
        F.sum(F.col("population").cast("double")).alias("total"), F.count("*").alias("hexes")
    )


def poi_cells_with_population_pct(
    places: DataFrame, population: DataFrame, cities: Sequence[City] = CITIES
) -> DataFrame:
    """Percentage of cells holding places that also hold people."""
    cells = in_cities(places, cities).select("city", "h3_8").distinct()
    people = population.groupBy("h3_8").agg(F.max("population").alias("pop"))
    return (
        cells.join(people, "h3_8", "left")
        .groupBy("city")
        .agg(F.bround(F.count_if(F.col("pop") > 0) * 100.0 / F.count("*"), 1).alias("pct_with_population"))
    )


def measured_coverage(surface: DataFrame) -> DataFrame:
    """Measured cells, and their share of cells and of people, per city."""
    measured = F.col("acc_pop").isNotNull()
    return surface.groupBy("city").agg(
        F.count_if(measured).alias("measured_cells"),
        F.count("*").alias("cells"),
        F.bround(F.count_if(measured) * 100.0 / F.count("*"), 1).alias("pct_cells"),
        F.bround(
            F.sum(F.when(measured, F.col("pop")).otherwise(0.0)) * 100.0 / F.sum("pop"), 1
        ).alias("pct_population"),
    )


RUN_BUCKET = 4096


def run_history(turns: DataFrame) -> DataFrame:
    """Group turns into runs: every user turn opens one and later assistant turns belong to it.

    ``turns`` has ``(conv_id, turn, role, text, layer, tool)``. A run that produced the picks layer
    rebuilt the answer; one with any other layer or interface tool steered it; the rest is talk.
    Turns before the first user turn belong to no run. Run numbers come from bucketed sums, so one
    endless conversation does not end up in one task.
    """
    numbered = bucketed_running_sum(
        turns.where(F.col("role").isin("user", "assistant")),
        ["conv_id"],
        [F.floor(F.col("turn") / RUN_BUCKET**2), F.floor(F.col("turn") / RUN_BUCKET)],
        [F.col("turn").asc()],
        (F.col("role") == "user").cast("bigint"),
        "run",
    )
    return (
        numbered.where(F.col("run") > 0)
        .groupBy("conv_id", "run")
        .agg(
            F.min("turn").alias("first_turn"),
            F.count("*").alias("turns"),
            F.max(F.when(F.col("role") == "user", F.length("text"))).cast("bigint").alias("question_chars"),
            F.coalesce(F.max((F.col("layer") == "picks").cast("int")), F.lit(0)).alias("_rebuilt"),
            F.count_if(F.col("layer").isNotNull() | F.col("tool").isNotNull()).alias("_steered"),
        )
        .select(
            "conv_id", "run", "first_turn", "turns", "question_chars",
            F.when(F.col("_rebuilt") == 1, "rebuild").when(F.col("_steered") > 0, "steer").otherwise("talk").alias("kind"),
        )
    )
