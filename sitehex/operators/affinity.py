"""Editorial neighbourhood fit. Shown next to a pick, never part of its score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City
from sitehex.functions import grid as G
from sitehex.operators.atscale import broadcast_bounded
from sitehex.operators.scoring import in_cities
from sitehex.reference_data import affinity_table

# The group "food and drink" has no single target trade.
GROUP_TARGET = "restaurant"


def _bounded(table: DataFrame, own: bool) -> DataFrame:
    """Broadcast hint for the package's own matrix of 61 rows; a caller's table is left to the optimizer."""
    return F.broadcast(table) if own else table


def weights_for(affinity: DataFrame, target: str) -> DataFrame:
    return affinity.where(F.col("target") == target).select(F.col("neighbor").alias("category"), "weight")


def lookup_weight(pairs: DataFrame, affinity: DataFrame | None = None) -> DataFrame:
    """Weight of every (target, category) pair; 0 on a miss. The matrix is a fixed 61 rows."""
    table = affinity_table(pairs.sparkSession) if affinity is None else affinity
    table = table.select("target", F.col("neighbor").alias("category"), "weight")
    return pairs.join(_bounded(table, affinity is None), ["target", "category"], "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0.0))
    )


def affinity_fit(
    picks: DataFrame,
    places: DataFrame,
    target: str,
    affinity: DataFrame | None = None,
    cities: Sequence[City] = CITIES,
    picks_bound: int | None = None,
) -> DataFrame:
    """Weighted count of complementary places around each pick and its three strongest trades.

    ``picks`` has ``(city, cell)``. A pick without any stays in the result with fit 0 and an empty
    list. Places are filtered to weighted trades and to the picks' rings, then collapsed per
    (cell, trade). ``picks_bound`` is a proven limit on the number of picks, such as the page size of
    a ranking; with it the places are never shuffled before they are filtered.
    """
    table = affinity_table(picks.sparkSession) if affinity is None else affinity
    w = _bounded(weights_for(table, target), affinity is None)
    chosen = picks.select("city", F.col("cell").alias("pick")).distinct()
    ring = chosen.select("city", "pick", F.explode(G.cell_ring("pick")).alias("h3_8"))
    rings_bound = None if picks_bound is None else 7 * picks_bound
    cells = broadcast_bounded(ring.select("city", "h3_8").distinct(), rings_bound)
    trades = (
        in_cities(places, cities)
        .join(w, "category")
        .join(cells, ["city", "h3_8"], "left_semi")
        .groupBy("city", "h3_8", "category", "weight")
        .agg(F.count("*").alias("n"))
    )
    per_cat = (
        broadcast_bounded(ring, rings_bound)
        .join(trades, ["city", "h3_8"])
        .groupBy("city", "pick", "category", "weight")
        .agg(F.sum("n").alias("n"))
    )
    strength = Window.partitionBy("city", "pick").orderBy(
        (F.col("n") * F.col("weight")).desc(), F.col("category").asc()
    )
    entry = F.struct("position", "category", "n", F.bround("weight", 2).alias("w"))
    # At most one row per matrix entry reaches a pick, so the list below is bounded by the matrix.
    fit = (
        per_cat.withColumn("position", F.row_number().over(strength))
        .groupBy("city", "pick")
        .agg(
            F.sum(F.col("n") * F.col("weight")).alias("_fit"),
            F.array_sort(F.collect_list(F.when(F.col("position") <= 3, entry))).alias("_top"),
        )
    )
    return chosen.join(fit, ["city", "pick"], "left").select(
        "city",
        "pick",
        F.bround(F.coalesce("_fit", F.lit(0.0)), 2).alias("fit"),
        F.transform(
            F.coalesce("_top", F.array().cast("array<struct<position:int,category:string,n:bigint,w:double>>")),
            lambda e: F.struct(e["category"].alias("category"), e["n"].alias("n"), e["w"].alias("w")),
        ).alias("top_neighbours"),
    )


def affinity_surface(
    places: DataFrame,
    target: str,
    affinity: DataFrame | None = None,
    cities: Sequence[City] = CITIES,
) -> DataFrame:
    """Fit of every candidate cell: weights summed per occupied cell, then spread over its ring."""
    table = affinity_table(places.sparkSession) if affinity is None else affinity
    per_cell = (
        in_cities(places, cities)
        .join(_bounded(weights_for(table, target), affinity is None), "category")
        .groupBy("city", "h3_8", "weight")
        .agg(F.count("*").alias("n"))
        .groupBy("city", "h3_8")
        .agg(F.sum(F.col("n") * F.col("weight")).alias("w"))
    )
    return (
        per_cell.select("city", F.explode(G.cell_ring("h3_8")).alias("cell"), "w")
        .groupBy("city", "cell")
        .agg(F.bround(F.sum("w"), 2).alias("fit"))
    )
