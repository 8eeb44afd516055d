"""Read-outs of a scored surface: layer rows, statistics, extremes, tiles, reveal order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City
from sitehex.functions import geometry as geo
from sitehex.functions import grid as G
from sitehex.operators.atscale import broadcast_bounded, exact_quantiles, range_ranks
from sitehex.operators.scoring import NEUTRAL, display_gap, in_cities


def opportunity_rows(surface: DataFrame) -> DataFrame:
    """Typed attributes of every scored cell; ``acc`` only where it was measured."""
    return surface.select(
        "city",
        "cell",
        F.bround("gap", 1).alias("gap"),
        "dem",
        F.bround("pop").alias("pop"),
        "sup",
        F.bround("acc_pop").alias("acc"),
    )


def opportunity_layer(surface: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """One polygon feature per scored cell."""
    ring = geo.polygon_geometry(G.cell_boundary("cell", G.BASE_RES, cities))
    props = F.struct("gap", "dem", "pop", "sup", "acc")
    return opportunity_rows(surface).select("city", "cell", geo.feature_json(ring, props).alias("feature"))


def opportunity_stats(surface: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Per city: cells, top and median gap, the scales, and how many cells were not measured."""
    base = surface.groupBy("city").agg(
        F.count("*").alias("cell_count"),
        F.bround(F.max("gap"), 1).alias("top_gap"),
        F.any_value("pop_p95").alias("pop_p95"),
        F.any_value("sup_p95").alias("sup_p95"),
        F.any_value("acc_p95").alias("acc_p95"),
        F.count_if(F.col("acc_pop").isNull()).alias("not_measured"),
    )
    med = exact_quantiles(surface, ["city"], "gap", {"m": 0.5}, len(cities))
    return base.join(broadcast_bounded(med, len(cities)), "city").select(
        "city", "cell_count", "top_gap", F.bround("m", 1).alias("median_gap"),
        "pop_p95", "sup_p95", "acc_p95", "not_measured",
    )


def extreme_cell(
    surface: DataFrame,
    which: str = "best",
    weights: Mapping[str, float] = NEUTRAL,
    cities: Sequence[City] = CITIES,
) -> DataFrame:
    """The single best or worst displayed cell of each city, with the centroid of its ring."""
    shown = display_gap(surface, weights)
    best = which == "best"
    order = F.struct((-F.col("gap_display") if best else F.col("gap_display")).alias("o"), F.col("cell"))
    top = shown.groupBy("city").agg(F.min(order).alias("_t"))
    at = geo.centroid_of(G.cell_boundary("cell", G.BASE_RES, cities))
    return (
        top.select("city", F.col("_t.cell").alias("cell"), F.col("_t.o").alias("_o"))
        .withColumn("score", -F.col("_o") if best else F.col("_o"))
        .withColumn("_at", at)
        .select("city", "cell", "score", F.col("_at.lon").alias("lon"), F.col("_at.lat").alias("lat"),
                F.lit(which).alias("kind"))
    )


def kpi_strip(
    surface: DataFrame,
    places: DataFrame,
    picks: DataFrame,
    categories: Sequence[str],
    weights: Mapping[str, float] = NEUTRAL,
    cities: Sequence[City] = CITIES,
) -> DataFrame:
    """Competitor count, display score of the best shown pick, median display gap per city.

    A tile without data stays NULL.
    """
    shown = display_gap(surface, weights)
    median = exact_quantiles(shown, ["city"], "gap_display", {"median_opportunity": 0.5}, len(cities))
    rivals = (
        in_cities(places, cities)
        .where(F.col("category").isin(list(categories)))
        .groupBy("city")
        .agg(F.count("*").alias("competitors"))
    )
    first = picks.groupBy("city").agg(F.min_by("cell", "rank").alias("cell"))
    top = first.join(shown.select("city", "cell", F.col("gap_display").alias("top_score")), ["city", "cell"])
    n = len(cities)
    return (
        median.join(broadcast_bounded(rivals, n), "city", "left")
        .join(broadcast_bounded(top.select("city", "top_score"), n), "city", "left")
        .select("city", "competitors", "top_score", "median_opportunity")
    )


def reveal_order(points: DataFrame, groups_bound: int | None = None) -> DataFrame:
    """Rank a layer's features outward from its mean point.

    ``points`` has ``layer, id, lon, lat`` with coordinates already at five decimals. The mean is
    taken over integer 1e-5 degrees and distances are compared at nine decimals, so the order does
    not depend on how rows are spread over tasks. Ranks come from range partitions of distance and id.
    """
    fixed = points.select(
        "layer", F.col("id").cast("string").alias("id"), "lon", "lat",
        F.floor(F.col("lon") * 100000 + 0.5).alias("_x"),
        F.floor(F.col("lat") * 100000 + 0.5).alias("_y"),
    )
    mean = fixed.groupBy("layer").agg(
        (F.sum("_x") / F.count("*") / 100000.0).alias("_cx"),
        (F.sum("_y") / F.count("*") / 100000.0).alias("_cy"),
    )
    dx = (F.col("lon") - F.col("_cx")) * F.cos(F.radians(F.col("_cy")))
    dy = F.col("lat") - F.col("_cy")
    placed = fixed.join(broadcast_bounded(mean, groups_bound), "layer").withColumn(
        "_d", F.round(F.sqrt(dx * dx + dy * dy), 9)
    )
    far = placed.groupBy("layer").agg(F.max("_d").alias("_max"))
    ready = placed.join(broadcast_bounded(far, groups_bound), "layer").withColumn(
        "dist", F.coalesce(F.try_divide("_d", "_max"), F.lit(0.0))
    )
    ranked = range_ranks(ready.select("layer", "id", "_d", "dist"), ["layer"], ["_d", "id"], "idx")
    return ranked.select("layer", "id", "idx", "dist")


def sample_per_city(places: DataFrame, n: int = 5, cities: Sequence[City] = CITIES) -> DataFrame:
    """First ``n`` named places per city by id, with the drift between point and cell centre."""
    first = Window.partitionBy("city").orderBy("id")
    kept = (
        in_cities(places, cities)
        .where(F.col("name") != "")
        .withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= n)
    )
    return G.with_center(kept, "h3_8", G.BASE_RES, "cell_lon", "cell_lat", cities).select(
        "city", "id", "name", "lon", "lat", "cell_lon", "cell_lat",
        geo.geo_distance_m("lon", "lat", "cell_lon", "cell_lat").alias("drift_m"),
    )
