"""Map layers over the stored tables: built capacity and competitors, with cheap statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City
from sitehex.functions import geometry as geo
from sitehex.functions import grid as G
from sitehex.operators.atscale import broadcast_bounded, exact_quantiles
from sitehex.operators.scoring import in_cities

# Fractions of the layer's p95 at which the colour stops lie.
RAMP_STOPS = (0.0, 0.15, 0.4, 0.7, 1.0)


def capacity_rows(cell_capacity: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Finalised rollup: whole square metres and building count per cell."""
    return (
        in_cities(cell_capacity, cities)
        .groupBy("city", F.col("h3_8").alias("cell"))
        .agg(F.sum("floor_area_m2").alias("_f"), F.sum("buildings").alias("buildings"))
        .select("city", "cell", F.bround("_f").cast("bigint").alias("floor"), "buildings")
    )


def capacity_layer(cell_capacity: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    ring = geo.polygon_geometry(G.cell_boundary("cell", G.BASE_RES, cities))
    return capacity_rows(cell_capacity, cities).select(
        "city", "cell", geo.feature_json(ring, F.struct("floor", "buildings")).alias("feature")
    )


def capacity_stats(cell_capacity: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    cells = in_cities(cell_capacity, cities).select("city", F.col("h3_8").alias("cell")).distinct()
    return (
        G.with_center(cells, "cell", G.BASE_RES, cities=cities)
        .groupBy("city")
        .agg(
            F.count("*").alias("cell_count"),
            F.bround(F.min("lon"), 5).alias("min_lon"),
            F.bround(F.min("lat"), 5).alias("min_lat"),
            F.bround(F.max("lon"), 5).alias("max_lon"),
            F.bround(F.max("lat"), 5).alias("max_lat"),
        )
    )


def capacity_ramp(cell_capacity: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Share of the layer's own p95 and the colour stop each cell falls on.

    The p95 here is the value at index ``min(n-1, floor(n * 0.95))`` of the sorted layer.
    """
    rows = capacity_rows(cell_capacity, cities)
    n = len(cities)
    picked = exact_quantiles(
        rows, ["city"], "floor", {"p95": 0.95}, n, lambda count, q: F.least(count - 1, F.floor(count * F.lit(q)))
    )
    p95 = picked.select("city", F.greatest(F.col("p95").cast("bigint"), F.lit(1).cast("bigint")).alias("p95"))
    share = F.col("floor") / F.col("p95").cast("double")
    return (
        rows.join(broadcast_bounded(p95, n), "city")
        .withColumn("share", share)
        .withColumn("stop", ramp_stop(F.col("share")))
        .select("city", "cell", "floor", "p95", "share", "stop")
    )


def ramp_stop(share: Column) -> Column:
    """Highest stop at or below the share."""
    out = F.when(share >= RAMP_STOPS[-1], F.lit(RAMP_STOPS[-1]))
    for s in reversed(RAMP_STOPS[:-1]):
        out = out.when(share >= s, F.lit(s))
    return out


def competitors(
    places: DataFrame, categories: Sequence[str], cities: Sequence[City] = CITIES, box: Sequence[float] | None = None
) -> DataFrame:
    """Places of a trade; of a ``box`` (west, east, south, north) only those inside, read where the table holds them."""
    hits = in_cities(places, cities).where(F.col("category").isin(list(categories)))
    if box is None:
        return hits
    west, east, south, north = box
    return hits.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def competitors_layer(
    places: DataFrame, categories: Sequence[str], cities: Sequence[City] = CITIES, box: Sequence[float] | None = None
) -> DataFrame:
    feature = geo.feature_json(geo.point_geometry("lon", "lat"), F.struct(F.col("name").alias("n")))
    return competitors(places, categories, cities, box).select("city", "id", feature.alias("feature"))


def competitors_bbox(places: DataFrame, categories: Sequence[str], cities: Sequence[City] = CITIES) -> DataFrame:
    """Frame and row count in one pass; a city without competitors has no row (no data)."""
    return (
        competitors(places, categories, cities)
        .groupBy("city")
        .agg(
            F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"),
            F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"),
            F.count("*").alias("n"),
        )
    )
