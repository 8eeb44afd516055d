"""Buildings, addresses and road segments: the demand-side inputs and their per-cell rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City, idx_of
from sitehex.functions import geometry as geo
from sitehex.functions import grid as G
from sitehex.reference_data import ROAD_CLASSES, WALK_CLASSES
from sitehex.sources.places import tag_cities, with_cells

RAW_BUILDINGS = (
    f"id string, height double, num_floors int, subtype string, geometry {geo.MULTIPOLYGON}, "
    "bbox struct<xmin:float,xmax:float,ymin:float,ymax:float>"
)
METRES_PER_STOREY = 3


def _box_centre(axis: str) -> Column:
    return (F.col(f"bbox.{axis}min").cast("double") + F.col(f"bbox.{axis}max").cast("double")) / 2


def ingest_buildings(raw: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Footprints with their spherical area decoded once; readers never touch the geometry."""
    flat = tag_cities(raw, cities).select(
        F.coalesce("id", F.lit("")).alias("id"),
        "city",
        _box_centre("x").alias("lon"),
        _box_centre("y").alias("lat"),
        "height",
        "num_floors",
        geo.spherical_area_m2("geometry").alias("area_m2"),
        F.coalesce("subtype", F.lit("")).alias("subtype"),
    )
    return with_cells(flat, cities)


# Floor area is accumulated in whole square centimetres: integer sums give the same rollup in
# whatever order partitions, batches or replays arrive.
FIXED_POINT = 10000.0


def floor_area_units() -> Column:
    """Area times storeys in fixed-point units: surveyed floors, else height / 3, else one."""
    storeys = F.coalesce(
        F.col("num_floors").cast("double"), F.col("height") / METRES_PER_STOREY, F.lit(1.0)
    )
    return F.floor(F.col("area_m2") * storeys * FIXED_POINT + 0.5).cast("bigint")


def capacity_rollup(buildings: DataFrame) -> DataFrame:
    """Estimated floor area and building count per (city, cell)."""
    return buildings.groupBy("city", "h3_8").agg(
        (F.sum(floor_area_units()) / FIXED_POINT).alias("floor_area_m2"),
        F.count("*").alias("buildings"),
    )


def merge_capacity(parts: DataFrame) -> DataFrame:
    """Finalise rollup parts written by separate batches (sums add, so each part counts once)."""
    units = F.floor(F.col("floor_area_m2") * FIXED_POINT + 0.5).cast("bigint")
    return parts.groupBy("city", "h3_8").agg(
        (F.sum(units) / FIXED_POINT).alias("floor_area_m2"), F.sum("buildings").alias("buildings")
    )


def address_density(raw: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Address points per (city, cell)."""
    tagged = tag_cities(raw, cities)
    at = G.with_cell(tagged, "geometry.lon", "geometry.lat", idx_of(F.col("city"), cities), {"h3_8": 8}, cities)
    return at.groupBy("city", "h3_8").agg(F.count("*").alias("addr_count"))


def road_density(raw: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Segments and approximate lengths (box diagonals, kept in whole millimetres) per cell."""
    roads = tag_cities(raw.where(F.col("subtype") == "road"), cities)
    at = G.with_cell(roads, _box_centre("x"), _box_centre("y"), idx_of(F.col("city"), cities), {"h3_8": 8}, cities)
    corners = [F.col(f"bbox.{c}").cast("double") for c in ("xmin", "ymin", "xmax", "ymax")]
    mm = F.floor(geo.great_circle_m(*corners) * 1000.0 + 0.5).cast("bigint")

    def length(classes) -> Column:
        return F.sum(F.when(F.col("class").isin(*classes), F.col("_mm")).otherwise(F.lit(0))) / 1000.0

    return (
        at.select("city", "h3_8", "class", mm.alias("_mm"))
        .groupBy("city", "h3_8")
        .agg(
            F.count("*").alias("seg_count"),
            length(ROAD_CLASSES).alias("road_len_m"),
            length(WALK_CLASSES).alias("walk_len_m"),
        )
    )
