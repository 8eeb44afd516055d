"""Places: ingest from the raw nested Parquet layout, and queries straight on the raw files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City, any_city, idx_of, matching_cities
from sitehex.functions import grid as G
from sitehex.sources.layout import LAYOUTS, laid_out, writer

RAW_SCHEMA = (
    "id string, names struct<primary:string>, categories struct<primary:string>, "
    "confidence double, operating_status string, geometry struct<lon:double,lat:double>, "
    "bbox struct<xmin:float,xmax:float,ymin:float,ymax:float>"
)
MIN_CONFIDENCE = 0.5


def corner_inside(c: City):
    """Range test on the plain-float box corner, the only predicate row groups can prune on."""
    return c.contains(F.col("bbox.xmin").cast("double"), F.col("bbox.ymin").cast("double"))


def _float_bounds(cities: Sequence[City]):
    """Coarse float predicate implied by the exact one; it reaches the Parquet reader."""
    pad = 0.001
    return any_city(
        lambda c: (F.col("bbox.xmin") >= F.lit(c.lon_min - pad).cast("float"))
        & (F.col("bbox.xmin") <= F.lit(c.lon_max + pad).cast("float"))
        & (F.col("bbox.ymin") >= F.lit(c.lat_min - pad).cast("float"))
        & (F.col("bbox.ymin") <= F.lit(c.lat_max + pad).cast("float")),
        cities,
    )


def tag_cities(raw: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """One row per (record, city whose box holds its corner)."""
    return (
        raw.where(_float_bounds(cities))
        .withColumn("city", F.explode(matching_cities(corner_inside, cities)))
    )


def with_cells(df: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Derive the res-8 and res-9 cells once, at write time, so no reader recomputes them."""
    return G.with_cell(df, "lon", "lat", idx_of(F.col("city"), cities), {"h3_8": 8, "h3_9": 9}, cities)


def ingest_places(raw: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Open, confident places of every city in one scan."""
    kept = raw.where(F.coalesce("confidence", F.lit(0.0)) >= MIN_CONFIDENCE).where(
        F.coalesce("operating_status", F.lit("open")) != "closed"
    )
    flat = tag_cities(kept, cities).select(
        "id",
        F.coalesce("names.primary", F.lit("")).alias("name"),
        F.coalesce("categories.primary", F.lit("")).alias("category"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.col("geometry.lon").alias("lon"),
        F.col("geometry.lat").alias("lat"),
        "city",
    )
    return with_cells(flat, cities)


def write_places(places: DataFrame, path: str, partitions: int | None = None, row_group_bytes: int | None = None) -> None:
    """Partition by city and range-cluster by the space-filling key, so a box stays contiguous.

    Ranges are cut on (city, key): a dense city is spread over as many tasks as it needs.
    """
    out = writer(laid_out(places, LAYOUTS["places"], partitions), LAYOUTS["places"], row_group_bytes)
    out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def raw_category_histogram(raw: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Category counts straight from raw files; the box prunes row groups, nothing is ingested."""
    return (
        tag_cities(raw, cities)
        .groupBy("city", F.col("categories.primary").alias("category"))
        .agg(F.count("*").alias("n"))
    )


def raw_cell_density(raw: DataFrame, category: str, cities: Sequence[City] = CITIES) -> DataFrame:
    """Places of one category per cell, straight from raw files."""
    hits = tag_cities(raw.where(F.col("categories.primary") == category), cities)
    at = G.with_cell(hits, "geometry.lon", "geometry.lat", idx_of(F.col("city"), cities), {"cell": 8}, cities)
    return at.groupBy("city", "cell").agg(F.count("*").alias("n"))
