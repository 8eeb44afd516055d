"""Population per res-8 cell, keyed by country."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City, idx_of, matching_cities
from sitehex.functions import grid as G

RAW_SCHEMA = "h3 string, population float, country string"


def read_tsv(spark, path: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA).option("sep", "\t").csv(path)


def ingest_population(raw: DataFrame) -> DataFrame:
    """Populated cells only; hex text becomes the 64-bit id every join uses."""
    return raw.where(F.col("population") > 0).select(
        G.cell_from_string("h3").alias("h3_8"), F.col("population").cast("float").alias("population"), "country"
    )


def rekey_population(raw: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Population of real H3 cells on the lattice, by the centroids (lon, lat) that come with them.

    Lattice neighbours and outlines exist for lattice ids only, so real ids never reach the scored
    tables. Cells outside every city box have no lattice and are left out; people of cells that fall
    into one lattice cell are added up.
    """
    inside = raw.where(F.col("population") > 0).select(
        "population", "country", "lon", "lat",
        F.explode(matching_cities(lambda c: (F.col("country") == c.country) & c.contains(F.col("lon"), F.col("lat")), cities)).alias("_city"),
    )
    placed = G.with_cell(inside, "lon", "lat", idx_of(F.col("_city"), cities), {"h3_8": G.BASE_RES}, cities)
    return placed.groupBy("h3_8", "country").agg(F.sum("population").cast("float").alias("population"))
