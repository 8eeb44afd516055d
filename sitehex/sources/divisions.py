"""Administrative division areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City, any_city
from sitehex.functions import geometry as geo

RAW_SCHEMA = (
    "subtype string, names struct<primary:string,common:map<string,string>>, "
    f"geometry {geo.MULTIPOLYGON}, bbox struct<xmin:float,xmax:float,ymin:float,ymax:float>"
)
TIERS = ("macrohood", "locality")


def ingest_divisions(raw: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Divisions whose box overlaps a city, with display name, box and polygon area.

    The English name wins when there is one, so names read in Latin script.
    """
    box = {k: F.col(f"bbox.{k}") for k in ("xmin", "xmax", "ymin", "ymax")}
    return (
        raw.where(any_city(lambda c: c.overlaps(**box), cities))
        .where(F.col("subtype").isin(*TIERS) & F.col("names.primary").isNotNull())
        .select(
            "subtype",
            F.coalesce(F.nullif(F.try_element_at("names.common", F.lit("en")), F.lit("")), "names.primary").alias("nm"),
            "geometry",
            box["xmin"].cast("double").alias("bxmin"), box["xmax"].cast("double").alias("bxmax"),
            box["ymin"].cast("double").alias("bymin"), box["ymax"].cast("double").alias("bymax"),
            geo.spherical_area_m2("geometry").alias("poly_area"),
        )
    )
