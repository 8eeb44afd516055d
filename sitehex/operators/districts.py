"""Naming cells: division areas as sets of cells, smallest division per tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City, idx_of, matching_cities
from sitehex.functions import geometry as geo
from sitehex.functions import grid as G
from sitehex.operators.catchment import polygon_to_cells
from sitehex.operators.scoring import city_cells

def division_cells(divisions: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """``(city, cell, subtype, nm, poly_area)`` for every cell of a city's box whose centre lies inside a division.

    Each division is cut with the parallels of the cell centres inside the boxes it touches; what lies between two cuts is
    counted off without a test, and the outline is left behind there (see :func:`catchment.polygon_to_cells`).
    """
    def touched(c: City) -> Column:
        return c.overlaps(F.col("bxmin"), F.col("bxmax"), F.col("bymin"), F.col("bymax"))

    def side(attr: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for c in cities for x in (c.name, getattr(c, attr))]), F.col("city"))

    here = divisions.select(
        F.explode(matching_cities(touched, cities)).alias("city"),
        "subtype", "nm", "poly_area", "bxmin", "bxmax", "bymin", "bymax", "geometry",
    ).withColumn("_idx", idx_of(F.col("city"), cities))
    box = F.struct(
        side("lon_min").alias("xmin"), side("lon_max").alias("xmax"), side("lat_min").alias("ymin"), side("lat_max").alias("ymax")
    )
    filled = polygon_to_cells(here, "geometry", "_idx", G.BASE_RES, "cell", cities, box)
    centred = G.with_center(filled, "cell", G.BASE_RES, cities=cities)
    return centred.where(geo.bbox_contains("lon", "lat", "bxmin", "bxmax", "bymin", "bymax")).select(
        "city", "cell", "subtype", "nm", "poly_area"
    )


def district_resolution(
    population: DataFrame, divisions: DataFrame, cities: Sequence[City] = CITIES
) -> DataFrame:
    """``(h3_8, area, locality, city)`` for every populated cell inside at least one division.

    Divisions become cells, of which each tier's smallest division is kept map-side, and meet populated cells by equality. A
    tier without a hit is an empty string: an unnamed cell never borrows its neighbour's name.
    """

    def smallest(tier: str) -> Column:
        best = F.min(F.when(F.col("subtype") == tier, F.struct("poly_area", "nm")))
        return F.coalesce(best["nm"], F.lit(""))

    named = (
        division_cells(divisions, cities)
        .groupBy("city", "cell")
        .agg(smallest("macrohood").alias("area"), smallest("locality").alias("locality"))
    )
    return (
        city_cells(population, cities)
        .select("city", "cell")
        .distinct()
        .join(named, ["city", "cell"])
        .select(F.col("cell").alias("h3_8"), "area", "locality", "city")
    )


def coverage_report(
    population: DataFrame, districts: DataFrame, cities: Sequence[City] = CITIES
) -> DataFrame:
    """Share of populated cells with a name per tier, and cells no division covers."""
    cells = city_cells(population, cities).select("city", "cell")
    names = districts.select("city", F.col("h3_8").alias("cell"), "area", "locality")
    n = F.count("*")
    return (
        cells.join(names, ["city", "cell"], "left")
        .groupBy("city")
        .agg(
            n.alias("populated_cells"),
            F.bround(F.count_if(F.col("locality") != "") * 100.0 / n, 1).alias("pct_with_locality"),
            F.bround(F.count_if(F.col("area") != "") * 100.0 / n, 1).alias("pct_with_area"),
            F.count_if((F.coalesce("area", F.lit("")) == "") & (F.coalesce("locality", F.lit("")) == "")).alias(
                "with_no_name_at_all"
            ),
        )
    )
