"""The set of derived tables the read-side operators work on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Tables:
    """Lazily read DataFrames; operators use only the ones they need.

    places(id, name, category, confidence, lon, lat, city, h3_8, h3_9)
    population(h3_8, population, country)
    cell_capacity(city, h3_8, floor_area_m2, buildings)
    addr_density(city, h3_8, addr_count)
    isochrone_cells(origin_h3_9, minutes, reachable_h3_9, city)
    isochrones(origin_h3_9, minutes, geojson, city)
    isochrone_edges(origin_h3_9, duration_s, dist_m, geom, city)
    districts(h3_8, area, locality, city)
    poi_history(city, category, month, count)
    saved_sites(id, user_id, city, business_type, label, note, lon, lat, h3_8, score, status,
                created_at, updated_at)
    """

    places: DataFrame | None = None
    population: DataFrame | None = None
    cell_capacity: DataFrame | None = None
    addr_density: DataFrame | None = None
    isochrone_cells: DataFrame | None = None
    isochrones: DataFrame | None = None
    isochrone_edges: DataFrame | None = None
    districts: DataFrame | None = None
    poi_history: DataFrame | None = None
    saved_sites: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> "Tables":
        """Open a warehouse written by ``sitehex.plans.refresh`` (missing tables stay ``None``)."""
        from sitehex.sources.versions import open_table, pointer

        published = pointer(spark, root)[1]
        return cls(**{name: open_table(spark, root, name) for name in cls.__dataclass_fields__ if name in published})
