"""Walk reach files: contour and street-edge documents produced by a routing run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UINT16_MAX = 65535

_CONTOURS = (
    "struct<features:array<struct<properties:struct<contour:int>,"
    "geometry:struct<type:string,coordinates:string>>>>"
)
_EDGES = (
    "struct<features:array<struct<properties:struct<duration:double,distance:double>,"
    "geometry:struct<type:string,coordinates:string>>>>"
)


def ingest_contours(raw: DataFrame) -> DataFrame:
    """One row per contour lobe from ``(origin_h3_9, city, body)`` documents.

    Every lobe is kept. Features without a contour or without coordinates are not contours.
    """
    f = raw.select("origin_h3_9", "city", F.explode(F.from_json("body", _CONTOURS)["features"]).alias("f"))
    coords = F.col("f.geometry.coordinates")
    lobes = F.when(
        F.col("f.geometry.type") == "MultiPolygon",
        F.from_json(coords, "array<array<array<array<double>>>>"),
    ).otherwise(F.array(F.from_json(coords, "array<array<array<double>>>")))
    return (
        f.where(F.col("f.properties.contour").isNotNull() & coords.isNotNull() & (coords != "[]"))
        .select("origin_h3_9", F.col("f.properties.contour").alias("minutes"), F.explode(lobes).alias("_lobe"), "city")
        .select("origin_h3_9", "minutes", F.to_json("_lobe").alias("geojson"), "city")
    )


def ingest_edges(raw: DataFrame) -> DataFrame:
    """One row per street edge from ``(origin_h3_9, city, body)`` documents.

    Only line strings of at least two points; seconds and metres are rounded and clamped to the
    unsigned 16-bit range, coordinates keep five decimals.
    """
    f = raw.select("origin_h3_9", "city", F.explode(F.from_json("body", _EDGES)["features"]).alias("f"))
    line = f.where(F.col("f.geometry.type") == "LineString").withColumn(
        "_pts", F.from_json("f.geometry.coordinates", "array<array<double>>")
    )

    def clamped(field):
        return F.least(F.bround(F.coalesce(f"f.properties.{field}", F.lit(0.0))), F.lit(float(UINT16_MAX))).cast("int")

    rounded = F.transform("_pts", lambda p: F.transform(F.slice(p, 1, 2), lambda v: F.bround(v, 5)))
    return line.where(F.size("_pts") >= 2).select(
        "origin_h3_9",
        clamped("duration").alias("duration_s"),
        clamped("distance").alias("dist_m"),
        F.to_json(rounded).alias("geom"),
        "city",
    )


def write_edges(edges: DataFrame, path: str) -> None:
    """Cluster by origin so one pick's web is a short contiguous read, nearest edges first."""
    (
        edges.repartitionByRange("city", "origin_h3_9")
        .sortWithinPartitions("city", "origin_h3_9", "duration_s")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("city")
        .parquet(path)
    )
