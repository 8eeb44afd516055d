import math

import pytest
from pyspark.sql import functions as F

from sitehex.functions import geometry as geo
from sitehex.functions.text import district_matches, half_up_1dp, lens_label, place_name


def ring(*pts):
    return [{"lon": float(x), "lat": float(y)} for x, y in pts]


SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
HOLE = ring((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))
FAR = ring((10, 10), (12, 10), (11, 12), (10, 10))


@pytest.fixture(scope="module")
def shape(spark):
    return spark.createDataFrame([([[SQUARE, HOLE], [FAR]],)], f"g {geo.MULTIPOLYGON}")


@pytest.mark.parametrize(
    "lon,lat,inside",
    [(0.5, 0.5, True), (2, 2, False), (3.5, 3.9, True), (11, 10.5, True), (11.9, 11.9, False), (-1, 2, False), (5, 2, False)],
)
def test_point_in_polygon(shape, lon, lat, inside):
    assert shape.select(geo.point_in_polygon(F.lit(float(lon)), F.lit(float(lat)), "g").alias("x")).first().x is inside


def test_area_subtracts_holes_and_adds_parts(spark, shape):
    def area(parts):
        df = spark.createDataFrame([(parts,)], f"g {geo.MULTIPOLYGON}")
        return df.select(geo.spherical_area_m2("g").alias("a")).first().a

    whole = area([[SQUARE, HOLE], [FAR]])
    assert whole == pytest.approx(area([[SQUARE]]) - area([[HOLE]]) + area([[FAR]]), rel=1e-12)
    # A small square near the equator is flat for all practical purposes.
    flat = area([[ring((0, 0), (0.01, 0), (0.01, 0.01), (0, 0.01), (0, 0))]])
    assert flat == pytest.approx((math.radians(0.01) * geo.EARTH_RADIUS_M) ** 2, rel=1e-6)
    # Winding does not matter.
    assert area([[list(reversed(SQUARE))]]) == pytest.approx(area([[SQUARE]]), rel=1e-12)


def test_distances_agree_within_tolerance(spark):
    df = spark.createDataFrame([(13.4, 52.5, 13.41, 52.51)], "a double, b double, c double, d double")
    row = df.select(geo.great_circle_m("a", "b", "c", "d").alias("g"), geo.geo_distance_m("a", "b", "c", "d").alias("e")).first()
    assert row.g == pytest.approx(row.e, rel=0.006)
    assert 1200 < row.g < 1400


def test_bbox_and_centroid(shape):
    row = shape.select(geo.bbox_of("g").alias("b"), geo.centroid_of(F.lit(None).cast("array<struct<lon:double,lat:double>>")).alias("n")).first()
    assert (row.b.xmin, row.b.xmax, row.b.ymin, row.b.ymax) == (0.0, 12.0, 0.0, 12.0)
    c = shape.select(geo.centroid_of(F.get(F.get("g", F.lit(0)), F.lit(0))).alias("c")).first().c
    assert (c.lon, c.lat) == (1.6, 1.6)  # the repeated corner counts twice


def test_feature_omits_absent_properties(spark):
    df = spark.createDataFrame([(13.123456, 52.5, 3, None)], "lon double, lat double, sup int, acc double")
    text = df.select(geo.feature_json(geo.point_geometry("lon", "lat"), F.struct("sup", "acc")).alias("f")).first().f
    assert text == '{"type":"Feature","geometry":{"type":"Point","coordinates":[13.12346,52.5]},"properties":{"sup":3}}'


def test_names_and_badges(spark):
    rows = [("A", "B", "A, B"), ("", "B", "B"), ("A", "A", "A"), ("", "", None), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, l string, want string").withColumn("got", place_name("a", "l"))
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    asked = [("demand", "best", "Mitte", 2, "biggest markets · in Mitte · more · pg 2"), ("balanced", "worst", " ", 1, "avoid · saturated"),
             ("balanced", "best", None, 1, None), ("accessible", "worst", None, 1, "avoid · saturated")]
    df = spark.createDataFrame(asked, "s string, o string, d string, p int, want string")
    labels = df.select("want", lens_label(F.col("s"), F.col("o"), F.col("d"), F.col("p")).alias("got")).collect()
    assert all(r.got == r.want for r in labels)


def test_district_match_is_literal(spark):
    df = spark.createDataFrame([("Neukölln", ""), ("50%", "x"), ("A_B", "y"), ("AxB", "z")], "a string, l string")

    def hits(needle):
        return [r.a for r in df.where(district_matches(needle, "a", "l")).collect()]

    assert hits("NEUKÖLLN") == ["Neukölln"]
    assert hits("50%") == ["50%"]
    assert hits("a_b") == ["A_B"]


def test_half_up(spark):
    row = spark.range(1).select(half_up_1dp(F.lit(2.25)).alias("up"), F.bround(F.lit(2.25), 1).alias("even")).first()
    assert (row.up, row.even) == (2.3, 2.2)
