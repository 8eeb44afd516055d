import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitehex.cities import CITIES
from sitehex.functions import grid as G


@pytest.fixture(scope="module")
def cells(spark):
    """A patch of res-8 cells around every anchor."""
    q = spark.range(-9, 10).select(F.col("id").alias("q"))
    r = spark.range(-9, 10).select(F.col("id").alias("r"))
    idx = spark.range(3).select(F.col("id").alias("idx"))
    # Fixture only: a small dense patch is the product of three short ranges.
    return q.join(r, F.lit(True)).join(idx, F.lit(True)).withColumn("cell", G.pack("idx", 8, "q", "r")).cache()


def test_known_h3_text_and_number(spark):
    row = spark.range(1).select(
        G.cell_from_string(F.lit("881ef5db6dfffff")).alias("n"),
        G.cell_to_string(F.lit(613034210078228479)).alias("s"),
    ).first()
    assert (row.n, row.s) == (613034210078228479, "881ef5db6dfffff")


def test_h3_parent_and_centre_child(spark):
    df = spark.createDataFrame([("881f18b021fffff",)], "s string").withColumn("c", G.cell_from_string("s"))
    df = df.withColumn("k", G.cell_to_center_child("c", 9, grid="h3"))
    row = df.select(
        G.cell_to_string("k").alias("child"),
        (G.cell_to_parent("k", 8, grid="h3") == F.col("c")).alias("back"),
        F.size(F.array_distinct(G.cell_to_children("c", 9, grid="h3"))).alias("kids"),
        G.is_center_child("k", 9, grid="h3").alias("centre"),
    ).first()
    assert (row.child, row.back, row.kids, row.centre) == ("891f18b0203ffff", True, 7, True)


def test_pack_round_trip(cells):
    bad = cells.where(
        (G.cell_q("cell") != F.col("q")) | (G.cell_r("cell") != F.col("r"))
        | (G.cell_city_idx("cell") != F.col("idx")) | (G.cell_res("cell") != 8)
    )
    assert bad.count() == 0


def test_seven_children_and_they_return(cells):
    kids = cells.select("cell", F.explode(G.cell_to_children("cell", 9)).alias("kid"))
    assert kids.where(G.cell_to_parent("kid", 8) != F.col("cell")).count() == 0
    assert kids.select("kid").distinct().count() == cells.count() * 7
    centre = kids.where(G.is_center_child("kid", 9))
    assert centre.count() == cells.count()
    assert centre.where(G.cell_to_center_child("cell", 9) != F.col("kid")).count() == 0


def test_every_fine_cell_has_one_parent_two_levels_up(cells):
    twice = cells.withColumn("fine", G.cell_to_center_child("cell", 10, from_res=8))
    assert twice.where(G.cell_to_parent("fine", 8, from_res=10) != F.col("cell")).count() == 0


def test_ring_is_symmetric_and_sized(cells):
    assert cells.where(F.size(F.array_distinct(G.cell_ring("cell"))) != 7).count() == 0
    assert cells.where(F.size(F.array_distinct(G.cell_ring("cell", 3))) != 37).count() == 0
    pairs = cells.select("cell", F.explode(G.cell_ring("cell")).alias("n"))
    back = pairs.where(~F.array_contains(G.cell_ring("n"), F.col("cell")))
    assert back.count() == 0


@pytest.mark.parametrize("res", [8, 9])
def test_centre_lies_in_its_own_cell(cells, res):
    at = cells.withColumn("c", G.cell_to_center_child("cell", 9) if res == 9 else F.col("cell"))
    placed = G.with_center(at, "c", res)
    again = G.with_cell(placed, "lon", "lat", "idx", {"again": res})
    assert again.where(F.col("again") != F.col("c")).count() == 0


def test_boundary_is_closed_and_six_sided(cells):
    ring = cells.withColumn("ring", G.cell_boundary("cell", 8))
    first, last = F.get("ring", F.lit(0)), F.get("ring", F.lit(6))
    assert ring.where((F.size("ring") != 7) | (first != last)).count() == 0


def test_mercator_and_morton(spark):
    row = spark.createDataFrame([(0.0, 0.0, 5, 3)], "lon double, lat double, x bigint, y bigint").select(
        G.mercator_x("lon").alias("mx"), G.mercator_y("lat").alias("my"), G.morton("x", "y").alias("z")
    ).first()
    assert (row.mx, row.my) == (2147483647, 2147483647)
    assert row.z == 0b011011


def _reference_cell(lon, lat, city):
    x = (lon - city.lon0) * city.metres_per_deg_lon
    y = (lat - city.lat0) * G.M_PER_DEG_LAT
    q = (x * 0.5773502691896258 - y * 0.3333333333333333) / G.EDGE_M
    r = y * 0.6666666666666666 / G.EDGE_M
    a, b, c = (math.floor(v + 0.5) for v in (q, r, -q - r))
    da, db, dc = abs(a - q), abs(b - r), abs(c + q + r)
    if da > db and da > dc:
        a = -b - c
    elif db > dc:
        b = -a - c
    return a, b


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(0, 1), st.floats(0, 1)), min_size=1, max_size=40))
def test_points_agree_with_plain_arithmetic(spark, pts):
    rows = []
    for i, u, v in pts:
        c = CITIES[i]
        lon, lat = c.lon_min + u * (c.lon_max - c.lon_min), c.lat_min + v * (c.lat_max - c.lat_min)
        rows.append((i, lon, lat, *_reference_cell(lon, lat, c)))
    df = spark.createDataFrame(rows, "idx int, lon double, lat double, q int, r int")
    got = G.with_cell(df, "lon", "lat", "idx", {"cell": 8})
    assert got.where((G.cell_q("cell") != F.col("q")) | (G.cell_r("cell") != F.col("r"))).count() == 0


def test_cell_families_do_not_mix(spark):
    from dataclasses import replace

    import pytest

    from sitehex.cities import CITIES
    from sitehex.operators.scoring import city_cells
    from sitehex.sources.population import ingest_population, rekey_population

    for idx in (-1, 8, 127, 200):
        with pytest.raises(ValueError, match="does not fit"):
            replace(CITIES[0], idx=idx)
    schema = "h3 string, population float, country string, lon double, lat double"
    real = spark.createDataFrame(
        [("881f1d4887fffff", 12.0, "DE", 13.40, 52.52), ("881f1d4c4dfffff", 5.0, "DE", 13.38, 52.51), ("881f1d4889fffff", 0.0, "DE", 13.4, 52.5),
         ("881fa10001fffff", 9.0, "DE", 11.57, 48.13)], schema)
    with pytest.raises(Exception, match="re-key"):
        city_cells(ingest_population(real)).collect()
    cells = city_cells(rekey_population(real)).collect()
    assert sorted(r["pop"] for r in cells) == [5.0, 12.0] and {r.city for r in cells} == {"berlin"}
