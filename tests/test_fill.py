"""Polygon fill along parallels against the point test of every cell around."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sitehex.cities import CITIES
from sitehex.functions import geometry as geo
from sitehex.functions import grid as G
from sitehex.operators import catchment as cat
from sitehex.operators import districts
from sitehex.plans import surrogates as S
from sitehex.plans import warehouse as W


def ragged(rng, lon, lat, radius, corners):
    points = []
    for i in range(corners):
        angle, r = 2 * math.pi * i / corners, radius * rng.uniform(0.4, 1)
        points.append((lon + 1.6 * r * math.cos(angle), lat + r * math.sin(angle)))
    return points + points[:1]


@pytest.fixture(scope="module")
def shapes(spark):
    """Ragged polygons, some with holes, overlapping or degenerate parts, and one without any part."""
    rng = random.Random(1)
    data = []
    for i in range(40):
        city = CITIES[i % 3]
        lon, lat, radius = city.lon0 + rng.uniform(-0.02, 0.02), city.lat0 + rng.uniform(-0.02, 0.02), rng.uniform(0.001, 0.03)
        parts = [[ragged(rng, lon, lat, radius, rng.randint(3, 30))]]
        if i % 4 == 0:
            parts[0].append(ragged(rng, lon, lat, radius * 0.3, 6))
        if i % 5 == 0:
            parts += [[ragged(rng, lon + radius / 2, lat, radius, 8)], [ragged(rng, lon, lat, radius, 5)]]
        if i % 7 == 0:
            parts.append([[(lon, lat), (lon + 0.001, lat)]])
        data.append((i, city.idx, parts))
    return spark.createDataFrame([*data, (99, 0, []), (98, 0, None)], f"id int, idx bigint, poly {geo.MULTIPOLYGON}").cache()


def one_by_one(shapes, res):
    corners = shapes.where(F.size("poly") > 0).withColumn("b", geo.bbox_of("poly"))
    for j, (x, y) in enumerate((("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymin"), ("xmax", "ymax"))):
        corners = G.with_cell(corners, F.col(f"b.{x}"), F.col(f"b.{y}"), F.col("idx"), {f"k{j}": res})
    q, r = ([f(f"k{j}") for j in range(4)] for f in (G.cell_q, G.cell_r))
    around = corners.select("*", F.explode(F.sequence(F.least(*q) - 1, F.greatest(*q) + 1)).alias("q")).select(
        "*", F.explode(F.sequence(F.least(*r) - 1, F.greatest(*r) + 1)).alias("r")
    )
    cells = G.with_center(around.select("id", "poly", G.pack(F.col("idx"), res, F.col("q"), F.col("r")).alias("cell")), "cell", res)
    return cells.where(geo.point_in_polygon("lon", "lat", "poly")).select("id", "cell")


@pytest.mark.parametrize("res", [7, 8, 9])
def test_fill_equals_point_tests(shapes, res):
    got = sorted(map(tuple, cat.polygon_to_cells(shapes, "poly", "idx", res).select("id", "cell").collect()))
    assert got == sorted(map(tuple, one_by_one(shapes, res).collect())) and got


def test_fill_inside_a_box(shapes):
    city = CITIES[0]
    box = F.struct(
        F.lit(city.lon0 - 0.02).alias("xmin"), F.lit(city.lon0 + 0.01).alias("xmax"),
        F.lit(city.lat0 - 0.01).alias("ymin"), F.lit(city.lat0 + 0.02).alias("ymax"),
    )
    some = shapes.where("idx = 0")
    inside = G.with_center(cat.polygon_to_cells(some, "poly", "idx", 9), "cell", 9).where(
        F.col("lon").between(city.lon0 - 0.02, city.lon0 + 0.01) & F.col("lat").between(city.lat0 - 0.01, city.lat0 + 0.02)
    )
    clipped = cat.polygon_to_cells(some, "poly", "idx", 9, within=box).select("id", "cell").collect()
    assert {tuple(r) for r in inside.select("id", "cell").collect()} <= {tuple(r) for r in clipped}
    assert len(clipped) < cat.polygon_to_cells(some, "poly", "idx", 9).count()


def generates(df):
    """Output columns of every row generator that the plan runs, from the first to the last."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "Generate " in line][::-1]


def test_no_outline_is_copied_to_cells(spark, sf):
    lobes = cat.derive_reach_cells(W.stored(spark, sf, "isochrones"))
    cuts, *cells = generates(lobes)  # cuts of an outline, then cells of a cut
    assert "_poly" in cuts and cells and not any("_poly" in c or "geojson" in c for c in cells)
    named = districts.division_cells(S.divisions(spark, sf))
    assert "geometry" not in generates(named)[-1] and "_west" in generates(named)[-1]


def test_named_cells_equal_point_tests(spark, sf):
    cells = G.with_center(districts.city_cells(W.stored(spark, sf, "population")).select("city", "cell"), "cell", G.BASE_RES)
    divisions = S.divisions(spark, sf)
    near = cells.join(divisions, geo.bbox_contains("lon", "lat", "bxmin", "bxmax", "bymin", "bymax"))
    hits = near.where(geo.point_in_polygon("lon", "lat", "geometry"))
    want = {(r.city, r.cell, r.nm) for r in hits.select("city", "cell", "nm").collect()}
    filled = districts.division_cells(divisions).join(cells.select("city", "cell").distinct(), ["city", "cell"])
    assert {(r.city, r.cell, r.nm) for r in filled.select("city", "cell", "nm").collect()} == want and want
