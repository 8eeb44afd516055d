"""Geometry as Column expressions over the multi-polygon normal form.

A multi-polygon is ``array<array<array<struct<lon:double,lat:double>>>>`` (parts, rings, points);
a polygon is a multi-polygon with one part. The first ring of a part is its outline, the rest are
holes. Rings are closed. Longitude always comes first and every argument is named.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Authalic radius used for areas and great circles, in metres.
EARTH_RADIUS_M = 6371007.18

MULTIPOLYGON = "array<array<array<struct<lon:double,lat:double>>>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _segments(ring: Column) -> Column:
    return F.sequence(F.lit(1), F.size(ring) - 1)


def _ring_parity(lon: Column, lat: Column, ring: Column) -> Column:
    """Odd number of edge crossings of the eastward ray from the point."""

    def crosses(i):
        a, b = F.get(ring, i - 1), F.get(ring, i)
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + F.try_divide((b["lon"] - a["lon"]) * (lat - a["lat"]), b["lat"] - a["lat"])
        return straddles & F.coalesce(lon < at, F.lit(False))

    return F.when(F.size(ring) < 3, F.lit(False)).otherwise(
        F.aggregate(_segments(ring), F.lit(False), lambda acc, i: acc != crosses(i))
    )


def point_in_polygon(lon, lat, multipolygon) -> Column:
    """Inside any part; a point inside a hole is outside that part."""
    lon, lat, mp = _c(lon), _c(lat), _c(multipolygon)
    return F.exists(
        mp,
        lambda part: F.aggregate(
            part, F.lit(False), lambda acc, ring: acc != _ring_parity(lon, lat, ring)
        ),
    )


def spans_on_parallels(multipolygon, latitude, number, within: Column | None = None) -> Column:
    """``array<struct<k, west, east>>``: where the polygon covers numbered parallels, by number and from west to east.

    ``latitude`` gives the latitude of a whole number and rises with it, ``number`` the fractional number of a latitude. A
    point of parallel ``k`` is inside, as :func:`point_in_polygon` has it, where ``west <= lon < east`` of one span.
    ``within`` leaves out parallels and spans that lie wholly outside a box.
    """

    def edge_cuts(ring, i, part):
        a, b = F.get(ring, i - 1), F.get(ring, i)
        low, high = F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"])
        if within is not None:
            low, high = F.greatest(low, within["ymin"]), F.least(high, within["ymax"])
        first, last = F.floor(number(low)), F.ceil(number(high))

        def cut(k):
            lat = latitude(k)
            at = a["lon"] + F.try_divide((b["lon"] - a["lon"]) * (lat - a["lat"]), b["lat"] - a["lat"])
            return F.struct(part.alias("part"), k.alias("k"), F.when((a["lat"] > lat) != (b["lat"] > lat), at).alias("at"))

        numbers = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.filter(F.transform(numbers, cut), lambda c: c["at"].isNotNull())

    def part_cuts(part, p):
        rings = F.filter(part, lambda ring: F.size(ring) >= 3)
        return F.flatten(F.transform(rings, lambda ring: F.flatten(F.transform(_segments(ring), lambda i: edge_cuts(ring, i, p)))))

    # Each part cuts a parallel an even number of times, so sorted cuts are ends of spans by turns.
    cuts = F.sort_array(F.flatten(F.transform(_c(multipolygon), part_cuts)))

    def spans(found):
        firsts = F.filter(found, lambda c, i: i % 2 == 0)
        seconds = F.filter(found, lambda c, i: i % 2 == 1)
        return F.zip_with(firsts, seconds, lambda a, b: F.struct(a["k"].alias("k"), a["at"].alias("west"), b["at"].alias("east")))

    def merged(of_parts):
        """Spans of different parts may overlap."""

        def add(done, s):
            last = F.get(done, F.size(done) - 1)
            meets = F.coalesce((last["k"] == s["k"]) & (s["west"] <= last["east"]), F.lit(False))
            wider = F.struct(last["k"].alias("k"), last["west"].alias("west"), F.greatest(last["east"], s["east"]).alias("east"))
            return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

        none = F.array().cast("array<struct<k:bigint,west:double,east:double>>")
        return F.aggregate(F.sort_array(of_parts), none, add)

    # Bound to a lambda variable, the spans are computed once.
    def finish(found):
        return F.when(F.size(_c(multipolygon)) > 1, merged(found)).otherwise(found)

    cut_spans = F.transform(F.array(cuts), spans)
    whole = F.get(F.transform(cut_spans, finish), F.lit(0))
    if within is None:
        return whole
    return F.filter(whole, lambda s: (s["east"] >= within["xmin"]) & (s["west"] <= within["xmax"]))


def _ring_excess(ring: Column) -> Column:
    def edge(i):
        a, b = F.get(ring, i - 1), F.get(ring, i)
        t1, t2 = F.tan(F.radians(a["lat"]) / 2), F.tan(F.radians(b["lat"]) / 2)
        half = F.tan(F.radians(b["lon"] - a["lon"]) / 2)
        return F.atan2(half * (t1 + t2), t1 * t2 + 1) * 2

    return F.abs(F.aggregate(_segments(ring), F.lit(0.0), lambda acc, i: acc + edge(i)))


def spherical_area_m2(multipolygon) -> Column:
    """Area on the sphere; holes are subtracted, the absolute value is taken over the whole sum."""

    def part_area(part):
        outline = _ring_excess(F.get(part, F.lit(0)))
        holes = F.aggregate(
            F.slice(part, 2, 1 << 30), F.lit(0.0), lambda acc, ring: acc + _ring_excess(ring)
        )
        return outline - holes

    total = F.aggregate(_c(multipolygon), F.lit(0.0), lambda acc, part: acc + part_area(part))
    return F.abs(total) * EARTH_RADIUS_M * EARTH_RADIUS_M


def great_circle_m(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = _c(lon1), _c(lat1), _c(lon2), _c(lat2)
    s1 = F.sin(F.radians(lat2 - lat1) / 2)
    s2 = F.sin(F.radians(lon2 - lon1) / 2)
    h = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def geo_distance_m(lon1, lat1, lon2, lat2) -> Column:
    """Ellipsoidal (WGS-84) local distance from the published degree-length series.

    Meant for the walking distances it is used on; within 0.6 % of the great circle there.
    """
    lon1, lat1, lon2, lat2 = _c(lon1), _c(lat1), _c(lon2), _c(lat2)
    mid = F.radians((lat1 + lat2) / 2)
    per_lat = F.lit(111132.09) - F.cos(mid * 2) * 566.05 + F.cos(mid * 4) * 1.20
    per_lon = F.cos(mid) * 111415.13 - F.cos(mid * 3) * 94.55 + F.cos(mid * 5) * 0.12
    dy, dx = (lat2 - lat1) * per_lat, (lon2 - lon1) * per_lon
    return F.sqrt(dx * dx + dy * dy)


def bbox_contains(lon, lat, xmin, xmax, ymin, ymax) -> Column:
    return _c(lon).between(_c(xmin), _c(xmax)) & _c(lat).between(_c(ymin), _c(ymax))


def bbox_overlap(axmin, axmax, aymin, aymax, bxmin, bxmax, bymin, bymax) -> Column:
    return (
        (_c(axmin) <= _c(bxmax))
        & (_c(axmax) >= _c(bxmin))
        & (_c(aymin) <= _c(bymax))
        & (_c(aymax) >= _c(bymin))
    )


def bbox_of(multipolygon) -> Column:
    """``struct(xmin, xmax, ymin, ymax)`` of the outlines."""
    points = F.flatten(F.transform(_c(multipolygon), lambda part: F.get(part, F.lit(0))))
    lons = F.transform(points, lambda p: p["lon"])
    lats = F.transform(points, lambda p: p["lat"])
    return F.struct(
        F.array_min(lons).alias("xmin"),
        F.array_max(lons).alias("xmax"),
        F.array_min(lats).alias("ymin"),
        F.array_max(lats).alias("ymax"),
    )


def centroid_of(ring) -> Column:
    """Point mean of a closed ring, the repeated vertex included."""
    ring = _c(ring)
    n = F.size(ring).cast("double")

    def mean(field):
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[field]) / n

    return F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))


# ---- GeoJSON --------------------------------------------------------------------------------


def round5(x) -> Column:
    return F.bround(_c(x), 5)


def point_geometry(lon, lat) -> Column:
    return F.struct(
        F.lit("Point").alias("type"), F.array(round5(lon), round5(lat)).alias("coordinates")
    )


def polygon_geometry(ring) -> Column:
    """Single-outline polygon from an array of ``struct(lon, lat)``."""
    coords = F.transform(_c(ring), lambda p: F.array(round5(p["lon"]), round5(p["lat"])))
    return F.struct(F.lit("Polygon").alias("type"), F.array(coords).alias("coordinates"))


def feature_json(geometry: Column, properties: Column) -> Column:
    """One feature; properties that are NULL leave no key behind (absent is not zero)."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            geometry.alias("geometry"),
            properties.alias("properties"),
        )
    )


def feature_json_verbatim(geometry_type: str, coordinates_json, properties: Column) -> Column:
    """Feature around coordinates that are already GeoJSON text and must not be touched."""
    return F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"' + geometry_type + '","coordinates":'),
        _c(coordinates_json),
        F.lit('},"properties":'),
        F.to_json(properties),
        F.lit("}"),
    )


def parse_polygon_coordinates(text) -> Column:
    """``[[[lon,lat],...],...]`` text to the rings of one part."""
    rings = F.from_json(_c(text), "array<array<array<double>>>")
    return F.transform(
        rings,
        lambda ring: F.transform(
            ring,
            lambda p: F.struct(
                F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")
            ),
        ),
    )
