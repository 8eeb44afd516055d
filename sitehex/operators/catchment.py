"""Walk catchments: reach cells, drawn contours, street webs and the people they hold.

People and places are always aggregated separately and joined afterwards; joining both onto the
reach rows would count residents once per place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City, country_of, idx_of
from sitehex.functions import geometry as geo
from sitehex.functions import grid as G
from sitehex.operators.atscale import broadcast_bounded, settle
from sitehex.operators.scoring import in_cities
from sitehex.sources.layout import one_of

WEB_CORE_SECONDS = 300


def candidate_origins(population: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Distinct res-9 children of populated cells in a city's box, with their centroids."""
    from sitehex.operators.scoring import city_cells

    children = (
        city_cells(population.where(F.col("population") > 0), cities)
        .select("city", F.explode(G.cell_to_children("cell", 9)).alias("h3_9"))
        .distinct()
    )
    return G.with_center(children, "h3_9", 9, cities=cities).select("city", "h3_9", "lon", "lat")


def polygon_to_cells(
    shapes: DataFrame,
    polygon: str,
    idx: str,
    res: int = 9,
    out: str = "cell",
    cities: Sequence[City] = CITIES,
    within: Column | None = None,
) -> DataFrame:
    """The other columns of ``shapes`` x the cells whose centre lies inside the polygon, each cell once for each row.

    Cell centres lie on parallels. Every edge of the polygon is cut with the parallels that it crosses; along one parallel the
    polygon reaches from each odd cut to the next one, and the centres in between are counted off. So the work is the length
    of the outline, in cells, plus the cells found: interior cells are not tested, and no row carries the polygon further
    than these cuts. ``within`` (a box as :func:`geometry.bbox_of` makes it) leaves parallels outside it alone.
    """
    names = [c for c in shapes.columns if c != polygon]
    spans = geo.spans_on_parallels(F.col(polygon), *G.parallels(res, F.col(idx), cities), within)
    rows = shapes.select(*names, F.inline(spans).alias("_k", "_west", "_east"))
    if within is not None:
        # Ends are half open; a centre on the box's own eastern edge still counts.
        clipped = {"_west": F.greatest("_west", within["xmin"]), "_east": F.least(F.col("_east"), within["xmax"] + 1e-9)}
        rows = rows.withColumns(clipped)
    first, last = G.steps_on_parallel(res, F.col("_k"), F.col("_west"), F.col("_east"), F.col(idx), cities)
    placed = rows.withColumn("_t", F.explode(F.sequence(first, last)))
    q, r = G.cell_on_parallel(res, F.col("_k"), F.col("_t"))
    axial = placed.select(*names, "_west", "_east", q.alias("_q"), r.alias("_r"))
    # The steps are padded for rounding; the centre itself decides.
    lon = G.axial_center(F.col("_q"), F.col("_r"), res, F.col(idx), cities)["lon"]
    centred = settle(axial.withColumn("_lon", lon)).where((F.col("_lon") >= F.col("_west")) & (F.col("_lon") < F.col("_east")))
    return centred.select(*names, G.pack(F.col(idx), res, F.col("_q"), F.col("_r")).alias(out))


def derive_reach_cells(isochrones: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Every contour lobe filled with res-9 cells; lobes of one contour do not repeat a cell."""
    lobes = isochrones.select(
        "origin_h3_9", "minutes", "city", idx_of(F.col("city"), cities).alias("_idx"),
        F.array(geo.parse_polygon_coordinates("geojson")).alias("_poly"),
    )
    return (
        polygon_to_cells(lobes, "_poly", "_idx", 9, "reachable_h3_9", cities)
        .select("origin_h3_9", "minutes", "reachable_h3_9", "city")
        .distinct()
    )


def at_origins(df: DataFrame, city: str, origins: Sequence[int]) -> DataFrame:
    """Rows of a few known origins of one city, as literal predicates.

    Reach and edge tables are partitioned by city and clustered by origin, so this reads a handful
    of row groups instead of the table.
    """
    return df.where((F.col("city") == city) & F.col("origin_h3_9").isin([int(o) for o in origins]))


def catchment_polygons(
    picks: DataFrame,
    isochrones: DataFrame,
    minutes: int = 10,
    grid: str = "lattice",
    picks_bound: int | None = None,
) -> DataFrame:
    """All lobes drawn around each pick's centre child; coordinates stay exactly as stored."""
    origins = picks.select("city", "cell", G.cell_to_center_child("cell", 9, grid=grid).alias("origin_h3_9"))
    props = F.struct("minutes", G.cell_to_string("cell").alias("h3"))
    return (
        isochrones.where(F.col("minutes") == minutes)
        .join(broadcast_bounded(origins, picks_bound), ["city", "origin_h3_9"])
        .select("city", "cell", "origin_h3_9", geo.feature_json_verbatim("Polygon", "geojson", props).alias("feature"))
    )


def catchment_edges(
    picks: DataFrame,
    isochrone_edges: DataFrame,
    max_seconds: int | None = None,
    grid: str = "lattice",
    picks_bound: int | None = None,
) -> DataFrame:
    """Street edges explored from each pick; ``max_seconds`` keeps the core of the web.

    With ``picks_bound`` (a proven limit on the picks) the edge table is filtered where it lies.
    """
    origins = picks.select("city", "cell", G.cell_to_center_child("cell", 9, grid=grid).alias("origin_h3_9"))
    edges = isochrone_edges
    if max_seconds is not None:
        edges = edges.where(F.col("duration_s") <= max_seconds)
    props = F.struct(F.col("duration_s").alias("t"))
    return edges.join(broadcast_bounded(origins, picks_bound), ["city", "origin_h3_9"]).select(
        "city", "cell", "origin_h3_9", "duration_s", "dist_m",
        geo.feature_json_verbatim("LineString", "geom", props).alias("feature"),
    )


def people_within(
    origins: DataFrame,
    isochrone_cells: DataFrame,
    population: DataFrame,
    cities: Sequence[City] = CITIES,
    by_minutes: bool = False,
    minutes: int = 10,
    same_country: bool = True,
) -> DataFrame:
    """Residents reached from each ``(city, origin_h3_9)``: one seventh of each reached parent."""
    reach = isochrone_cells if by_minutes else isochrone_cells.where(F.col("minutes") == minutes)
    keys = ["city", "origin_h3_9"] + (["minutes"] if by_minutes else [])
    parents = (
        reach.join(origins.select("city", "origin_h3_9").distinct(), ["city", "origin_h3_9"], "left_semi")
        .groupBy(*keys, G.cell_to_parent("reachable_h3_9", 8).alias("h3_8"))
        .agg(F.count("*").alias("children"))
    )
    people = population.select("country", "h3_8", F.col("population").cast("double").alias("population"))
    if same_country:
        matched = parents.withColumn("country", country_of(F.col("city"), cities)).join(people, ["country", "h3_8"])
    else:
        matched = parents.join(people, "h3_8")
    return matched.groupBy(*keys).agg((F.sum(F.col("population") * F.col("children")) / 7).alias("people"))


def catchment_stats(
    picks: DataFrame,
    isochrones: DataFrame,
    isochrone_cells: DataFrame,
    population: DataFrame,
    cities: Sequence[City] = CITIES,
) -> DataFrame:
    """Lobes and reachable people per pick as independent aggregates; 0 lobes means not measured."""
    origins = picks.select("city", "cell", G.cell_to_center_child("cell", 9).alias("origin_h3_9"))
    lobes = (
        isochrones.where(F.col("minutes") == 10)
        .join(origins.select("city", "origin_h3_9").distinct(), ["city", "origin_h3_9"], "left_semi")
        .groupBy("city", "origin_h3_9")
        .agg(F.count("*").alias("lobes"))
    )
    people = people_within(origins, isochrone_cells, population, cities)
    return (
        origins.join(lobes, ["city", "origin_h3_9"], "left")
        .join(people, ["city", "origin_h3_9"], "left")
        .select(
            "city", "cell", F.coalesce("lobes", F.lit(0).cast("bigint")).alias("lobes"),
            F.bround("people").alias("reachable_people"),
        )
        .withColumn("measured", F.col("lobes") > 0)
    )


def point_catchment(
    clicks: DataFrame,
    isochrone_cells: DataFrame,
    population: DataFrame,
    places: DataFrame,
    minutes: int = 10,
    category: str = "bakery",
    cities: Sequence[City] = CITIES,
) -> DataFrame:
    """People and places of a trade within a walk of each clicked point.

    ``clicks`` has ``(click_id, city, lon, lat)``. A click on a cell that was never measured keeps
    NULL numbers.
    """
    at = G.with_cell(clicks, "lon", "lat", idx_of(F.col("city"), cities), {"origin_h3_9": 9}, cities).select(
        "click_id", "city", "origin_h3_9"
    )
    per_cell = (
        places.where(F.contains(F.lower("category"), F.lower(F.lit(category))))
        .groupBy("city", F.col("h3_9").alias("reachable_h3_9"))
        .agg(F.count("*").alias("n"))
    )
    reach = isochrone_cells.where(F.col("minutes") == minutes).join(
        at.select("city", "origin_h3_9").distinct(), ["city", "origin_h3_9"], "left_semi"
    )
    parents = _reached_parents(reach, per_cell, ["city", "origin_h3_9"]).withColumn("country", country_of(F.col("city"), cities))
    people = population.select("country", "h3_8", F.col("population").cast("double").alias("population"))
    found = (
        parents.join(people, ["country", "h3_8"], "left")
        .groupBy("city", "origin_h3_9")
        .agg(
            (F.sum(F.col("population") * F.col("children")) / 7).alias("people"),
            F.sum(F.coalesce("places", F.lit(0).cast("bigint"))).alias("places"),
        )
    )
    return at.join(found, ["city", "origin_h3_9"], "left").select("click_id", "city", "origin_h3_9", "people", "places")


def _reached_parents(reach: DataFrame, per_cell: DataFrame, keys: list[str]) -> DataFrame:
    """Reached cells and their places, added up to the parents that carry the population: one pass over reach."""
    return (
        reach.join(per_cell, ["city", "reachable_h3_9"], "left")
        .groupBy(*keys, G.cell_to_parent("reachable_h3_9", 8).alias("h3_8"))
        .agg(F.count("*").alias("children"), F.sum("n").alias("places"))
    )


def catchment_profile(
    origins: DataFrame | None,
    isochrone_cells: DataFrame,
    population: DataFrame,
    places: DataFrame,
    cities: Sequence[City] = CITIES,
) -> DataFrame:
    """Cells, places and people per origin and minutes; ``origins`` None stands for every origin."""
    keys = ["city", "origin_h3_9", "minutes"]
    reach = isochrone_cells
    if origins is not None:
        reach = reach.join(origins.select("city", "origin_h3_9").distinct(), ["city", "origin_h3_9"], "left_semi")
    per_cell = places.groupBy("city", F.col("h3_9").alias("reachable_h3_9")).agg(F.count("*").alias("n"))
    # One row per cell, whatever country it is counted in, so the join adds no rows.
    people = population.groupBy("h3_8").agg(F.sum(F.col("population").cast("double")).alias("population"))
    return (
        _reached_parents(reach, per_cell, keys)
        .join(people, "h3_8", "left")
        .groupBy(*keys)
        .agg(
            F.sum("children").alias("cells"), F.sum("places").alias("pois"),
            F.bround(F.sum(F.col("population") * F.col("children")) / 7).alias("people"),
        )
    )


def spot_check_origin(places: DataFrame, isochrone_cells: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """One stable pseudo-random named place per city that has a catchment."""
    with_reach = isochrone_cells.select("city", F.col("origin_h3_9").alias("h3_9")).distinct()
    pool = in_cities(places, cities).where(F.col("name") != "").join(with_reach, ["city", "h3_9"], "left_semi")
    first = F.min(F.struct(F.md5(F.col("id").cast("string")).alias("h"), "id", "name", "h3_9"))
    return pool.groupBy("city").agg(first.alias("_f")).select(
        "city", F.col("_f.id").alias("id"), F.col("_f.name").alias("name"), F.col("_f.h3_9").alias("origin_h3_9")
    )


def reverse_reach(targets: DataFrame, isochrone_cells: DataFrame, minutes: int = 10) -> DataFrame:
    """Origins that reach each ``(city, reachable_h3_9)``."""
    return isochrone_cells.where(F.col("minutes") == minutes).join(
        targets.select("city", "reachable_h3_9").distinct(), ["city", "reachable_h3_9"], "left_semi"
    ).select("city", "reachable_h3_9", "origin_h3_9")


def reverse_reach_of(isochrone_cells: DataFrame, city: str, cells: Sequence[int], minutes: int = 10) -> DataFrame:
    """Origins that reach any of a few known cells.

    The table is ordered by origin, so a cell may lie in any row group; its Bloom filters leave out those that lack it.
    """
    here = isochrone_cells.where((F.col("city") == city) & (F.col("minutes") == minutes))
    return here.where(one_of("reachable_h3_9", cells)).select("city", "reachable_h3_9", "origin_h3_9")


def origin_profile(
    city: str, origin: int, isochrone_cells: DataFrame, population: DataFrame, places: DataFrame, cities: Sequence[City] = CITIES
) -> DataFrame:
    """:func:`catchment_profile` of one origin, for a reader that waits: two small scans instead of joins.

    The cells of one origin's walks are few, whatever the tables hold: they are read by their key first and stand as
    literals before one scan each of people and places, which then read the row groups around the origin only.
    """
    parent = G.cell_to_parent("reachable_h3_9", 8)
    reach = at_origins(isochrone_cells, city, [origin]).select("minutes", "reachable_h3_9", parent.alias("h3_8")).collect()
    country = [c.country for c in cities if c.name == city]
    people = population.where(F.col("country").isin(country) & F.col("h3_8").isin([r.h3_8 for r in reach]))
    around = places.where((F.col("city") == city) & F.col("h3_9").isin([r.reachable_h3_9 for r in reach]))
    rows = (
        people.select(F.col("h3_8").alias("cell"), F.col("population").cast("double").alias("people"), F.lit(0).alias("pois"))
        .union(around.select("h3_9", F.lit(None).cast("double"), F.lit(1)))
        .groupBy("cell").agg(F.sum("people").alias("people"), F.sum("pois").alias("pois"))
        .collect()
    )
    found = {r.cell: r for r in rows}
    out = []
    for minutes in sorted({r.minutes for r in reach}):
        walk = [r for r in reach if r.minutes == minutes]
        homes = [found[r.h3_8].people for r in walk if r.h3_8 in found and found[r.h3_8].people is not None]
        shops = [found[r.reachable_h3_9].pois for r in walk if r.reachable_h3_9 in found]
        out.append((city, origin, minutes, len(walk), sum(shops) if shops else None, float(round(sum(homes) / 7)) if homes else None))
    schema = "city string, origin_h3_9 bigint, minutes int, cells bigint, pois bigint, people double"
    return isochrone_cells.sparkSession.createDataFrame(out, schema)
