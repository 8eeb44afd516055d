"""Data-quality checks. Every check returns rows ``(check, scope, value, passed)``.

They are written so that the failure they hunt would fail them: swapped coordinates, mislabelled
minutes, shifted origins, doubled rollups, dropped rows. All of them aggregate; none collects a
group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City
from sitehex.functions import geometry as geo
from sitehex.functions import grid as G
from sitehex.operators.atscale import broadcast_bounded, exact_quantiles
from sitehex.operators.scoring import NEUTRAL, city_cells, reweight
from sitehex.functions.text import half_up_1dp

# Box padding in degrees, reach ceilings and their percentile bounds in metres.
PAD_DEG = 0.05
HARD_CEILING_M = {5: 800.0, 10: 1600.0, 15: 2400.0}
P999_LIMIT_M = {5: 625.0, 10: 1250.0, 15: 1875.0}
NEAREST_VERTEX_LIMIT_M = 1000.0
ACCUMULATED_LIMIT_M = 3000.0
ORIGIN_OVERLAP = 0.90
DURATION_SPAN_S = 300.0
MAX_SKIPPED = 0.60
CELL9_KM2 = 0.105

# Smallest believable loads.
FLOORS = {"places": 5000, "population": 10000, "districts": 100}
BUILDING_FLOORS = {"berlin": 800000, "amsterdam": 300000, "belgrade": 250000}
ADDRESS_CELL_FLOORS = {"berlin": 1500, "amsterdam": 1, "belgrade": 1}
ROAD_CELL_FLOORS = {"berlin": 2000, "amsterdam": 1, "belgrade": 1}

# Three cells whose names are known from the map.
DISTRICT_GROUND_TRUTH = (
    ("881f18b021fffff", "Lichtenrade", "Tempelhof-Schöneberg"),
    ("881f1d4d81fffff", "Biesdorf", "Marzahn-Hellersdorf"),
    ("881f18b645fffff", "Mahlsdorf", "Marzahn-Hellersdorf"),
)
# Momentum ranges of three named trades (low, high; open ends are None).
MOMENTUM_RANGES = (
    ("berlin", "cafe", 0.0, None),
    ("berlin", "bakery", -10.0, 10.0),
    ("berlin", "ev_charging_station", 100.0, None),
)


def _result(df: DataFrame, name: str, value: Column, passed: Column, scope: str = "city") -> DataFrame:
    return df.select(
        F.lit(name).alias("check"),
        F.col(scope).cast("string").alias("scope"),
        value.cast("double").alias("value"),
        passed.alias("passed"),
    )


def as_result(df: DataFrame, name: str, value: str) -> DataFrame:
    """A measurement per city with its ``passed``, in the form of the other checks."""
    return _result(df, name, F.col(value), F.col("passed"))


def _none(df: DataFrame, name: str, bad: str = "bad", scope: str = "city") -> DataFrame:
    return _result(df, name, F.col(bad), F.col(bad) == 0, scope)


def _outside(lon: Column, lat: Column, cities: Sequence[City]) -> Column:
    out = F.lit(True)
    for c in cities:
        out = F.when(F.col("city") == c.name, ~F.coalesce(c.contains(lon, lat, PAD_DEG), F.lit(False))).otherwise(out)
    return out


# ---- reach cells ----------------------------------------------------------------------------


def reach_inside_box(reach: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    df = G.with_center(reach, "reachable_h3_9", 9, cities=cities)
    bad = F.count_if(_outside(F.col("lon"), F.col("lat"), cities))
    return _none(df.groupBy("city").agg(bad.alias("bad")), "reach cells inside the padded box")


def centroid_probe(reach: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Average coordinates per city at four decimals; a swap is visible at a glance."""
    return (
        G.with_center(reach, "reachable_h3_9", 9, cities=cities)
        .groupBy("city")
        .agg(
            F.bround(F.avg("lat"), 4).alias("avg_lat"),
            F.bround(F.avg("lon"), 4).alias("avg_lon"),
            F.count("*").alias("n"),
        )
    )


def reach_grows(reach: DataFrame) -> DataFrame:
    per = reach.groupBy("city", "origin_h3_9").agg(
        *[F.count_if(F.col("minutes") == m).alias(f"c{m}") for m in (5, 10, 15)]
    )
    bad = F.count_if(~((F.col("c5") <= F.col("c10")) & (F.col("c10") <= F.col("c15"))))
    full = per.where((F.col("c5") > 0) & (F.col("c10") > 0) & (F.col("c15") > 0))
    return _none(full.groupBy("city").agg(bad.alias("bad")), "reach grows with the minutes")


def reach_nested(reach: DataFrame) -> DataFrame:
    """The 5-minute cells are a subset of the 15-minute cells of the same origin."""
    per_cell = reach.groupBy("city", "origin_h3_9", "reachable_h3_9").agg(
        F.max((F.col("minutes") == 5).cast("int")).alias("in5"),
        F.max((F.col("minutes") == 15).cast("int")).alias("in15"),
    )
    per = per_cell.groupBy("city", "origin_h3_9").agg(
        F.sum("in5").alias("n5"),
        F.sum("in15").alias("n15"),
        F.sum(F.col("in5") * (F.lit(1) - F.col("in15"))).alias("missing"),
    )
    both = per.where((F.col("n5") > 0) & (F.col("n15") > 0))
    return _none(
        both.groupBy("city").agg(F.count_if(F.col("missing") > 0).alias("bad")),
        "5-minute reach lies within the 15-minute reach",
    )


def origin_in_own_reach(reach: DataFrame) -> DataFrame:
    per = (
        reach.where(F.col("minutes") == 15)
        .groupBy("city", "origin_h3_9")
        .agg(F.max((F.col("reachable_h3_9") == F.col("origin_h3_9")).cast("int")).alias("own"))
    )
    return _none(per.groupBy("city").agg(F.count_if(F.col("own") == 0).alias("bad")), "origin lies in its own 15-minute reach")


def with_reach_distance(reach: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    both = G.with_center(reach, "origin_h3_9", 9, "_alon", "_alat", cities)
    both = G.with_center(both, "reachable_h3_9", 9, "_blon", "_blat", cities)
    return both.withColumn("dist_m", geo.geo_distance_m("_alon", "_alat", "_blon", "_blat")).drop(
        "_alon", "_alat", "_blon", "_blat"
    )


def _limit(limits: Mapping[int, float]) -> Column:
    return F.when(F.col("minutes") == 5, limits[5]).when(F.col("minutes") == 10, limits[10]).otherwise(limits[15])


def reach_ceiling(reach: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    df = with_reach_distance(reach, cities)
    bad = F.count_if(F.col("dist_m") > _limit(HARD_CEILING_M))
    return _none(df.groupBy("city").agg(bad.alias("bad")), "no reach beyond the hard ceiling")


def reach_p999(reach: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    df = with_reach_distance(reach, cities).select("city", "minutes", "dist_m")
    q = exact_quantiles(df, ["city", "minutes"], "dist_m", {"p999": 0.999}, 3 * len(cities))
    q = q.withColumn("scope", F.concat_ws("/", "city", F.col("minutes").cast("string")))
    return _result(q, "p99.9 reach within walking physics", F.col("p999"), F.col("p999") <= _limit(P999_LIMIT_M), "scope")


def reach_shape(reach: DataFrame) -> DataFrame:
    per = reach.groupBy("city", "minutes", "origin_h3_9").agg(F.count("*").alias("cells"))
    return per.groupBy("city", "minutes").agg(
        F.bround(F.avg("cells"), 1).alias("avg_cells"),
        F.bround(F.avg("cells") * CELL9_KM2, 2).alias("avg_km2"),
    )


def far_origins_disjoint(reach: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """The southernmost and northernmost origins of a city share no 15-minute cell."""
    reach15 = reach.where(F.col("minutes") == 15)
    placed = G.with_center(reach15.select("city", "origin_h3_9").distinct(), "origin_h3_9", 9, cities=cities)
    at = F.struct("lat", "origin_h3_9", "lon")
    ends = placed.groupBy("city").agg(F.min(at).alias("s"), F.max(at).alias("n"))
    n = len(cities)
    shared = (
        reach15.join(broadcast_bounded(ends, n), "city")
        .where(F.col("origin_h3_9").isin(F.col("s.origin_h3_9"), F.col("n.origin_h3_9")))
        .groupBy("city", "reachable_h3_9")
        .agg(F.count_distinct("origin_h3_9").alias("k"))
        .groupBy("city")
        .agg(F.count_if(F.col("k") > 1).alias("shared_cells"))
    )
    apart = geo.geo_distance_m(F.col("s.lon"), F.col("s.lat"), F.col("n.lon"), F.col("n.lat")) / 1000.0
    return ends.join(shared, "city").select(
        "city", F.bround(apart, 1).alias("apart_km"), "shared_cells", (F.col("shared_cells") == 0).alias("passed")
    )


def cells_reach_themselves(
    reach: DataFrame, population: DataFrame, cities: Sequence[City] = CITIES, grid: str = "lattice"
) -> DataFrame:
    """Every measured cell's 10-minute reach contains the cell itself."""
    origins = city_cells(population, cities).select(
        "city", "cell", G.cell_to_center_child("cell", 9, grid=grid).alias("origin_h3_9")
    )
    per = (
        reach.where(F.col("minutes") == 10)
        .join(origins, ["city", "origin_h3_9"])
        .groupBy("city", "cell")
        .agg(F.max((G.cell_to_parent("reachable_h3_9", 8, grid=grid) == F.col("cell")).cast("int")).alias("own"))
    )
    return _none(per.groupBy("city").agg(F.count_if(F.col("own") == 0).alias("bad")), "measured cells reach themselves")


def skip_rate(measured: DataFrame, candidates: DataFrame, limit: float = MAX_SKIPPED) -> DataFrame:
    """Refuse a routing run that left more than 60 % of the candidate origins unmeasured."""
    got = measured.select("city", F.col("origin_h3_9").alias("h3_9")).distinct().withColumn("_m", F.lit(1))
    rate = (
        candidates.select("city", "h3_9").distinct()
        .join(got, ["city", "h3_9"], "left")
        .groupBy("city")
        .agg((F.count_if(F.col("_m").isNull()) / F.count("*")).alias("skipped"))
    )
    return _result(rate, "share of unmeasured origins", F.col("skipped"), F.col("skipped") <= limit)


# ---- street edges ---------------------------------------------------------------------------

_VERTICES = "array<array<double>>"


def edges_inside_box(edges: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    first = F.get(F.from_json("geom", _VERTICES), F.lit(0))
    df = edges.withColumn("_p", first)
    bad = F.count_if(_outside(F.get("_p", F.lit(0)), F.get("_p", F.lit(1)), cities))
    return _none(df.groupBy("city").agg(bad.alias("bad")), "edges start inside the padded box")


def edge_centroid_probe(edges: DataFrame) -> DataFrame:
    first = F.get(F.from_json("geom", _VERTICES), F.lit(0))
    return (
        edges.withColumn("_p", first)
        .groupBy("city")
        .agg(
            F.bround(F.avg(F.get("_p", F.lit(1))), 4).alias("avg_lat"),
            F.bround(F.avg(F.get("_p", F.lit(0))), 4).alias("avg_lon"),
            F.count("*").alias("n"),
        )
    )


def web_touches_origin(edges: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    nearest = F.array_min(
        F.transform(
            F.from_json("geom", _VERTICES),
            lambda v: geo.geo_distance_m("lon", "lat", F.get(v, F.lit(0)), F.get(v, F.lit(1))),
        )
    )
    per = (
        G.with_center(edges, "origin_h3_9", 9, cities=cities)
        .select("city", "origin_h3_9", nearest.alias("_d"))
        .groupBy("city", "origin_h3_9")
        .agg(F.min("_d").alias("min_d"))
    )
    q = exact_quantiles(per, ["city"], "min_d", {"p999": 0.999}, len(cities))
    return _result(q, "p99.9 distance from origin to its web", F.col("p999"), F.col("p999") <= NEAREST_VERTEX_LIMIT_M)


def edge_distance_p999(edges: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    q = exact_quantiles(edges, ["city"], "dist_m", {"p999": 0.999}, len(cities))
    return _result(q, "p99.9 accumulated distance", F.col("p999"), F.col("p999") <= ACCUMULATED_LIMIT_M)


def edge_origins_have_contours(edges: DataFrame, isochrones: DataFrame) -> DataFrame:
    contour = (
        isochrones.where(F.col("minutes") == 10).select("city", "origin_h3_9").distinct().withColumn("_m", F.lit(1))
    )
    share = (
        edges.select("city", "origin_h3_9").distinct()
        .join(contour, ["city", "origin_h3_9"], "left")
        .groupBy("city")
        .agg((F.count_if(F.col("_m") == 1) / F.count("*")).alias("share"))
    )
    return _result(share, "edge origins with a 10-minute contour", F.col("share"), F.col("share") >= ORIGIN_OVERLAP)


def duration_gradient(edges: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    span = edges.groupBy("city", "origin_h3_9").agg((F.max("duration_s") - F.min("duration_s")).alias("span"))
    q = exact_quantiles(span, ["city"], "span", {"med": 0.5}, len(cities))
    return _result(q, "median duration span", F.col("med"), F.col("med") >= DURATION_SPAN_S)


def web_shape(edges: DataFrame) -> DataFrame:
    per = edges.groupBy("city", "origin_h3_9").agg(
        F.count("*").alias("edges"), (F.max("duration_s") - F.min("duration_s")).alias("span")
    )
    return per.groupBy("city").agg(
        F.bround(F.avg("edges"), 1).alias("avg_edges_per_web"),
        F.max("edges").alias("max_edges_per_web"),
        F.bround(F.avg("span")).alias("avg_span_seconds"),
    )


# ---- scores ---------------------------------------------------------------------------------


def access_includes_home(surface: DataFrame) -> DataFrame:
    """A measured cell reaches at least its own seventh, so its access is never zero."""
    m = surface.where(F.col("acc_pop").isNotNull())
    bad = F.count_if((F.col("acc_pop") < F.col("pop") / 7 - 1e-6) | (F.col("acc_pop") <= 0))
    return _none(m.groupBy("city").agg(bad.alias("bad")), "access holds at least the home share")


# Weightings probed besides the neutral one; the last must fall back to neutral.
PROBES = (
    {"demand": 100, "low_competition": 0, "accessibility": 0},
    {"demand": 0, "low_competition": 100, "accessibility": 0},
    {"demand": 0, "low_competition": 0, "accessibility": 100},
    {"demand": 80, "low_competition": 20, "accessibility": 50},
    {"demand": 5, "low_competition": 95, "accessibility": 30},
    {"demand": 0, "low_competition": 0, "accessibility": 0},
)


def score_identity(surface: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Neutral re-weighting reproduces the gap, and the log form of every weighting agrees.

    ``shown`` may be another producer's ``(city, cell, gap)``; by default the surface checks itself.
    """
    other = surface if shown is None else shown
    left = reweight(surface, NEUTRAL, "w0")
    diffs = []
    for i, probe in enumerate(PROBES):
        left = reweight(left, probe, f"w{i + 1}")
        diffs.append(F.abs(F.col(f"w{i + 1}") - _geometric(probe)))
    both = left.join(other.select("city", "cell", F.col("gap").alias("_gap")), ["city", "cell"])
    worst = F.greatest(F.abs(F.col("w0") - F.col("_gap")), *diffs)
    return _result(
        both.groupBy("city").agg(F.max(worst).alias("d")), "score identity", F.bround("d", 6), F.col("d") <= 1e-6
    )


def _geometric(weights: Mapping[str, float]) -> Column:
    """The same weighted product through logarithms, used only to cross-check ``reweight``."""
    from sitehex.operators.scoring import exponents

    e = exponents(weights)
    terms = [
        (F.col("dem") / 100.0, e["demand"], F.lit(True)),
        ((F.lit(100.0) - F.col("supply_n")) / 100.0, e["low_competition"], F.lit(True)),
        (F.col("acc_n") / 100.0, e["accessibility"], F.col("acc_n").isNotNull()),
    ]
    log_sum, zero = F.lit(0.0), F.lit(False)
    for t, w, present in terms:
        if w == 0:
            continue
        zero = zero | (present & (t <= 0))
        log_sum = log_sum + F.when(present & (t > 0), F.ln(t) * w).otherwise(0.0)
    return F.when(zero, F.lit(0.0)).otherwise(F.exp(log_sum) * 100.0)


def display_identity(surface: DataFrame) -> DataFrame:
    """The displayed number (half up) and the stored one (half even) differ on ties at most."""
    d = F.abs(half_up_1dp("gap") - F.bround("gap", 1))
    return _result(
        surface.groupBy("city").agg(F.max(d).alias("d")), "display rounding", F.bround("d", 6), F.col("d") <= 0.1 + 1e-9
    )


# ---- loads ----------------------------------------------------------------------------------


def _counted(df: DataFrame, by: str, name: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias(name))


def rollup_matches_raw(buildings: DataFrame, rollup: DataFrame) -> DataFrame:
    """The rollup counted every footprint exactly once."""
    raw = _counted(buildings, "city", "raw")
    rolled = rollup.groupBy("city").agg(F.sum("buildings").alias("rolled"))
    both = raw.join(rolled, "city", "full").na.fill(0)
    return _result(both, "rollup count equals raw count", F.col("rolled") - F.col("raw"), F.col("rolled") == F.col("raw"))


def row_floor(df: DataFrame, by: str, floors: Mapping[str, int] | int, keys: Sequence[str], name: str) -> DataFrame:
    """Row count per key against a floor; a key without any row fails too."""
    wanted = df.sparkSession.createDataFrame(
        [(k, int(floors if isinstance(floors, int) else floors[k])) for k in keys], f"{by} string, _floor bigint"
    )
    both = F.broadcast(wanted).join(_counted(df, by, "n"), by, "left").na.fill(0, ["n"])
    return _result(both, f"{name} row floor", F.col("n"), F.col("n") >= F.col("_floor"), by)


def same_row_count(read: DataFrame, written: DataFrame, by: str) -> DataFrame:
    both = _counted(read, by, "a").join(_counted(written, by, "b"), by, "full").na.fill(0)
    return _result(both, "written rows equal read rows", F.col("b") - F.col("a"), F.col("a") == F.col("b"), by)


def ground_truth_names(districts: DataFrame, truth: Sequence[tuple[str, str, str]] = DISTRICT_GROUND_TRUTH) -> DataFrame:
    """Known cells must carry their known names."""
    expected = districts.sparkSession.createDataFrame(list(truth), "h3 string, want_area string, want_locality string")
    found = districts.select("h3_8", "area", "locality")
    both = F.broadcast(expected.withColumn("h3_8", G.cell_from_string("h3"))).join(found, "h3_8", "left")
    ok = (F.coalesce("area", F.lit("")) == F.col("want_area")) & (F.coalesce("locality", F.lit("")) == F.col("want_locality"))
    return _result(both, "known cell carries its known name", ok.cast("int"), ok, "h3")


def momentum_in_range(momentum: DataFrame, ranges=MOMENTUM_RANGES) -> DataFrame:
    """Named trades move as measured; a trade without history fails."""
    expected = momentum.sparkSession.createDataFrame(
        [(c, t, lo, hi) for c, t, lo, hi in ranges], "city string, category string, lo double, hi double"
    )
    both = F.broadcast(expected).join(momentum.select("city", "category", "pct_change"), ["city", "category"], "left")
    p = F.col("pct_change")
    closed = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    ok = F.when(closed, p.between(F.col("lo"), F.col("hi"))).otherwise(
        F.coalesce(p > F.col("lo"), F.lit(True)) & F.coalesce(p < F.col("hi"), F.lit(True)) & p.isNotNull()
    )
    both = both.withColumn("scope", F.concat_ws("/", "city", "category"))
    return _result(both, "momentum of a named trade", p, F.coalesce(ok, F.lit(False)), "scope")


def affinity_answers(places: DataFrame, target: str = "cafe", hit: str = "hair_salon") -> DataFrame:
    """A known pair has weight, an unknown one has none, and some cell fits."""
    from sitehex.operators.affinity import affinity_surface, lookup_weight

    spark = places.sparkSession
    pairs = spark.createDataFrame([(target, hit, True), (target, "__no_such_trade__", False)], "target string, category string, known boolean")
    looked = lookup_weight(pairs)
    ok = F.when(F.col("known"), F.col("weight") > 0).otherwise(F.col("weight") == 0)
    answers = _result(looked, "affinity lookup", F.col("weight"), ok, "category")
    best = affinity_surface(places, target).groupBy("city").agg(F.max("fit").alias("best"))
    return answers.unionByName(_result(best, "best affinity fit", F.col("best"), F.col("best") > 0))


def same_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two runs of one request return identical rows."""
    extra = first.exceptAll(second).select(F.lit(1).alias("x")).unionAll(
        second.exceptAll(first).select(F.lit(1).alias("x"))
    )
    d = extra.agg(F.count("*").alias("bad")).withColumn("city", F.lit("all"))
    return _none(d, "same request, same rows")
