"""The scored surface: demand x competition headroom x accessibility, per populated cell.

Everything is keyed by ``(city, cell)``, so any number of cities scores in one job, and each
input reaches that key with its map-side aggregate already applied. A signal a cell lacks stays
NULL and drops out of the formula; it never counts as zero.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City, country_of, matching_cities
from sitehex.functions import grid as G
from sitehex.functions.text import half_up_1dp
from sitehex.operators.atscale import broadcast_bounded, cut_lineage, exact_quantiles
from sitehex.tables import Tables

KEY = ["city", "cell"]
P95_AXES = ("pop", "sup", "acc_pop", "cap_area", "addr_cnt")
NEUTRAL: dict[str, float] = {"demand": 50, "low_competition": 50, "accessibility": 50}


def city_cells(population: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Populated cells whose centre lies in a city's box, one row per (city, cell)."""
    def inside(c: City) -> Column:
        return (F.col("country") == c.country) & c.contains(F.col("_lon"), F.col("_lat"))

    # A cell outside every box matches no city and so explodes to no row.
    wanted = population.where(F.col("country").isin(sorted({c.country for c in cities})))
    own = G.require_lattice("h3_8")
    return G.with_center(wanted.withColumn("h3_8", own), "h3_8", G.BASE_RES, "_lon", "_lat", cities).select(
        F.explode(matching_cities(inside, cities)).alias("city"),
        F.col("h3_8").alias("cell"),
        F.col("population").cast("double").alias("pop"),
    )


def in_cities(df: DataFrame, cities: Sequence[City]) -> DataFrame:
    return df.where(F.col("city").isin([c.name for c in cities]))


def ring_supply(
    places: DataFrame, categories: Sequence[str] | None = None, cities: Sequence[City] = CITIES
) -> DataFrame:
    """Competitors in each cell and its six neighbours.

    Places collapse to counts per cell before the ring is expanded: the same sum with at most
    seven rows per occupied cell in the shuffle instead of seven per place.
    """
    return ring_rows(places, categories, cities).groupBy(*KEY).agg(F.sum("sup").alias("sup"))


def ring_rows(
    places: DataFrame, categories: Sequence[str] | None, cities: Sequence[City] = CITIES
) -> DataFrame:
    """Partial ring counts, up to seven rows per occupied cell, still to be summed."""
    picked = in_cities(places, cities)
    if categories is not None:
        picked = picked.where(F.col("category").isin(list(categories)))
    per_cell = picked.groupBy("city", "h3_8").agg(F.count("*").alias("sup"))
    return per_cell.select("city", F.explode(G.cell_ring("h3_8")).alias("cell"), "sup")


def capacity(cell_capacity: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Floor area per cell; sums over rollup parts that were not compacted yet."""
    return (
        in_cities(cell_capacity, cities)
        .groupBy("city", F.col("h3_8").alias("cell"))
        .agg(F.sum("floor_area_m2").alias("cap_area"))
    )


def addresses(addr_density: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    return in_cities(addr_density, cities).select(
        "city", F.col("h3_8").alias("cell"), F.col("addr_count").alias("addr_cnt")
    )


def accessibility(
    isochrone_cells: DataFrame,
    population: DataFrame,
    cities: Sequence[City] = CITIES,
    minutes: int = 10,
    grid: str = "lattice",
) -> DataFrame:
    """People within a walk of each cell's centre child (one seventh of every reached parent)."""
    rows = access_rows(isochrone_cells, population, cities, minutes, grid)
    return rows.groupBy(*KEY).agg((F.sum("acc_pop") / 7).alias("acc_pop"))


def access_rows(
    isochrone_cells: DataFrame,
    population: DataFrame,
    cities: Sequence[City] = CITIES,
    minutes: int = 10,
    grid: str = "lattice",
) -> DataFrame:
    """Residents of every reached parent times its reached children, still to be summed and
    divided by seven.

    Whether an origin is the centre child of its parent is a property of its id, so six of seven
    reach rows are dropped at the scan, before any shuffle. What remains is counted per
    (cell, reached parent) map-side, and only those counts meet the population.
    """
    reached = (
        in_cities(isochrone_cells, cities)
        .where((F.col("minutes") == minutes) & G.is_center_child("origin_h3_9", 9, grid))
        .groupBy(
            "city",
            G.cell_to_parent("origin_h3_9", 8, grid=grid).alias("cell"),
            G.cell_to_parent("reachable_h3_9", 8, grid=grid).alias("h3_8"),
        )
        .agg(F.count("*").alias("children"))
        .withColumn("country", country_of(F.col("city"), cities))
    )
    people = population.select("country", "h3_8", F.col("population").cast("double").alias("population"))
    return reached.join(people, ["country", "h3_8"]).select(
        *KEY, (F.col("population") * F.col("children")).alias("acc_pop")
    )


def joined(
    tables: Tables,
    categories: Sequence[str],
    cities: Sequence[City] = CITIES,
) -> DataFrame:
    """All signals on the populated cells; supply misses are 0, other misses stay NULL.

    Every signal arrives as rows of one shape and a single aggregate on (city, cell) brings them
    together: one shuffle with map-side sums instead of four left joins. Cells without population
    inside the box are dropped afterwards, so a ring spilling over the edge adds no rows.
    """
    signals = {
        "pop": city_cells(tables.population, cities),
        "sup": ring_rows(tables.places, categories, cities),
        "cap_area": in_cities(tables.cell_capacity, cities).select(
            "city", F.col("h3_8").alias("cell"), F.col("floor_area_m2").alias("cap_area")
        ),
        "addr_cnt": addresses(tables.addr_density, cities),
        "acc_pop": access_rows(tables.isochrone_cells, tables.population, cities),
    }
    kinds = {"pop": "double", "sup": "bigint", "cap_area": "double", "addr_cnt": "bigint", "acc_pop": "double"}
    stacked = None
    for name, rows in signals.items():
        shaped = rows.select(
            *KEY, *[(F.col(k) if k == name else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
        )
        stacked = shaped if stacked is None else stacked.unionAll(shaped)
    return (
        stacked.groupBy(*KEY)
        .agg(
            F.max("pop").alias("pop"),
            F.coalesce(F.sum("sup"), F.lit(0).cast("bigint")).alias("sup"),
            F.sum("cap_area").alias("cap_area"),
            F.max("addr_cnt").alias("addr_cnt"),
            (F.sum("acc_pop") / 7).alias("acc_pop"),
        )
        .where(F.col("pop").isNotNull())
    )


def scale(
    cells: DataFrame,
    cities: Sequence[City] = CITIES,
    axes: Sequence[str] = P95_AXES,
) -> DataFrame:
    """95th percentile of every axis over the cells that have it, one row per city.

    All but the population scale are floored at 1 so a nearly empty axis cannot divide by zero.
    """
    long = cells.select(
        "city",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("x"))
                    for a in axes
                ]
            )
        ),
    )
    p95 = exact_quantiles(long, ["city", "axis"], "x", {"p95": 0.95}, len(cities) * len(axes))
    out = []
    for a in axes:
        v = F.max(F.when(F.col("axis") == a, F.col("p95")))
        name = {"acc_pop": "acc", "cap_area": "cap", "addr_cnt": "addr"}.get(a, a)
        out.append((v if a == "pop" else F.greatest(v, F.lit(1.0))).alias(f"{name}_p95"))
    return p95.groupBy("city").agg(*out)


def _share(value: str, p95: str) -> Column:
    # least() skips NULLs, so an absent value has to be kept absent explicitly.
    share = F.col(value) * 100.0 / F.col(p95)
    return F.when(share.isNotNull(), F.least(F.lit(100.0), share))


def score(cells: DataFrame, scales: DataFrame, cities: Sequence[City] = CITIES) -> DataFrame:
    """Attach the per-city scales and compute demand, supply, accessibility and gap."""
    has_cap = F.col("cap_area").isNotNull()
    has_addr = F.col("addr_cnt").isNotNull()
    return (
        cells.join(broadcast_bounded(scales, len(cities)), "city")
        .withColumn("pop_n", _share("pop", "pop_p95"))
        .withColumn("cap_n", _share("cap_area", "cap_p95"))
        .withColumn("addr_n", _share("addr_cnt", "addr_p95"))
        .withColumn("supply_n", _share("sup", "sup_p95"))
        .withColumn("acc_n", _share("acc_pop", "acc_p95"))
        .withColumn(
            "dem",
            (F.col("pop_n") + F.coalesce("cap_n", F.lit(0.0)) + F.coalesce("addr_n", F.lit(0.0)))
            / (F.lit(1.0) + has_cap.cast("double") + has_addr.cast("double")),
        )
        .withColumn(
            "gap",
            F.col("dem") * (100.0 - F.col("supply_n")) / 100.0
            * F.coalesce(F.col("acc_n") / 100.0, F.lit(1.0)),
        )
    )


def scored(
    tables: Tables,
    categories: Sequence[str],
    cities: Sequence[City] = CITIES,
) -> DataFrame:
    """The scored surface of one trade over any number of cities.

    The joined signals feed the scales twice and the score once. They are written first: one row per
    populated cell, far smaller than the inputs, and safe against executor loss.
    """
    cells = cut_lineage(joined(tables, categories, cities))
    return score(cells, scale(cells, cities), cities)


def scored_two_factor(
    tables: Tables, categories: Sequence[str], cities: Sequence[City] = CITIES
) -> DataFrame:
    """Historic baseline: residents against competition only."""
    cells = (
        city_cells(tables.population, cities)
        .join(ring_supply(tables.places, categories, cities), KEY, "left")
        .withColumn("sup", F.coalesce("sup", F.lit(0).cast("bigint")))
    )
    scales = scale(cells, cities, ("pop", "sup"))
    return (
        cells.join(broadcast_bounded(scales, len(cities)), "city")
        .withColumn("demand_n", _share("pop", "pop_p95"))
        .withColumn("supply_n", _share("sup", "sup_p95"))
        .withColumn("gap", F.col("demand_n") * (100.0 - F.col("supply_n")) / 100.0)
    )


def exponents(weights: Mapping[str, float]) -> dict[str, float]:
    """Exponents of the three factors: the slider values over their mean, or 1 each if all are 0."""
    sliders = {name: max(float(weights[name]), 0.0) for name in NEUTRAL}
    mean = sum(sliders.values()) / len(sliders)
    return {name: value / mean if mean else 1.0 for name, value in sliders.items()}


def reweight(surface: DataFrame, weights: Mapping[str, float], out: str = "gap_weighted") -> DataFrame:
    """Weighted product of the same three factors; an absent factor is skipped."""
    e = exponents(weights)

    def factor(term: Column, name: str) -> Column:
        return F.pow(term / 100.0, F.lit(e[name]))

    product = (
        F.lit(100.0)
        * factor(F.col("dem"), "demand")
        * factor(F.lit(100.0) - F.col("supply_n"), "low_competition")
        * F.coalesce(factor(F.col("acc_n"), "accessibility"), F.lit(1.0))
    )
    return surface.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(100.0), product)))


def display_gap(surface: DataFrame, weights: Mapping[str, float] = NEUTRAL) -> DataFrame:
    return reweight(surface, weights, "_g").withColumn("gap_display", half_up_1dp("_g")).drop("_g")
