"""Ranking sites: lenses, the avoid list, district scope, paging and pick features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitehex.cities import CITIES, City
from sitehex.functions import geometry as geo
from sitehex.functions import grid as G
from sitehex.functions.text import district_matches, lens_label, place_name
from sitehex.operators.scoring import in_cities

# Lens weights over (demand, competition headroom, accessibility).
LENSES = {
    "demand": (1.0, 0.2, 0.3),
    "low_competition": (0.3, 1.0, 0.2),
    "accessible": (0.3, 0.2, 1.0),
}
STRATEGIES = ("balanced", *LENSES)
# Share of the population scale a saturated cell must reach to be listed.
WORST_MIN_POP = 0.4
MAX_COUNT = 6


@dataclass(frozen=True)
class RankRequest:
    """Validated ranking controls; ``page`` is 1-based and ranks are global across pages."""

    strategy: str = "balanced"
    order: str = "best"
    district: str | None = None
    count: int = 3
    page: int = 1

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.order not in ("best", "worst"):
            raise ValueError(f"unknown order {self.order!r}")
        if not 1 <= self.count <= MAX_COUNT or self.page < 1:
            raise ValueError("count must be 1..6 and page at least 1")

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.count

    @property
    def scope(self) -> str | None:
        return self.district.strip() if self.district and self.district.strip() else None

    @property
    def is_default(self) -> bool:
        return self.strategy == "balanced" and self.order == "best" and self.scope is None and self.page == 1


def rank_order(request: RankRequest) -> list[Column]:
    """A total order for every combination of controls: each one ends in the cell id."""
    cell = F.col("cell").asc()
    if request.order == "worst":
        return [F.col("sup").desc(), F.col("gap").asc(), cell]
    if request.strategy == "balanced":
        return [F.col("gap").desc(), F.col("pop").desc(), cell]
    d, c, a = LENSES[request.strategy]
    lens = F.col("dem") * d + (100.0 - F.col("supply_n")) * c + F.col("acc_n") * a
    return [lens.desc(), F.col("pop").desc(), cell]


def candidates(surface: DataFrame, districts: DataFrame | None, request: RankRequest) -> DataFrame:
    """Measured cells with their names, filtered by the request.

    Unmeasured cells carry a two-factor score and would not compare with the rest.
    """
    out = surface.where(F.col("acc_pop").isNotNull())
    if request.order == "worst":
        out = out.where(F.col("pop") >= F.col("pop_p95") * WORST_MIN_POP)
    if districts is None:
        return out.withColumn("area", F.lit(None).cast("string")).withColumn("locality", F.lit(None).cast("string"))
    names = districts.select("city", F.col("h3_8").alias("cell"), "area", "locality")
    if request.scope is None:
        return out.join(names, ["city", "cell"], "left")
    named = names.where(district_matches(request.scope, "area", "locality"))
    return out.join(named, ["city", "cell"])


def _describe(ranked: DataFrame, cities: Sequence[City]) -> DataFrame:
    return (
        G.with_center(ranked, "cell", G.BASE_RES, "_lon", "_lat", cities)
        .select(
            "city", "rank", "cell", G.cell_to_string("cell").alias("h3"),
            F.bround("gap", 1).alias("gap"), "dem", F.bround("pop").alias("pop"), "sup",
            F.bround("acc_pop").alias("acc"), F.bround("cap_area").alias("cap_m2"),
            F.col("addr_cnt").alias("addr"),
            F.bround(F.col("_lon"), 5).alias("lon"), F.bround(F.col("_lat"), 5).alias("lat"),
            "area", "locality",
        )
    )


def rank_sites(
    surface: DataFrame,
    districts: DataFrame | None = None,
    request: RankRequest = RankRequest(),
    cities: Sequence[City] = CITIES,
) -> DataFrame:
    """The requested page of every city in one job.

    The rank filter becomes a per-task group limit, so at most ``offset + count`` rows per city
    and task are shuffled, however large a city is.
    """
    last = request.offset + request.count
    w = Window.partitionBy("city").orderBy(*rank_order(request))
    ranked = (
        candidates(surface, districts, request)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= last)
        .where(F.col("rank") > request.offset)
    )
    return _describe(ranked, cities)


def rank_city(
    surface: DataFrame,
    city: str,
    districts: DataFrame | None = None,
    request: RankRequest = RankRequest(),
    cities: Sequence[City] = CITIES,
) -> DataFrame:
    """One city's page through a top-k sort with offset."""
    page = (
        candidates(surface.where(F.col("city") == city), districts, request)
        .orderBy(*rank_order(request))
        .offset(request.offset)
        .limit(request.count)
    )
    w = Window.partitionBy("city").orderBy(*rank_order(request))
    return _describe(page.withColumn("rank", F.row_number().over(w) + request.offset), cities)


def available_districts(districts: DataFrame, limit: int = 12, cities: Sequence[City] = CITIES) -> DataFrame:
    """Most covered locality names per city, offered when a district matched nothing."""
    w = Window.partitionBy("city").orderBy(F.col("cells").desc(), F.col("locality").asc())
    return (
        in_cities(districts, cities)
        .where(F.col("locality") != "")
        .groupBy("city", "locality")
        .agg(F.count("*").alias("cells"))
        .withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= limit)
        .select("city", "position", "locality", "cells")
    )


def resolve_rank_or_explain(picks: DataFrame, districts: DataFrame, city: str, request: RankRequest) -> dict:
    """Picks, or a code for why there are none with what the caller can do about it."""
    if not picks.isEmpty():
        return {"picks": picks}
    asked = {"city": city, "page": request.page, "district": request.scope}
    if request.scope is not None:
        return {"error": "district_empty", **asked, "available": available_districts(districts.where(F.col("city") == city))}
    return {"error": "page_past_end" if request.page > 1 else "city_without_cells", **asked}


def pick_features(picks: DataFrame, fit: DataFrame, request: RankRequest = RankRequest()) -> DataFrame:
    """Picks with their place name, lens badge and editorial fit as typed columns and a feature.

    ``fit`` comes from ``affinity.affinity_fit``; it is left out where no complementary trade is
    nearby. The score itself is never touched by it.
    """
    label = lens_label(
        F.lit(request.strategy), F.lit(request.order), F.lit(request.scope).cast("string"), F.lit(request.page)
    )
    near = fit.where(F.size("top_neighbours") > 0).select(
        "city", F.col("pick").alias("cell"), "fit", "top_neighbours"
    )
    out = (
        picks.join(near, ["city", "cell"], "left")
        .withColumn("place", place_name("area", "locality"))
        .withColumn("lens", label)
    )
    props = F.struct(
        "rank", "gap", "dem", "acc", "pop", "sup", F.col("cap_m2").alias("capM2"), "addr", "h3", "place",
        "fit", F.col("top_neighbours").alias("topNeighbours"), "lens",
    )
    return out.withColumn("feature", geo.feature_json(geo.point_geometry("lon", "lat"), props))
