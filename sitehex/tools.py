"""One call per question a user asks, composed from the operators.

Each function validates the city, resolves the trade word and returns a dict of lazy DataFrames and
small values. Rows stay distributed; nothing is collected unless the answer is a single fact.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.cities import check_city
from sitehex.functions import grid as G
from sitehex.operators import affinity, catchment, layers, ranking, saved, scoring, surface, trend
from sitehex.operators.atscale import cut_lineage
from sitehex.operators.ranking import RankRequest
from sitehex.reference_data import resolve_categories
from sitehex.sources.saved import append_saved_site
from sitehex.tables import Tables


def market_surface(tables: Tables, city: str, trade: str) -> DataFrame:
    """The scored cells of one city for one trade; pass it to the other calls to score only once."""
    c = check_city(city)
    return scoring.scored(tables, resolve_categories(trade), [c])


def _surface(tables: Tables, city: str, trade: str, given: DataFrame | None) -> DataFrame:
    return market_surface(tables, city, trade) if given is None else given


def find_competitors(tables: Tables, city: str, trade: str) -> dict:
    """Competitor features with the frame to show them in, or that there are none."""
    c, cats = check_city(city), resolve_categories(trade)
    frame = layers.competitors_bbox(tables.places, cats, [c])
    if frame.isEmpty():
        return {"error": "no_competitors", "city": c.name, "categories": list(cats)}
    return {"features": layers.competitors_layer(tables.places, cats, [c]), "frame": frame}


def score_area(tables: Tables, city: str, trade: str, market: DataFrame | None = None) -> dict:
    """The opportunity layer and its statistics from one scored surface."""
    c = check_city(city)
    # Layer and statistics read the same rows, so the surface is fixed once.
    s = cut_lineage(_surface(tables, city, trade, market))
    return {
        "surface": s,
        "features": surface.opportunity_layer(s, [c]),
        "stats": surface.opportunity_stats(s, [c]),
    }


def show_built_capacity(tables: Tables, city: str) -> dict:
    c = check_city(city)
    return {
        "features": layers.capacity_layer(tables.cell_capacity, [c]),
        "ramp": layers.capacity_ramp(tables.cell_capacity, [c]),
        "stats": layers.capacity_stats(tables.cell_capacity, [c]),
    }


def rank_sites(
    tables: Tables,
    city: str,
    trade: str,
    request: RankRequest = RankRequest(),
    market: DataFrame | None = None,
) -> dict:
    """Ranked picks with names and editorial fit, or the reason there are none."""
    c, cats = check_city(city), resolve_categories(trade)
    page = cut_lineage(
        ranking.rank_city(_surface(tables, city, trade, market), c.name, tables.districts, request, [c])
    )
    answer = ranking.resolve_rank_or_explain(page, tables.districts, c.name, request)
    if "error" in answer:
        return answer
    # A group of trades has no weights of its own; its first trade stands for it.
    fit = affinity.affinity_fit(page, tables.places, cats[0], cities=[c], picks_bound=request.count)
    return {"picks": page, "features": ranking.pick_features(page, fit, request)}


def show_catchment(
    tables: Tables,
    city: str,
    trade: str,
    request: RankRequest = RankRequest(),
    market: DataFrame | None = None,
) -> dict:
    """The walk around the top pick of the same ranking."""
    c = check_city(city)
    first = RankRequest(request.strategy, request.order, request.district, 1, 1)
    pick = cut_lineage(ranking.rank_city(_surface(tables, city, trade, market), c.name, tables.districts, first, [c]))
    row = pick.select("cell", G.cell_to_center_child("cell", 9).alias("origin")).first()
    if row is None:
        return {"error": "city_without_cells", "city": c.name}

    # The pick is one row, so its origin is a literal and the large tables are read by key.
    def here(df: DataFrame) -> DataFrame:
        return catchment.at_origins(df, c.name, [row.origin])

    stats = catchment.catchment_stats(
        pick, here(tables.isochrones), here(tables.isochrone_cells), tables.population, [c]
    )
    if not stats.first().measured:
        return {"error": "walk_not_measured", "city": c.name, "origin": row.origin}
    return {
        "stats": stats,
        "polygons": catchment.catchment_polygons(pick, here(tables.isochrones), picks_bound=1),
        "edges": catchment.catchment_edges(pick, here(tables.isochrone_edges), picks_bound=1),
    }


def save_site(
    tables: Tables,
    store: str,
    user: str,
    city: str,
    trade: str,
    which: int = 1,
    request: RankRequest = RankRequest(),
    market: DataFrame | None = None,
) -> dict:
    """Re-derive the ranking and append its ``which``-th pick, under the word the user typed."""
    c = check_city(city)
    six = RankRequest(request.strategy, request.order, request.district, ranking.MAX_COUNT, 1)
    picks = ranking.rank_city(_surface(tables, city, trade, market), c.name, tables.districts, six, [c])
    row = cut_lineage(saved.as_saved(picks, user, trade, which))
    fact = row.select("label").first()
    if fact is None:
        return {"error": "pick_not_found", "city": c.name, "which": which}
    append_saved_site(row, store)
    return {"saved": fact.label, "rank": which, "status": "candidate"}


def compare_saved_sites(
    tables: Tables, user: str, city: str, trade: str, market: DataFrame | None = None
) -> dict:
    """The user's sites of that trade against today's surface."""
    c = check_city(city)
    mine = tables.saved_sites.where(F.col("city") == c.name)
    rows = saved.saved_sites_market(mine, _surface(tables, city, trade, market), user, trade)
    if rows.isEmpty():
        return {"error": "no_saved_sites", "city": c.name, "trade": trade}
    return {"rows": rows.orderBy("created_at", "id"), "features": saved.saved_sites_layer(rows)}


def category_trend(tables: Tables, city: str, trade: str) -> DataFrame:
    """Momentum of the first trade the word stands for."""
    c, cats = check_city(city), resolve_categories(trade)
    wanted = tables.poi_history.sparkSession.createDataFrame([(c.name, cats[0])], "city string, category string")
    history = tables.poi_history.where((F.col("city") == c.name) & (F.col("category") == cats[0]))
    return trend.category_trend(wanted, history, trend.momentum_rollup(history))


def reweight(market: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """The surface under other slider positions, with the displayed score."""
    return scoring.display_gap(scoring.reweight(market, weights), weights)


def highlight_extreme(market: DataFrame, which: str = "worst", weights: Mapping[str, float] = scoring.NEUTRAL) -> DataFrame:
    return surface.extreme_cell(market, which, weights)
