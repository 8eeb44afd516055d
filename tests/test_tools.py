"""The composed calls, over tables written by the refresh chain."""

import pytest
from pyspark.sql import functions as F

from sitehex import Tables, UnknownCity, tools
from sitehex.operators.atscale import new_folder
from sitehex.operators.ranking import RankRequest
from sitehex.plans import refresh as RF
from sitehex.plans import surrogates as S
from sitehex.plans import warehouse as W
from sitehex.sources import publish, versions


@pytest.fixture(scope="module")
def tables(spark, sf):
    names = [n for n in Tables.__dataclass_fields__]
    return Tables(**{n: W.stored(spark, sf, n) for n in names})


@pytest.fixture(scope="module")
def market(tables):
    return tools.score_area(tables, "Berlin", "food and drink")["surface"]


def test_unknown_city_is_refused(tables):
    for call in (tools.find_competitors, tools.score_area, tools.rank_sites, tools.category_trend):
        with pytest.raises(UnknownCity):
            call(tables, "paris", "bakery")


def test_find_and_score(tables, market):
    found = tools.find_competitors(tables, "berlin", "food and drink")
    assert found["frame"].first().n == found["features"].count() > 0
    assert market.select("city").distinct().collect()[0].city == "berlin"
    built = tools.show_built_capacity(tables, "berlin")
    assert built["stats"].first().cell_count == built["features"].count() == built["ramp"].count()


def test_rank_walk_and_save(spark, tables, market):
    ranked = tools.rank_sites(tables, "berlin", "food and drink", market=market)
    top = ranked["picks"].orderBy("rank").first()
    assert ranked["features"].count() == 3
    walk = tools.show_catchment(tables, "berlin", "food and drink", market=market)
    assert walk["stats"].first().cell == top.cell
    assert walk["edges"].count() > 0 and walk["polygons"].count() >= 1
    store = new_folder(spark, "saved")
    done = tools.save_site(tables, store, "u1", "berlin", "food and drink", 1, market=market)
    assert done["status"] == "candidate"
    assert "error" in tools.save_site(tables, store, "u1", "berlin", "food and drink", 1, RankRequest(district="nowhere"), market)
    kept = Tables(**{**tables.__dict__, "saved_sites": spark.read.parquet(store)})
    row = tools.compare_saved_sites(kept, "u1", "berlin", "food and drink", market)["rows"].first()
    assert (row.market_gap, row.h3_8) == (top.gap, top.h3)
    assert tools.compare_saved_sites(kept, "u1", "berlin", "bakery", market)["error"] == "no_saved_sites"


def test_district_without_cells_lists_names(tables, market):
    out = tools.rank_sites(tables, "berlin", "food and drink", RankRequest(district="nowhere"), market)
    assert out["error"] == "district_empty" and out["available"].count() > 0


def test_trend_and_sliders(tables, market):
    r = tools.category_trend(tables, "berlin", "coffee").first()
    assert r.category == "cafe" and r.enough_history and len(r.monthly) == r.n
    assert not tools.category_trend(tables, "berlin", "gym").first().enough_history
    shown = tools.reweight(market, {"demand": 80, "low_competition": 20, "accessibility": 50})
    best = tools.highlight_extreme(market, "best", {"demand": 80, "low_competition": 20, "accessibility": 50}).first()
    assert best.score == shown.agg(F.max("gap_display")).first()[0]


def test_reach_load_publishes_both_or_neither(spark, sf):
    root = new_folder(spark, "warehouse")
    # Far second lobes break the ceiling on purpose; keep the origins without them for the good load.
    raw = S.raw_contours(spark, sf).where(~S.two_lobes())
    done = RF.refresh(spark, RF.RawInputs(contours=raw, edges=S.raw_edges(spark, sf)), root)
    assert done["isochrones"] > 0 and done["isochrone_cells"] > done["isochrones"]
    assert done["isochrone_edges"] == versions.open_table(spark, root, "isochrone_edges").count()
    bad = new_folder(spark, "warehouse")
    with pytest.raises(publish.CheckFailed):
        RF.refresh(spark, RF.RawInputs(contours=S.raw_contours(spark, sf)), bad)
    assert not versions.is_published(spark, bad, "isochrones")
    assert not versions.is_published(spark, bad, "isochrone_cells")
    assert versions.sweep(spark, bad) == []  # nothing was left behind
