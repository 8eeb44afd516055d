import json

import pytest
from pyspark.sql import functions as F

from sitehex import UnknownCity, check_city
from sitehex.functions import grid as G
from sitehex.operators import affinity, ranking, saved, scoring, surface, trend
from sitehex.operators.ranking import RankRequest
from sitehex.plans import warehouse as W
from sitehex.reference_data import AFFINITY, resolve_categories
from sitehex.tables import Tables


@pytest.fixture(scope="module")
def market(spark, sf):
    return W.surface(spark, sf, "food and drink")


@pytest.fixture(scope="module")
def toy(spark):
    """Three neighbouring berlin cells whose signals are written by hand."""
    def cell(q, r):
        return (0 * 16 + 8) * G.RES_UNIT + (q + G.OFFSET) * G.Q_UNIT + (r + G.OFFSET)

    a, b, c = cell(0, 0), cell(5, 0), cell(0, 5)
    centre = (0 * 16 + 9) * G.RES_UNIT + G.OFFSET * G.Q_UNIT + G.OFFSET
    return a, b, c, Tables(
        places=spark.createDataFrame(
            [("1", "bakery", "berlin", a + G.Q_UNIT), ("2", "bakery", "berlin", a), ("3", "cafe", "berlin", b)],
            "id string, category string, city string, h3_8 bigint",
        ),
        population=spark.createDataFrame([(a, 700.0, "DE"), (b, 140.0, "DE"), (c, 70.0, "DE")], "h3_8 bigint, population float, country string"),
        cell_capacity=spark.createDataFrame([("berlin", a, 100.0, 1), ("berlin", a, 50.0, 1)], "city string, h3_8 bigint, floor_area_m2 double, buildings bigint"),
        addr_density=spark.createDataFrame([("berlin", b, 4)], "city string, h3_8 bigint, addr_count bigint"),
        isochrone_cells=spark.createDataFrame(
            [(centre, 10, centre, "berlin"), (centre, 10, centre + G.Q_UNIT, "berlin"), (centre, 5, centre, "berlin"), (centre + G.Q_UNIT, 10, centre, "berlin")],
            "origin_h3_9 bigint, minutes int, reachable_h3_9 bigint, city string",
        ),
    )


def test_absent_is_not_zero(toy):
    a, b, c, tables = toy
    rows = {r.cell: r for r in scoring.joined(tables, ["bakery"]).collect()}
    assert set(rows) == {a, b, c}
    assert (rows[a].sup, rows[b].sup) == (2, 0)  # the ring reaches one step, misses are 0
    assert rows[a].cap_area == 150.0  # rollup parts add up
    assert rows[b].cap_area is None and rows[a].addr_cnt is None and rows[b].acc_pop is None
    # Only the centre child counts as origin; two children of one parent hold two sevenths of it.
    assert rows[a].acc_pop == pytest.approx(200.0)


def test_demand_is_the_mean_of_present_axes(toy):
    a, b, c, tables = toy
    rows = {r.cell: r for r in scoring.scored(tables, ["bakery"]).collect()}
    assert rows[a].dem == pytest.approx((100 + 100) / 2)
    assert rows[b].dem == pytest.approx((rows[b].pop_n + 100) / 2)
    assert rows[c].dem == pytest.approx(rows[c].pop_n)
    assert rows[c].acc_n is None
    assert rows[c].gap == pytest.approx(rows[c].dem * (100 - rows[c].supply_n) / 100)


def test_neutral_reweight_equals_gap(market):
    df = scoring.reweight(market, scoring.NEUTRAL, "w")
    assert df.agg(F.max(F.abs(F.col("w") - F.col("gap"))).alias("d")).first().d < 1e-9


def test_exponents():
    assert scoring.exponents({"demand": 50, "low_competition": 50, "accessibility": 50}) == {"demand": 1, "low_competition": 1, "accessibility": 1}
    assert scoring.exponents({"demand": 0, "low_competition": 0, "accessibility": 0})["demand"] == 1
    assert scoring.exponents({"demand": -5, "low_competition": 30, "accessibility": 0}) == {"demand": 0, "low_competition": 3, "accessibility": 0}


def test_pages_are_disjoint_and_ordered(market):
    six = [r.cell for r in ranking.rank_city(market, "berlin", None, RankRequest(count=6)).orderBy("rank").collect()]
    pages = []
    for p in (1, 2, 3):
        rows = ranking.rank_city(market, "berlin", None, RankRequest(count=2, page=p)).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == [2 * p - 1, 2 * p]
        pages += [r.cell for r in rows]
    assert pages == six


def test_city_and_group_ranking_agree(market):
    every = {(r.city, r["rank"], r.cell) for r in ranking.rank_sites(market, None, RankRequest(count=4)).collect()}
    one = {(r.city, r["rank"], r.cell) for r in ranking.rank_city(market, "belgrade", None, RankRequest(count=4)).collect()}
    assert one == {x for x in every if x[0] == "belgrade"}


def test_bad_requests_are_refused():
    for kw in ({"count": 0}, {"count": 7}, {"page": 0}, {"strategy": "x"}, {"order": "x"}):
        with pytest.raises(ValueError):
            RankRequest(**kw)
    with pytest.raises(UnknownCity) as e:
        check_city("paris")
    assert e.value.available == ["berlin", "amsterdam", "belgrade"]
    assert check_city(" Berlin ").name == "berlin"
    assert resolve_categories(" Food & Drink") == ["restaurant", "cafe", "bakery"]
    assert resolve_categories("Pizza") == ["pizza"]


def test_rank_explanations(spark, sf, market):
    districts = W.stored(spark, sf, "districts")
    late = RankRequest(page=10_000)
    out = ranking.resolve_rank_or_explain(ranking.rank_city(market, "berlin", districts, late), districts, "berlin", late)
    assert out["error"] == "page_past_end"
    empty = market.where("false")
    out = ranking.resolve_rank_or_explain(ranking.rank_city(empty, "berlin", districts), districts, "berlin", RankRequest())
    assert out["error"] == "city_without_cells"
    assert "picks" in ranking.resolve_rank_or_explain(ranking.rank_city(market, "berlin", districts), districts, "berlin", RankRequest())


def test_fit_keeps_picks_without_neighbours(spark, toy):
    a, b, c, tables = toy
    picks = spark.createDataFrame([("berlin", a), ("berlin", b), ("berlin", c)], "city string, cell bigint")
    rows = {r.pick: r for r in affinity.affinity_fit(picks, tables.places, "bakery").collect()}
    assert rows[b].fit == 0.5 and [e.category for e in rows[b].top_neighbours] == ["cafe"]
    assert rows[c].fit == 0.0 and rows[c].top_neighbours == []
    assert sum(len(v) for v in AFFINITY.values()) == 61


def test_pick_feature_json(spark, sf, market):
    picks = ranking.rank_sites(market, W.stored(spark, sf, "districts"))
    fit = affinity.affinity_fit(picks, W.stored(spark, sf, "places"), "restaurant")
    for r in ranking.pick_features(picks, fit).collect():
        props = json.loads(r.feature)["properties"]
        assert ("fit" in props) == (r.fit is not None)
        assert ("place" in props) == (r.place is not None)
        assert "lens" not in props


def test_opportunity_features_drop_unmeasured_access(market):
    joined = surface.opportunity_layer(market).join(market.select("city", "cell", "acc_pop"), ["city", "cell"])
    for r in joined.limit(200).collect():
        f = json.loads(r.feature)
        assert ("acc" in f["properties"]) == (r.acc_pop is not None)
        assert f["geometry"]["coordinates"][0][0] == f["geometry"]["coordinates"][0][-1]


def test_unscored_site_keeps_no_market_keys(spark, market):
    rows = [
        ("1", "u1", "berlin", "bakery", "out", "", 1.0, 2.0, "8f", None, "candidate"),
    ]
    sites = spark.createDataFrame(rows, "id string, user_id string, city string, business_type string, label string, note string, lon double, lat double, h3_8 string, score double, status string")
    sites = sites.withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
    out = saved.saved_sites_market(sites, market, business_type="bakery")
    r = out.first()
    assert (r.market_gap, r.residents, r.rivals) == (None, None, None)
    props = json.loads(saved.saved_sites_layer(out).first().feature)["properties"]
    assert props == {"label": "out", "status": "candidate"}
    assert saved.saved_sites_market(sites, market, business_type="cafe").count() == 0


def test_latest_version_wins_even_on_ties(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "w")]
    df = spark.createDataFrame(rows, "k string, v int, t string")
    got = {(r.k, r.t) for r in saved.latest_versions(df, ["k"], "v").collect()}
    assert got == {("a", "z"), ("b", "w")}


def test_trend_of_unknown_trade(spark, sf):
    wanted = spark.createDataFrame([("berlin", "unicorns")], "city string, category string")
    r = trend.category_trend(wanted, W.stored(spark, sf, "poi_history"), W.stored(spark, sf, "category_momentum")).first()
    assert (r.enough_history, r.pct_change, r.monthly, r.direction, r.from_year) == (False, None, [], "flat", None)


def test_radius_join_against_brute_force(spark, sf):
    from sitehex.functions import geometry as geo

    sites = W.stored(spark, sf, "saved_sites").select(F.col("id").alias("site_id"), "city", "lon", "lat").distinct().limit(25)
    places = W.stored(spark, sf, "places")
    got = {(r.site_id, r.city, r.category): (r.n_within, round(r.nearest_m, 6)) for r in saved.radius_join(sites, places, 1500.0).collect()}
    # Fixture only: 25 sites against the small table.
    pairs = F.broadcast(sites.withColumnsRenamed({"lon": "slon", "lat": "slat"})).join(places, "city")
    pairs = pairs.withColumn("dd", geo.geo_distance_m("slon", "slat", "lon", "lat")).where("dd <= 1500")
    want = {
        (r.site_id, r.city, r.category): (r.n, round(r.m, 6))
        for r in pairs.groupBy("site_id", "city", "category").agg(F.count("*").alias("n"), F.min("dd").alias("m")).collect()
    }
    assert got == want and want


def test_one_crowded_cell_adds_up(spark):
    """A third of all places on one spot: the ring counts stay exact."""
    cell = (0 * 16 + 8) * G.RES_UNIT + G.OFFSET * G.Q_UNIT + G.OFFSET
    crowd = spark.range(30_000).select(F.lit("berlin").alias("city"), F.lit("cafe").alias("category"), F.lit(cell).alias("h3_8"))
    rest = spark.range(60_000).select(
        F.lit("berlin").alias("city"), F.lit("cafe").alias("category"), (F.lit(cell) + (F.col("id") % 300 + 2) * G.Q_UNIT).alias("h3_8")
    )
    got = {r.cell: r.sup for r in scoring.ring_supply(crowd.unionAll(rest), ["cafe"]).collect()}
    assert got[cell] == 30_000
    assert got[cell + G.Q_UNIT] == 30_000 + 200
    assert sum(got.values()) == 7 * 90_000
