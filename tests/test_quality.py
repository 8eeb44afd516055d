"""Every check must pass on good data and fail on a twin that is broken the way it hunts."""

import pytest
from pyspark.sql import functions as F

from sitehex.functions import grid as G
from sitehex.operators import quality as qc
from sitehex.operators import scoring
from sitehex.plans import surrogates as S
from sitehex.plans import warehouse as W


@pytest.fixture(scope="module")
def reach(spark, sf):
    return W.stored(spark, sf, "isochrone_cells").cache()


@pytest.fixture(scope="module")
def edges(spark, sf):
    return W.stored(spark, sf, "isochrone_edges").cache()


@pytest.fixture(scope="module")
def market(spark, sf):
    return W.surface(spark, sf, "food and drink")


def passes(df):
    rows = df.collect()
    assert rows
    return all(r.passed for r in rows)


def relabel(df):
    m = F.col("minutes")
    return df.withColumn("minutes", F.when(m == 5, 15).when(m == 15, 5).otherwise(m))


def far(df, steps):
    """Scale the reach of every origin: the axial offset is multiplied."""
    dq = G.cell_q("reachable_h3_9") - G.cell_q("origin_h3_9")
    dr = G.cell_r("reachable_h3_9") - G.cell_r("origin_h3_9")
    return df.withColumn("reachable_h3_9", F.col("origin_h3_9") + (dq * G.Q_UNIT + dr) * steps)


def test_reach_checks_pass(spark, sf, reach):
    people = W.stored(spark, sf, "population")
    for df in (
        qc.reach_inside_box(reach), qc.reach_grows(reach), qc.reach_nested(reach), qc.origin_in_own_reach(reach),
        qc.reach_ceiling(reach), qc.reach_p999(reach), qc.far_origins_disjoint(reach), qc.cells_reach_themselves(reach, people),
    ):
        assert passes(df)


def test_wrong_city_fails_the_box(reach):
    swapped = reach.withColumn("city", F.when(F.col("city") == "berlin", "belgrade").otherwise("berlin"))
    assert not passes(qc.reach_inside_box(swapped))


def test_mislabelled_minutes_fail(reach):
    bad = relabel(reach)
    assert not passes(qc.reach_grows(bad))
    assert not passes(qc.reach_nested(bad))


def test_shifted_origin_fails(spark, sf, reach):
    bad = reach.withColumn("reachable_h3_9", F.col("reachable_h3_9") + 8 * G.Q_UNIT)
    assert not passes(qc.origin_in_own_reach(bad))
    assert not passes(qc.cells_reach_themselves(bad, W.stored(spark, sf, "population")))


def test_far_reach_fails(reach):
    bad = far(reach, 10)
    assert not passes(qc.reach_ceiling(bad))
    assert not passes(qc.reach_p999(bad))


def test_overlapping_far_origins_fail(reach):
    shared = reach.withColumn("reachable_h3_9", F.lit(1).cast("bigint"))
    assert not passes(qc.far_origins_disjoint(shared))


def test_skip_rate(spark, sf, reach):
    wanted = scoring.city_cells(W.stored(spark, sf, "population")).select("city", G.cell_to_center_child("cell", 9).alias("h3_9"))
    assert passes(qc.skip_rate(reach, wanted))
    assert not passes(qc.skip_rate(reach.where(F.pmod(F.xxhash64("origin_h3_9"), F.lit(4)) == 0), wanted))


def test_edge_checks_pass(spark, sf, edges):
    for df in (
        qc.edges_inside_box(edges), qc.web_touches_origin(edges), qc.edge_distance_p999(edges),
        qc.edge_origins_have_contours(edges, W.stored(spark, sf, "isochrones")), qc.duration_gradient(edges),
    ):
        assert passes(df)


def test_swapped_edge_coordinates_fail(edges):
    pts = F.from_json("geom", "array<array<double>>")
    bad = edges.withColumn("geom", F.to_json(F.transform(pts, lambda p: F.reverse(p))))
    assert not passes(qc.edges_inside_box(bad))
    assert not passes(qc.web_touches_origin(bad))


def test_broken_edges_fail(spark, sf, edges):
    assert not passes(qc.duration_gradient(edges.withColumn("duration_s", F.lit(60))))
    assert not passes(qc.edge_distance_p999(edges.withColumn("dist_m", F.col("dist_m") * 10)))
    few = W.stored(spark, sf, "isochrones").where(F.pmod(F.xxhash64("origin_h3_9"), F.lit(2)) == 0)
    assert not passes(qc.edge_origins_have_contours(edges, few))


def test_score_checks(market):
    assert passes(qc.access_includes_home(market))
    assert passes(qc.score_identity(market))
    zeroed = market.withColumn("acc_pop", F.coalesce("acc_pop", F.lit(0.0)))
    assert not passes(qc.access_includes_home(zeroed))
    no_access = market.withColumn("acc_n", F.coalesce("acc_n", F.lit(0.0)))
    assert not passes(qc.score_identity(no_access, market))


def test_p90_scale_breaks_the_identity(spark, sf, market):
    from sitehex.operators.atscale import exact_quantiles

    p90 = exact_quantiles(market, ["city"], "pop", {"p": 0.9}, 3)
    twin = market.join(p90, "city").withColumn("pop_p95", F.col("p"))
    other = scoring.score(
        twin.select("city", "cell", "pop", "sup", "cap_area", "addr_cnt", "acc_pop"),
        twin.groupBy("city").agg(*[F.max(c).alias(c) for c in ("pop_p95", "sup_p95", "acc_p95", "cap_p95", "addr_p95")]),
    )
    assert not passes(qc.score_identity(market, other))


def test_load_checks(spark, sf):
    b, cap = W.stored(spark, sf, "buildings"), W.stored(spark, sf, "cell_capacity")
    assert passes(qc.rollup_matches_raw(b, cap))
    assert not passes(qc.rollup_matches_raw(b, cap.unionAll(cap.where("city = 'berlin'"))))
    people = W.stored(spark, sf, "population")
    assert passes(qc.same_row_count(people, people, "country"))
    one = people.where("country = 'DE'").limit(1)
    assert not passes(qc.same_row_count(people, people.exceptAll(one), "country"))
    assert passes(qc.row_floor(people, "country", 1, ["DE", "NL", "RS"], "population"))
    assert not passes(qc.row_floor(people, "country", 1, ["DE", "FR"], "population"))


def test_renamed_district_fails(spark, sf):
    d = W.stored(spark, sf, "districts")
    r = d.where("locality <> ''").orderBy("h3_8").first()
    truth = [(f"{r.h3_8:x}", r.area, r.locality)]
    assert passes(qc.ground_truth_names(d, truth))
    assert not passes(qc.ground_truth_names(d.withColumn("locality", F.upper("locality")).withColumn("locality", F.concat("locality", F.lit("!"))), truth))
    assert not passes(qc.ground_truth_names(d))  # production cells are not in the test inputs


def test_momentum_ranges(spark):
    good = [("berlin", "cafe", 10.8), ("berlin", "bakery", -5.2), ("berlin", "ev_charging_station", 205.9)]
    schema = "city string, category string, pct_change double"
    assert passes(qc.momentum_in_range(spark.createDataFrame(good, schema)))
    assert not passes(qc.momentum_in_range(spark.createDataFrame(good[:2], schema)))
    assert not passes(qc.momentum_in_range(spark.createDataFrame([good[0], ("berlin", "bakery", -12.0), good[2]], schema)))


def test_affinity_answers(spark, sf):
    places = W.stored(spark, sf, "places")
    assert passes(qc.affinity_answers(places))
    assert not passes(qc.affinity_answers(places, hit="gas_station"))


def test_same_rows(spark, sf):
    p = S.population(spark, sf)
    assert passes(qc.same_rows(p, S.population(spark, sf)))
    assert not passes(qc.same_rows(p, p.limit(5)))
