"""Plans that must hold at any size: pushdown, pruning, partial aggregates, early limits."""

import pytest
from pyspark.sql import functions as F

from sitehex.operators import ranking, scoring
from sitehex.operators.atscale import new_folder
from sitehex.plans import surrogates as S
from sitehex.plans import warehouse as W
from sitehex.sources.places import ingest_places, write_places


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def long_plan_text(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(scope="module")
def raw(spark, sf):
    root = new_folder(spark, "raw")
    S.raw_places(spark, sf).write.parquet(root)
    return spark.read.parquet(root)


def test_box_predicates_reach_the_scan(raw):
    plan = plan_of(ingest_places(raw))
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(bbox.xmin" in pushed and "LessThanOrEqual(bbox.ymin" in pushed


def test_unread_columns_are_pruned(raw):
    plan = plan_of(ingest_places(raw).groupBy("city").agg(F.count("*")))
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "names" not in schema and "bbox" in schema


def test_city_filter_prunes_partitions(spark, sf):
    plan = plan_of(scoring.in_cities(W.stored(spark, sf, "places"), scoring.CITIES[:1]))
    assert "PartitionFilters: [isnotnull(city" in plan or "city#" in plan.split("PartitionFilters:")[1][:120]


def test_ranking_limits_before_the_shuffle(spark, sf):
    plan = plan_of(ranking.rank_sites(W.surface(spark, sf, "bakery")))
    assert plan.count("WindowGroupLimit") == 2  # once per task, once after the exchange
    one = plan_of(ranking.rank_city(W.surface(spark, sf, "bakery"), "berlin"))
    assert "TakeOrderedAndProject" in one or "GlobalLimit" in one


def test_signals_meet_in_one_aggregate(spark, sf):
    plan = plan_of(scoring.joined(W.market(spark, sf), ["bakery"]))
    # Ring counts, reach counts and the final aggregate shuffle; the only join is reach x population.
    assert plan.count("Join") <= 2
    assert "Union" in plan


def test_reach_rows_shrink_before_any_exchange(spark, sf):
    t = W.market(spark, sf)
    plan = plan_of(scoring.accessibility(t.isochrone_cells, t.population))
    scan = plan[plan.index("minutes"):]
    assert "EqualTo(minutes,10)" in scan


def test_places_layout_is_clustered(spark, sf):
    root = new_folder(spark, "places")
    places = W.stored(spark, sf, "places")
    write_places(places, root, 4)
    back = spark.read.parquet(root)
    assert back.count() == places.count()
    assert set(back.columns) == set(places.columns)


def rows_read(df):
    """Rows of the row groups that the scan of a plan without exchanges did not skip."""
    executed = df._jdf.queryExecution()
    executed.toRdd().count()
    scan = executed.executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_a_box_reads_few_row_groups(spark, sf):
    from sitehex.operators.layers import competitors

    root = new_folder(spark, "places")
    grown = W.stored(spark, sf, "places").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40))))
    places = grown.withColumn("name", F.sha2(F.concat("name", "copy"), 256)).drop("copy")  # so that row groups fill up
    write_places(places, root, 6, row_group_bytes=1 << 16)
    back = spark.read.parquet(root)
    berlin = back.where("city = 'berlin'")
    lo, hi = berlin.agg(F.min("lon"), F.min("lat")).first(), berlin.agg(F.max("lon"), F.max("lat")).first()
    box = (lo[0], lo[0] + (hi[0] - lo[0]) / 5, lo[1], lo[1] + (hi[1] - lo[1]) / 5)
    categories = [r.category for r in back.select("category").distinct().collect()]
    inside = competitors(back, categories, scoring.CITIES[:1], box)
    assert 0 < inside.count() == competitors(places, categories, scoring.CITIES[:1], box).count()
    assert rows_read(inside) < berlin.count() / 2


def test_reverse_lookup_skips_row_groups(spark, sf):
    """Scattered ids, as real cell ids are next to each other on the map: minima and maxima leave nothing out."""
    from sitehex.operators.catchment import reverse_reach, reverse_reach_of
    from sitehex.sources.layout import LAYOUTS, laid_out, writer

    layout = LAYOUTS["isochrone_cells"]
    reach = W.stored(spark, sf, "isochrone_cells").withColumn("reachable_h3_9", F.xxhash64("reachable_h3_9"))
    ranges = laid_out(reach, layout, 24)
    with_filters, without = new_folder(spark, "reach"), new_folder(spark, "reach")
    for out, path in ((writer(ranges, layout), with_filters), (ranges.write.partitionBy("city"), without)):
        out.option("parquet.enable.dictionary", "false").parquet(path)
    back = spark.read.parquet(with_filters)
    berlin = back.where("city = 'berlin'")
    # Two of the cells that the fewest walks hold, in the middle of the range of ids.
    rare = berlin.groupBy("reachable_h3_9").agg(F.count("*").alias("n"), F.max((F.col("minutes") == 10).cast("int")).alias("ten"))
    cells = [r.reachable_h3_9 for r in rare.where("ten = 1").orderBy("n", F.abs("reachable_h3_9")).limit(2).collect()]
    found = reverse_reach_of(back, "berlin", cells)
    targets = spark.createDataFrame([("berlin", c) for c in cells], "city string, reachable_h3_9 bigint")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, reverse_reach(targets, reach).collect()))
    read = rows_read(reverse_reach_of(back, "berlin", cells))
    assert 0 < read < berlin.count() / 2
    assert rows_read(reverse_reach_of(spark.read.parquet(without), "berlin", cells)) > 1.5 * read
    # An id that no walk reaches opens no row group, and twelve of them do not turn into a range.
    assert rows_read(reverse_reach_of(back, "berlin", range(1, 13))) == 0


def test_known_origins_are_read_by_key(spark, sf):
    from sitehex.operators.catchment import at_origins

    edges = W.stored(spark, sf, "isochrone_edges")
    one = edges.first()
    plan = plan_of(at_origins(edges, one.city, [one.origin_h3_9]))
    assert f"EqualTo(origin_h3_9,{one.origin_h3_9})" in plan or f"In(origin_h3_9, [{one.origin_h3_9}])" in plan
    assert "city#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_large_tables_are_not_shuffled_for_a_few_picks(spark, sf):
    from sitehex.operators.catchment import catchment_edges

    picks = W.surface(spark, sf, "bakery").select("city", "cell").limit(6)
    plan = plan_of(catchment_edges(picks, W.stored(spark, sf, "isochrone_edges"), picks_bound=6))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
