"""What one task or one query takes must not grow faster than its input."""

import os
import re

import pytest
from pyspark.sql import functions as F

from sitehex.operators.atscale import new_folder
from sitehex.plans import queries_streams as QS
from sitehex.plans import registry
from sitehex.plans import warehouse as W
from sitehex.sources import versions
from sitehex.sources.layout import LAYOUTS, laid_out, writer

registry.load()


@pytest.fixture(scope="module")
def parted(spark, sf, tmp_path_factory):
    """The test tables in a folder of their own, line items in seven files."""
    root = tmp_path_factory.mktemp("parted")
    for name in os.listdir(sf):
        if name != "lineitem.parquet":
            os.symlink(f"{sf}/{name}", root / name)
    spark.read.parquet(f"{sf}/lineitem.parquet").repartition(7).write.parquet(f"{root}/lineitem.parquet")
    return str(root)


@pytest.fixture
def split(spark):
    """Every file is a task of its own, as large files are."""
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    yield
    spark.conf.set("spark.sql.files.openCostInBytes", was)


def new_folders(monkeypatch):
    made = []
    real = QS.new_folder
    monkeypatch.setattr(QS, "new_folder", lambda spark, purpose: made.append(real(spark, purpose)) or made[-1])
    return made


def batches(spark, folder):
    return {r[0] for r in spark.read.parquet(folder).select("batch_id").distinct().collect()}


def streamed(spark, parted, monkeypatch, query):
    """Files of the streamed table and batches of its rollup, after a comparison with the rollup in one go."""
    made = new_folders(monkeypatch)
    got = registry.QUERIES[query](spark, parted)
    want = W.rows_of(spark, parted, "buildings").transform(QS.rollups.capacity_rollup)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    incoming = [f for f in made if "/incoming-" in f][-1]
    rollup = [f for f in made if "/rollup-" in f][0]
    return len(spark.read.parquet(incoming).inputFiles()), batches(spark, rollup)


def test_replayed_footprints_fill_as_many_files_as_tasks_made_them(spark, parted, split, monkeypatch):
    files, ids = streamed(spark, parted, monkeypatch, "stream_capacity_replay")
    assert files == 7 and ids == {0, 1, 2}


def test_rows_of_one_task_still_come_in_several_batches(spark, sf, monkeypatch):
    files, ids = streamed(spark, sf, monkeypatch, "stream_capacity_replay")
    assert files == 3 and ids == {0, 1, 2}


def test_rolled_up_footprints_fill_as_many_files_as_tasks_made_them(spark, parted, split, monkeypatch):
    files, ids = streamed(spark, parted, monkeypatch, "stream_capacity_rollup")
    assert files == 7 and ids == {0, 1, 2}


@pytest.mark.parametrize("query", ["stream_layer_updates", "stream_commands_once"])
def test_events_are_dealt_over_as_many_files_as_the_session_shuffles_into(spark, sf, monkeypatch, query):
    made = new_folders(monkeypatch)
    registry.QUERIES[query](spark, sf).collect()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for inbox in (f for f in made if "/incoming-" in f):
        assert len(spark.read.parquet(inbox).inputFiles()) == max(width, 4)


@pytest.mark.parametrize("query", [
    "check_access_includes_home",
    "check_display_rounding",
    "catchment_sub_web",
    "save_ranked_pick",
    "check_score_identity",
    "capacity_ramp",
])
def test_footprints_are_not_stored_for_their_rollup(spark, parted, query):
    assert registry.QUERIES[query](spark, parted).count()
    assert {"buildings", "cell_capacity"} & {p.rsplit("/", 1)[1] for p in W._OPENED if p.startswith(W._path(spark, parted, ""))} == {"cell_capacity"}
    got = W.stored(spark, parted, "cell_capacity")
    want = W.rows_of(spark, parted, "buildings").groupBy("city", "h3_8").agg(F.count("*").alias("n"))
    both = got.join(want, ["city", "h3_8"], "full")
    assert both.where(~F.equal_null("buildings", "n")).count() == 0


def test_raw_footprints_are_ingested_once_for_each_load_and_split_only_if_they_pass(spark, sf, monkeypatch):
    split, real = [], versions.laid_out

    def laid_out(df, layout, *args):
        if "area_m2" in df.columns:
            split.append(df.inputFiles())
        return real(df, layout, *args)

    monkeypatch.setattr(versions, "laid_out", laid_out)
    got = {(r.table_name, r.part): r.rows for r in registry.QUERIES["refresh_raw"](spark, sf).collect()}
    assert len(split) == 1 and all("/ingested-" in file for file in split[0])
    refused = {part: n for (table, part), n in got.items() if table == "refused"}
    assert refused and refused == {part: n for (table, part), n in got.items() if table == "buildings"}


def test_chain_does_not_store_footprints_before_it_loads_them(spark, parted):
    assert registry.QUERIES["refresh_chain"](spark, parted).where("table_name = 'buildings'").count() == 3
    assert W._path(spark, parted, "buildings") not in W._OPENED


@pytest.mark.parametrize("partitions", [None, 5])
def test_sorts_of_a_layout_compare_columns_and_nothing_computed(spark, parted, partitions):
    layout = LAYOUTS["places"]
    places = W.rows_of(spark, parted, "places")
    ranges = laid_out(places, layout, partitions)
    plan = ranges._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line for line in plan.splitlines() if re.search(r"\bSort \[", line)]
    assert len(sorts) == 1 and not re.search(r"\b(LN|LOG|TAN|FLOOR|shiftleft|shiftright)\(", sorts[0], re.I), sorts
    assert ranges.columns == places.columns
    # The order in every task is still that of the key, and the writer finds it so.
    keys = [F.col("city"), *layout.keys()]
    here = ranges.select(F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), F.struct(*keys).alias("key"))
    rows = here.orderBy("at").collect()
    assert len(rows) == places.count() > 0
    assert all(a.key <= b.key for a, b in zip(rows, rows[1:]) if a.task == b.task)
    root = new_folder(spark, "places")
    writer(ranges, layout).parquet(root)
    written = spark.read.parquet(root).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.struct(*keys).alias("key")
    )
    rows = written.orderBy("at").collect()
    assert len(rows) == places.count()
    assert all(a.key <= b.key for a, b in zip(rows, rows[1:]) if a.file == b.file)


def test_footprints_are_not_stored_to_be_counted(spark, parted):
    checks = registry.QUERIES["check_rollup_matches_raw"](spark, parted).collect()
    assert len(checks) == 3 and all(c.passed for c in checks)
    assert W._path(spark, parted, "buildings") not in W._OPENED
