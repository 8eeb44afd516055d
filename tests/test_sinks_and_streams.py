import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sitehex.operators import quality as qc
from sitehex.operators.atscale import new_folder
from sitehex.plans import refresh as RF
from sitehex.plans import surrogates as S
from sitehex.plans import warehouse as W
from sitehex.sources import layer_store, publish, saved, versions
from sitehex.sources.demand import capacity_rollup
from sitehex.sources.history import ingest_history
from sitehex.sources.reach import ingest_contours, ingest_edges
from sitehex.streaming import rollups, updates
from sitehex.tables import Tables


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_replace_partition_leaves_others_alone(spark):
    root = new_folder(spark, "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "city string, n int")
    assert publish.replace_partition(df, root, "city", ["a", "b"]) == 2
    newer = spark.createDataFrame([("a", 9), ("b", 9)], "city string, n int")
    assert publish.replace_partition(newer, root, "city", ["a"]) == 1
    assert rows(spark.read.parquet(root).select("city", "n")) == [("a", 9), ("b", 2)]
    assert publish.replace_partition(newer.where("false"), root, "city", ["b"]) == 0
    assert rows(spark.read.parquet(root).select("city", "n")) == [("a", 9)]


def test_rejected_load_publishes_nothing(spark):
    root = new_folder(spark, "t")
    df = spark.createDataFrame([("a", 1)], "city string, n int")
    check = lambda staged: qc.row_floor(staged, "city", 2, ["a"], "t")
    with pytest.raises(publish.CheckFailed):
        publish.load_verified(df, root, "city", ["a"], [check])
    assert not publish.path_exists(spark, root)


def test_canary_round_trip(spark):
    root = new_folder(spark, "saved")
    canary = spark.createDataFrame(
        [("berlin", "deploy-check", "canary", 13.4, 52.5, "881f1d4881fffff", None)],
        "city string, business_type string, label string, lon double, lat double, h3_8 string, score double",
    ).withColumn("user_id", F.lit("u1"))
    saved.append_saved_site(canary, root)
    got = spark.read.parquet(root).where("label = 'canary'").first()
    assert got.score is None and got.status == "candidate" and got.id and got.created_at
    publish.delete_rows(spark, root, "city", ["berlin"], F.col("label") == "canary")
    assert not publish.path_exists(spark, f"{root}/city=berlin") or spark.read.parquet(root).count() == 0


def test_layer_ttl(spark):
    root = new_folder(spark, "layers")
    now = dt.datetime(2026, 3, 1, 10, 59, tzinfo=dt.timezone.utc)
    f = spark.createDataFrame([("{}",)] * 3, "feature string")
    h = layer_store.write_layer(f, root, now)
    later = layer_store.write_layer(f, root, now + dt.timedelta(minutes=30))
    at = now + dt.timedelta(minutes=61)
    assert layer_store.read_layer(spark, root, h, at).count() == 0
    assert layer_store.read_layer(spark, root, later, at).count() == 3
    assert layer_store.expire_layers(spark, root, now + dt.timedelta(hours=2)) == ["created_hour=2026030110"]
    assert layer_store.read_layer(spark, root, later, at).count() == 3


def test_route_by_measured_bytes(spark):
    df = spark.createDataFrame([("a", 1, "é" * 10), ("b", 1, "x"), ("b", 2, "y")], "layer string, k int, feature string")
    got = {r.layer: (r.bytes, r.route) for r in layer_store.route_by_bytes(df, 50).collect()}
    assert got == {"a": (62, "handle"), "b": (45, "inline")}
    docs = layer_store.feature_collections(df, "k", 50).collect()
    assert [(d.layer, d.body, len(d.body)) for d in docs] == [("b", '{"type":"FeatureCollection","features":[x,y]}', 45)]


def test_documents_with_odd_features(spark):
    contours = {
        "features": [
            {"properties": {"contour": 5}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[1, 2], [3, 4], [1, 2]]], [[[5, 6], [7, 8], [5, 6]]]]}},
            {"properties": {"contour": 5}, "geometry": {"type": "Polygon", "coordinates": []}},
            {"properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0]]]}},
            {"properties": {"contour": 10}},
        ]
    }
    edges = {
        "features": [
            {"properties": {"duration": 70000.4, "distance": 2.5}, "geometry": {"type": "LineString", "coordinates": [[1.1234567, 2], [3, 4]]}},
            {"properties": {}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}},
            {"properties": {"duration": 1}, "geometry": {"type": "LineString", "coordinates": [[1, 2]]}},
            {"properties": {"duration": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        ]
    }
    schema = "origin_h3_9 bigint, city string, body string"
    got = ingest_contours(spark.createDataFrame([(1, "berlin", json.dumps(contours))], schema)).collect()
    assert sorted((r.minutes, json.loads(r.geojson)) for r in got) == [(5, [[[1, 2], [3, 4], [1, 2]]]), (5, [[[5, 6], [7, 8], [5, 6]]])]
    got = ingest_edges(spark.createDataFrame([(1, "berlin", json.dumps(edges))], schema)).collect()
    assert sorted((r.duration_s, r.dist_m, json.loads(r.geom)) for r in got) == [(0, 0, [[1, 2], [3, 4]]), (65535, 2, [[1.12346, 2], [3, 4]])]


def test_failed_fetch_leaves_no_rows(spark):
    docs = [
        ("berlin", "amenity=cafe", '{"result":[{"timestamp":"2022-01-01T00:00:00Z","value":3.0}]}'),
        ("berlin", "shop=bakery", "bad gateway"),
    ]
    got = rows(ingest_history(spark.createDataFrame(docs, "city string, tag string, body string")).select("category", "count"))
    assert got == [("cafe", 3), ("coffee_shop", 3)]


def test_stream_rollup_equals_batch_and_survives_replay(spark, sf):
    buildings = W.stored(spark, sf, "buildings")
    src, out, ck = (new_folder(spark, n) for n in ("src", "out", "ck"))
    buildings.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(buildings.schema).option("maxFilesPerTrigger", 1).parquet(src)
    rollups.maintain_capacity(stream, out, ck).awaitTermination()
    want = rows(capacity_rollup(buildings).select("city", "h3_8", "floor_area_m2", "buildings"))
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3
    assert rows(rollups.read_capacity(spark, out).select("city", "h3_8", "floor_area_m2", "buildings")) == want
    # A batch delivered again overwrites its own part.
    writer = rollups.part_writer(lambda df: df.drop("batch_id"), out)
    again = new_folder(spark, "again")
    spark.read.parquet(out).where("batch_id = 1").write.parquet(again)
    writer(spark.read.parquet(again), 1)
    assert rows(rollups.read_capacity(spark, out).select("city", "h3_8", "floor_area_m2", "buildings")) == want


def test_commands_apply_once_over_batches(spark, sf):
    events = S.read(spark, sf, "events").select(F.col("event_id").alias("command_id"), F.col("ts").cast("timestamp").alias("ts"))
    src, out, ck = (new_folder(spark, n) for n in ("src", "out", "ck"))
    events.repartition(3, "command_id").write.parquet(src)
    events.repartition(4, "ts").write.mode("append").parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    updates.apply_commands_once(stream, out, ck).awaitTermination()
    applied = spark.read.parquet(out)
    assert applied.select("batch_id").distinct().count() > 1
    assert rows(applied.select("command_id")) == rows(events.select("command_id"))
    assert updates.once_per_command(events.unionAll(events)).count() == events.count()


def test_commands_apply_once_over_streams_and_crashes(spark):
    """Streams with progress folders of their own share the ledger; replays and broken parts change nothing."""
    out, inbox = new_folder(spark, "out"), new_folder(spark, "inbox")
    schema = "command_id bigint, what string"

    def run(ids, checkpoint=None, what="x"):
        folder = new_folder(spark, "src")
        spark.createDataFrame([(i, what) for i in ids], schema).repartition(2).write.parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        updates.apply_commands_once(stream, out, checkpoint or new_folder(spark, "ck")).awaitTermination()

    def applied():
        return sorted(r.command_id for r in spark.read.parquet(out).collect())

    run(range(100))
    run(range(50, 150), what="again")
    assert applied() == list(range(150))
    assert spark.read.parquet(out).where("what = 'again'").count() == 50
    run([])
    run([7, 7, 8, 150])
    assert applied() == list(range(151))
    # A part whose sender died after writing it: nothing is applied until the next settlement, then once.
    batch = spark.createDataFrame([(150, "late"), (151, "late")], schema)
    updates.deliver_commands(batch, out, "lost", 0)
    updates.deliver_commands(batch, out, "lost", 0)
    assert applied() == list(range(151))
    updates.settle_commands(spark, out, batch.schema).awaitTermination()
    assert applied() == list(range(152))
    # A lost progress folder: the same source is read from its start again.
    run(range(100))
    assert applied() == list(range(152)) and not publish.path_exists(spark, inbox)


def test_late_layer_writes_replace_nothing(spark):
    src, out, ck = (new_folder(spark, n) for n in ("src", "out", "ck"))
    schema = "session bigint, layer string, seq bigint, rev string, label string, row_count bigint, route string"

    def send(*writes):
        data = [(1, layer, seq, f"r{seq}", "top", seq, "inline") for layer, seq in writes]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        query = updates.maintain_layers(stream, out, ck)
        query.awaitTermination()
        return query

    send(("a", 5), ("b", 1))
    send(("a", 3), ("c", 2))  # late for a
    last = send(("b", 4), ("b", 2))
    got = {r.layer: (r.rev, r.writes) for r in updates.current_layers(spark, out).collect()}
    assert got == {"a": ("r5", 2), "b": ("r4", 3), "c": ("r2", 1)}
    assert last.lastProgress.stateOperators[0].numRowsTotal == 3  # one row for each layer


def test_ledger_looks_ids_up_instead_of_reading_them(spark):
    """What a batch reads does not grow with what was applied before it."""
    out = new_folder(spark, "out")
    schema = "command_id bigint"
    sizes = []
    for start in (0, 20_000, 40_000):
        updates.deliver_commands(spark.range(start, start + 20_000).withColumnRenamed("id", "command_id"), out, "s", start)
        query = updates.settle_commands(spark, out, spark.createDataFrame([], schema).schema)
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p.numInputRows]
        sizes.append(sum(p.numInputRows for p in progress))
        state = progress[-1].stateOperators[0]
        assert state.numRowsTotal == start + 20_000
        assert any("rocksdb" in name for name in state.customMetrics)
    assert sizes == [20_000] * 3


def test_fold_and_later_batches(spark):
    from sitehex.sources.demand import merge_capacity

    part = spark.createDataFrame([("berlin", 1, 10.0, 1)], "city string, h3_8 bigint, floor_area_m2 double, buildings bigint")
    out, folded = new_folder(spark, "out"), new_folder(spark, "folded")
    writer = rollups.part_writer(lambda df: df, out)
    writer(part, 0)
    writer(part, 1)
    before = rows(merge_capacity(spark.read.parquet(out)))
    assert rollups.compact(spark, out, folded, merge_capacity) == 1
    assert rows(rollups.read_capacity(spark, out, folded)) == before
    writer(part, 2)
    assert rows(rollups.read_capacity(spark, out, folded)) == rows(merge_capacity(spark.read.parquet(out)))


def test_every_layer_is_emitted(spark):
    df = spark.createDataFrame([("a", 1, "é" * 10), ("b", 2, "y"), ("b", 1, "x")], "layer string, k int, feature string")
    root = new_folder(spark, "layers")
    got = {r.layer: r for r in layer_store.emit_layers(df, "k", root, 50).collect()}
    assert got["b"].body == '{"type":"FeatureCollection","features":[x,y]}' and got["b"].handle is None
    assert got["a"].body is None and got["a"].route == "handle"
    assert [r.feature for r in layer_store.read_layer(spark, root, got["a"].handle).collect()] == ["é" * 10]


def test_stored_layers_keep_their_order(spark):
    root, text = new_folder(spark, "layers"), new_folder(spark, "text")
    df = spark.range(3000).select(
        F.concat(F.lit("l"), F.col("id") % 3).alias("layer"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("k"), F.concat(F.lit("f"), "id").alias("feature")
    ).repartition(5)
    twice = [layer_store.emit_layers(df, "k", root, 100).collect() for _ in range(2)]
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.feature)):
        want.setdefault(r.layer, []).append(r.feature)
    for emitted in twice:
        for r in emitted:
            assert [f.feature for f in layer_store.read_layer(spark, root, r.handle).collect()] == want[r.layer]
    first, second = ({r.layer: r for r in emitted} for emitted in twice)
    for layer in want:
        assert first[layer].rev != second[layer].rev and first[layer].content == second[layer].content
    # No folder for each handle; rows of other handles are not read back.
    assert {name.split("=")[0] for name in publish.list_folders(spark, root)} == {"created_hour"}
    one = df.where("layer = 'l0'")
    layer_store.write_lines(one, "k", text)
    lines = spark.read.text(text).select("value", "_metadata.file_name", F.monotonically_increasing_id().alias("n")).collect()
    assert [r.value for r in sorted(lines, key=lambda r: (r.file_name, r.n))] == want["l0"]
    given = spark.createDataFrame([("b",), ("a",), ("c",)], "feature string").coalesce(1)
    assert [r.feature for r in layer_store.read_layer(spark, root, layer_store.write_layer(given, root)).collect()] == ["b", "a", "c"]


def test_switch_shows_all_loads_or_none(spark):
    root = new_folder(spark, "warehouse")
    cells = "city string, h3_8 bigint, floor_area_m2 double, buildings bigint"

    def load(table, rows, keys=("a", "b"), checks=()):
        return versions.stage(spark.createDataFrame(rows, cells), root, table, keys, checks)

    def seen(table):
        return rows(versions.open_table(spark, root, table).select("city", "h3_8"))

    first = [load("buildings", [("a", 1, 1.0, 1), ("b", 2, 1.0, 1), ("c", 3, 1.0, 1)]), load("cell_capacity", [("a", 1, 1.0, 1)])]
    assert not versions.is_published(spark, root, "buildings") and first[0].rows == 2
    assert versions.switch(spark, root, first) == 1
    assert seen("buildings") == [("a", 1), ("b", 2)] and seen("cell_capacity") == [("a", 1)]
    # The second of two loads is refused: both tables stay as they are.
    held = versions.open_table(spark, root, "buildings")
    newer = load("buildings", [("a", 7, 1.0, 1)], ["a"])
    with pytest.raises(publish.CheckFailed):
        load("cell_capacity", [("a", 7, 1.0, 1)], ["a"], [lambda staged: qc.row_floor(staged, "city", 2, ["a"], "t")])
    assert seen("buildings") == [("a", 1), ("b", 2)] and seen("cell_capacity") == [("a", 1)]
    # A key is replaced, an emptied one is gone, the others stay; who reads already goes on with what it opened.
    emptied = load("buildings", [], ["b"])
    assert versions.switch(spark, root, [newer, emptied]) == 2
    assert seen("buildings") == [("a", 7)] and rows(held.select("city", "h3_8")) == [("a", 1), ("b", 2)]
    # A pointer that its writer did not finish is passed over.
    broken = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/published/000000003.json")
    broken.getFileSystem(spark._jsc.hadoopConfiguration()).create(broken).close()
    assert versions.pointer(spark, root)[0] == 2 and seen("buildings") == [("a", 7)]
    assert versions.switch(spark, root, [load("buildings", [("b", 8, 1.0, 1)], ["b"])]) == 4
    assert seen("buildings") == [("a", 7), ("b", 8)]
    assert versions.sweep(spark, root, 1) and seen("buildings") == [("a", 7), ("b", 8)] and seen("cell_capacity") == [("a", 1)]
    last = load("buildings", [], ["a", "b"])
    versions.switch(spark, root, [last])
    assert seen("buildings") == []


def test_refresh_writes_a_readable_warehouse(spark, sf):
    root = new_folder(spark, "warehouse")
    raw = RF.RawInputs(
        places=S.raw_places(spark, sf), population=S.raw_population(spark, sf), divisions=S.raw_divisions(spark, sf),
        buildings=S.raw_buildings(spark, sf), addresses=S.raw_addresses(spark, sf), segments=S.raw_segments(spark, sf),
        history=S.raw_history(spark, sf),
    )
    floors = {**RF.NO_FLOORS, "districts": 1}
    done = RF.refresh(spark, raw, root, floors=floors)
    assert set(done) == {"places", "population", "districts", "buildings", "cell_capacity", "addr_density", "road_density", "poi_history"}
    tables = Tables.read(spark, root)
    assert tables.places.count() == done["places"] and tables.districts.count() == done["districts"]
    assert tables.isochrones is None
    with pytest.raises(publish.CheckFailed):
        RF.refresh(spark, RF.RawInputs(places=S.raw_places(spark, sf)), root)
    assert Tables.read(spark, root).places.count() == done["places"]
