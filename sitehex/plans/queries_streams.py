"""Queries that run a stream over the given tables to completion and read its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitehex.operators import saved as sv
from sitehex.operators.atscale import new_folder
from sitehex.plans import queries_inputs  # noqa: F401  (its oracle is part of one below)
from sitehex.plans import refresh as RF
from sitehex.plans import surrogates as S
from sitehex.plans import warehouse as W
from sitehex.plans.registry import ORACLES, query
from sitehex.sources import versions
from sitehex.sources.publish import CheckFailed
from sitehex.streaming import rollups, updates


def stream_table(spark, sf: str, table: str):
    """One input table as a file stream."""
    schema = S.read(spark, sf, table).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{table}.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(sf)
    )


BATCHES = 3


def stream_files(spark, root: str, schema, batches: int = BATCHES):
    """The files of a folder as a stream of so many batches, however many files there are."""
    files = len(spark.read.parquet(root).inputFiles())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(root)


def deal(df, root: str, at_least: int, *by: str) -> None:
    """Rows by hash into as many files as the session shuffles into, so that a task's share does not grow with the table."""
    files = max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(files, *by).write.parquet(root)


def stream_folder(spark, sf: str, name: str):
    """A table as a file stream of several batches.

    The tasks that make the rows write them, so a file holds what one task scans. Only rows that fill fewer files than there
    are batches are dealt over as many.
    """
    root = new_folder(spark, "incoming")
    W.rows_of(spark, sf, name).write.parquet(root)
    written = spark.read.parquet(root)
    if len(written.inputFiles()) < BATCHES:
        root = new_folder(spark, "incoming")
        written.repartition(BATCHES).write.parquet(root)
    return stream_files(spark, root, written.schema)


@query("stream_capacity_rollup", "select city, h3_8, floor_area_m2, buildings from cell_capacity")
def stream_capacity_rollup(spark, sf):
    out, ck = new_folder(spark, "rollup"), new_folder(spark, "progress")
    rollups.maintain_capacity(stream_folder(spark, sf, "buildings"), out, ck).awaitTermination()
    return rollups.read_capacity(spark, out)


@query("stream_capacity_replay", "select city, h3_8, floor_area_m2, buildings from cell_capacity")
def stream_capacity_replay(spark, sf):
    """Replaying a batch leaves the rollup as it was, and so does a fold that a later batch follows."""
    from sitehex.sources.demand import merge_capacity

    out, ck, folded = new_folder(spark, "rollup"), new_folder(spark, "progress"), new_folder(spark, "rollup")
    rollups.maintain_capacity(stream_folder(spark, sf, "buildings"), out, ck).awaitTermination()
    again = spark.read.parquet(out).where(F.col("batch_id") == 0).drop("batch_id")
    replayed = again.withColumn("batch_id", F.lit(0).cast("bigint"))
    copy = new_folder(spark, "replay")
    replayed.write.parquet(copy)
    rollups.part_writer(lambda df: df.drop("batch_id"), out)(spark.read.parquet(copy), 0)
    last = spark.read.parquet(out).agg(F.max("batch_id")).first()[0]
    late = new_folder(spark, "late")
    spark.read.parquet(out).where(F.col("batch_id") == last).drop("batch_id").write.parquet(late)
    early = new_folder(spark, "early")
    spark.read.parquet(out).where(F.col("batch_id") < last).write.partitionBy("batch_id").parquet(early)
    rollups.compact(spark, early, folded, merge_capacity)
    rollups.part_writer(lambda df: df, early)(spark.read.parquet(late), last)
    return rollups.read_capacity(spark, early, folded)


@query("stream_momentum_rollup", "select city, category, first_count, last_count, first_month, last_month from momentum")
def stream_momentum_rollup(spark, sf):
    out, ck = new_folder(spark, "rollup"), new_folder(spark, "progress")
    rollups.maintain_momentum(stream_folder(spark, sf, "poi_history"), out, ck).awaitTermination()
    return rollups.read_momentum(spark, out)


@query("stream_saved_versions",
       "select user_id, city, business_type, id, label, h3_8, score, status from saved_latest")
def stream_saved_versions(spark, sf):
    out, ck = new_folder(spark, "saved"), new_folder(spark, "progress")
    updates.append_versions(S.saved_events(stream_table(spark, sf, "events")), out, ck).awaitTermination()
    return sv.latest_versions(spark.read.parquet(out)).select(
        "user_id", "city", "business_type", "id", "label", "h3_8", "score", "status"
    )


_WRITES = (
    "(select user_id%50 as session, event_type as layer, event_id as seq, md5(cast(event_id as varchar)) as rev, 'top '||(event_id%7) as label, "
    "event_id%7 as row_count, case when value>50 then 'handle' else 'inline' end as route from events)"
)


def _writes(events):
    return events.select(
        (F.col("user_id") % 50).alias("session"),
        F.col("event_type").alias("layer"),
        F.col("event_id").alias("seq"),
        F.md5(F.col("event_id").cast("string")).alias("rev"),
        F.concat(F.lit("top "), (F.col("event_id") % 7).cast("string")).alias("label"),
        (F.col("event_id") % 7).alias("row_count"),
        F.when(F.col("value") > 50, "handle").otherwise("inline").alias("route"),
    )


@query("stream_layer_updates",
       f"select session, layer, rev, label, row_count, route from {_WRITES} qualify row_number() over (partition by session, layer order by seq desc)=1")
def stream_layer_updates(spark, sf):
    """The same layer id replaces its content, over several batches in which older writes follow newer ones."""
    inbox, out, ck = new_folder(spark, "incoming"), new_folder(spark, "layers"), new_folder(spark, "progress")
    writes = _writes(S.read(spark, sf, "events"))
    deal(writes, inbox, BATCHES, "seq")
    updates.maintain_layers(stream_files(spark, inbox, writes.schema), out, ck).awaitTermination()
    return updates.current_layers(spark, out).drop("writes")


@query("layer_updates",
       f"select session, layer, arg_max(rev, seq) as rev, arg_max(label, seq) as label, arg_max(row_count, seq) as row_count, arg_max(route, seq) as route, count(*) as writes from {_WRITES} group by 1,2")
def layer_updates(spark, sf):
    return updates.latest_layer_parts(_writes(S.read(spark, sf, "events")))


@query("stream_commands_once",
       "select event_type as action, count(*) as applied from events group by 1")
def stream_commands_once(spark, sf):
    """Every command is delivered twice and applied once, by two streams that do not know of each other.

    The first stream gets the commands of some actions; the second one, with a progress folder of its own, gets all of them,
    those again that were applied before.
    """
    out, inbox, again = new_folder(spark, "commands"), new_folder(spark, "incoming"), new_folder(spark, "incoming")
    events = S.read(spark, sf, "events").select(
        F.col("event_id").alias("command_id"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("ts")
    )
    twice = events.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    for sent, folder in ((twice.where(F.col("action") < "m"), inbox), (twice, again)):
        deal(sent, folder, 4, "command_id", "delivery")
        stream = stream_files(spark, folder, twice.schema, 2)
        updates.apply_commands_once(stream, out, new_folder(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).groupBy("action").agg(F.count("*").alias("applied"))


@query("refresh_chain",
       "select 'places' as table_name, city as part, count(*) as rows from places group by city union all "
       "select 'population', country, count(*) from population group by country union all "
       "select 'districts', city, count(*) from districts group by city union all "
       "select 'buildings', city, count(*) from buildings group by city union all "
       "select 'addr_density', city, count(*) from addr_density group by city union all "
       "select 'cell_capacity', city, count(*) from cell_capacity group by city")
def refresh_chain(spark, sf):
    """The scheduled reload: population before districts, each table checked before it shows."""
    root = new_folder(spark, "warehouse")
    raw = RF.RawInputs(
        places=S.raw_places(spark, sf), population=S.raw_population(spark, sf), divisions=S.raw_divisions(spark, sf),
        addresses=S.raw_addresses(spark, sf), segments=S.raw_segments(spark, sf),
    )
    RF.refresh(spark, raw, root, floors=RF.NO_FLOORS, buildings=W.rows_of(spark, sf, "buildings"))
    parts = [
        versions.open_table(spark, root, t).groupBy(F.col(by).alias("part")).agg(F.count("*").alias("rows")).select(
            F.lit(t).alias("table_name"), "part", "rows"
        )
        for t, by in (
            ("places", "city"), ("population", "country"), ("districts", "city"), ("buildings", "city"),
            ("addr_density", "city"), ("cell_capacity", "city"),
        )
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


_LOBED = "(((oq*7+orr*3)%40)+40)%40=0"


@query("refresh_reach",
       f"select 'isochrones' as table_name, o.city as part, count(*) as rows from origins o, (values (5),(10),(15)) m(minutes) where not {_LOBED} group by o.city union all "
       f"select 'isochrone_cells', city, count(*) from reach where not {_LOBED} group by city union all "
       f"select 'isochrone_edges', city, count(*) from reach where minutes=15 and not (rq=oq and rr=orr) group by city")
def refresh_reach(spark, sf):
    """Contours, derived cells and street edges through their checks.

    The second lobes of the test contours lie beyond the walking ceiling, which the checks refuse, so
    this load takes the origins without one.
    """
    root = new_folder(spark, "warehouse")
    contours = S.raw_contours(spark, sf).where(~S.two_lobes())
    people = S.raw_population(spark, sf)
    raw = RF.RawInputs(population=people, contours=contours, edges=S.raw_edges(spark, sf))
    # The test contours start from about one candidate in eight.
    RF.refresh(spark, raw, root, floors=RF.NO_FLOORS, max_skipped=0.9)
    parts = [
        versions.open_table(spark, root, t).groupBy(F.col("city").alias("part")).agg(F.count("*").alias("rows")).select(
            F.lit(t).alias("table_name"), "part", "rows"
        )
        for t in ("isochrones", "isochrone_cells", "isochrone_edges")
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("refresh_reach_refused",
       f"select 'beyond the ceiling' as what, city as part, count(*)*21 as rows from origins where {_LOBED} group by city union all "
       "select 'published', t, 0 from (values ('isochrones'), ('isochrone_cells')) x(t)")
def refresh_reach_refused(spark, sf):
    """All origins at once, those with two lobes too: the seven cells of each second lobe fail the load, nothing shows."""
    root = new_folder(spark, "warehouse")
    failures = []
    try:
        RF.refresh(spark, RF.RawInputs(contours=S.raw_contours(spark, sf)), root)
    except CheckFailed as refused:
        failures = refused.failures
    rows = [("beyond the ceiling", f.scope, int(f.value)) for f in failures if f.check == "no reach beyond the hard ceiling"]
    rows += [("published", t, int(versions.is_published(spark, root, t))) for t in ("isochrones", "isochrone_cells")]
    return spark.createDataFrame(rows, "what string, part string, rows bigint")


#: Below the smallest test input, far above nothing.
_FLOORS = {**RF.NO_FLOORS, "buildings": dict.fromkeys(("berlin", "amsterdam", "belgrade"), 1500)}


@query("refresh_raw",
       f"select 'buildings' as table_name, city as part, cast(sum(buildings) as bigint) as rows from ({ORACLES['ingest_buildings']}) b group by city union all "
       f"select 'cell_capacity', city, count(*) from ({ORACLES['ingest_buildings']}) b group by city union all "
       "select 'poi_history', city, count(*) from poi_history group by city union all "
       "select 'category_momentum', city, count(*) from momentum group by city union all "
       f"select 'refused', city, cast(sum(buildings) as bigint) from ({ORACLES['ingest_buildings']}) b group by city")
def refresh_raw(spark, sf):
    """Raw footprints and history through the reload; a second load is refused by floors one row above what there is."""
    root = new_folder(spark, "warehouse")
    raw = RF.RawInputs(buildings=S.raw_buildings(spark, sf), history=S.raw_history(spark, sf))
    RF.refresh(spark, raw, root, floors=_FLOORS)
    loaded = {r.city: r["count"] for r in versions.open_table(spark, root, "buildings").groupBy("city").count().collect()}
    above = {**_FLOORS, "buildings": {city: n + 1 for city, n in loaded.items()}}
    refused = []
    try:
        RF.refresh(spark, RF.RawInputs(buildings=S.raw_buildings(spark, sf)), root, floors=above)
    except CheckFailed as e:
        refused = [("refused", f.scope, int(f.value)) for f in e.failures]
    out = spark.createDataFrame(refused, "table_name string, part string, rows bigint")
    for t in ("buildings", "cell_capacity", "poi_history", "category_momentum"):
        counted = versions.open_table(spark, root, t).groupBy(F.col("city").alias("part")).agg(F.count("*").alias("rows"))
        out = out.unionAll(counted.select(F.lit(t).alias("table_name"), "part", "rows"))
    return out
