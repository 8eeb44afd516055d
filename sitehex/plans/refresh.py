"""The scheduled reload of every table, in dependency order.

Each table is written once, as a version that nobody reads, checked there and only then shown; tables that belong
together (footprints and capacity, history and momentum, contours and reach cells) are shown by one switch. Population
comes before districts because districts name the populated cells. Run it from any scheduler.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sitehex.cities import CITIES, City
from sitehex.operators import quality as qc
from sitehex.operators.atscale import new_folder
from sitehex.operators.catchment import candidate_origins, derive_reach_cells
from sitehex.operators.districts import district_resolution
from sitehex.operators.trend import momentum_rollup
from sitehex.sources.demand import address_density, capacity_rollup, ingest_buildings, road_density
from sitehex.sources.divisions import ingest_divisions
from sitehex.sources.history import ingest_history
from sitehex.sources.places import ingest_places
from sitehex.sources.population import ingest_population
from sitehex.sources.publish import Check, CheckFailed, delete_path, failing
from sitehex.sources.reach import ingest_contours, ingest_edges
from sitehex.sources.versions import Load, discard, is_published, open_table, stage, staged_table, switch


@dataclass
class RawInputs:
    """Raw DataFrames; the ones left out are not reloaded."""

    places: DataFrame | None = None
    population: DataFrame | None = None
    divisions: DataFrame | None = None
    buildings: DataFrame | None = None
    addresses: DataFrame | None = None
    segments: DataFrame | None = None
    history: DataFrame | None = None
    contours: DataFrame | None = None
    edges: DataFrame | None = None


DEFAULT_FLOORS: dict[str, int | Mapping[str, int]] = {
    **qc.FLOORS, "buildings": qc.BUILDING_FLOORS, "addr_density": qc.ADDRESS_CELL_FLOORS, "road_density": qc.ROAD_CELL_FLOORS,
    "poi_history": 1,
}
NO_FLOORS: dict[str, int | Mapping[str, int]] = dict.fromkeys(DEFAULT_FLOORS, 1)


def refresh(
    spark: SparkSession,
    raw: RawInputs,
    root: str,
    cities: Sequence[City] = CITIES,
    floors: Mapping[str, int | Mapping[str, int]] = DEFAULT_FLOORS,
    ground_truth: Sequence[tuple[str, str, str]] | None = None,
    buildings: DataFrame | None = None,
    max_skipped: float = qc.MAX_SKIPPED,
) -> dict[str, int]:
    """Reload what ``raw`` holds below ``root`` and return rows written per table.

    ``buildings`` passes footprints that are already ingested instead of raw ones. ``ground_truth`` None stands for the known
    names of real cells if the floors are those of real data too, else for none. ``max_skipped`` is the share of candidate
    origins that a reach load may leave unmeasured.
    """
    names = [c.name for c in cities]
    countries = sorted({c.country for c in cities})
    if ground_truth is None:
        ground_truth = qc.DISTRICT_GROUND_TRUTH if floors is DEFAULT_FLOORS else ()
    done: dict[str, int] = {}

    def floor(table: str, by: str, keys):
        return lambda staged: qc.row_floor(staged, by, floors[table], keys, table)

    def show(*loads: Load) -> None:
        """Publish together what belongs together."""
        switch(spark, root, loads)
        done.update({load.table: load.rows for load in loads})

    def stage_city(df: DataFrame, table: str, *checks) -> Load:
        return stage(df, root, table, names, checks)

    people = None
    if raw.places is not None:
        show(stage_city(ingest_places(raw.places, cities), "places", floor("places", "city", names)))
    if raw.population is not None:
        read = ingest_population(raw.population)
        same = lambda staged: qc.same_row_count(read, staged, "country")
        load = stage(read, root, "population", countries, [floor("population", "country", countries), same])
        people = staged_table(spark, root, load)
        show(load)
    elif is_published(spark, root, "population"):
        people = open_table(spark, root, "population")
    if raw.divisions is not None:
        if people is None:
            raise ValueError("districts name populated cells: load the population first")
        checks = [floor("districts", "city", names)]
        if ground_truth:
            checks.append(lambda staged: qc.ground_truth_names(staged, ground_truth))
        show(stage_city(district_resolution(people, ingest_divisions(raw.divisions, cities), cities), "districts", *checks))
    if buildings is not None:
        show(*_stage_buildings(spark, buildings, root, names, floor("buildings", "city", names)))
    elif raw.buildings is not None:
        # Areas are costly and a range split reads its rows twice, so they are written as they come first. A load below its
        # floors is refused there, before it is split and sorted.
        read, ingested = ingest_buildings(raw.buildings, cities), new_folder(spark, "ingested")
        try:
            read.write.parquet(ingested)
            rows = spark.read.schema(read.schema).parquet(ingested)
            bad = failing([floor("buildings", "city", names)], rows)
            if bad:
                raise CheckFailed(bad)
            show(*_stage_buildings(spark, rows, root, names, floor("buildings", "city", names)))
        finally:
            delete_path(spark, ingested)
    for table, source, density in (
        ("addr_density", raw.addresses, address_density), ("road_density", raw.segments, road_density),
    ):
        if source is not None:
            show(stage_city(density(source, cities), table, floor(table, "city", names)))
    if raw.history is not None:
        months = stage_city(ingest_history(raw.history), "poi_history", floor("poi_history", "city", names))
        # Rebuilt as a whole: a category that vanished from the history must not keep old momentum.
        momentum = stage(momentum_rollup(staged_table(spark, root, months)), root, "category_momentum")
        show(months, momentum)
        del done[momentum.table]  # derived; only what was read is counted
    if raw.contours is not None:
        show(*_stage_reach(spark, raw.contours, root, names, cities, people, max_skipped))
    if raw.edges is not None:
        show(
            stage_city(
                ingest_edges(raw.edges), "isochrone_edges",
                lambda staged: qc.edges_inside_box(staged, cities),
                lambda staged: qc.web_touches_origin(staged, cities),
                lambda staged: qc.edge_distance_p999(staged, cities),
                lambda staged: qc.duration_gradient(staged, cities),
                lambda staged: qc.edge_origins_have_contours(staged, open_table(spark, root, "isochrones")),
            )
        )
    return done


def _stage_buildings(spark: SparkSession, buildings: DataFrame, root: str, names: Sequence[str], floor: Check) -> list[Load]:
    """Footprints and their rollup. Sums are not idempotent, so it is rebuilt from the table it must agree with."""
    footprints = stage(buildings, root, "buildings", names, [floor])
    stored = staged_table(spark, root, footprints)
    agrees = lambda staged: qc.rollup_matches_raw(stored, staged)
    return [footprints, stage(capacity_rollup(stored), root, "cell_capacity", names, [agrees])]


def _stage_reach(
    spark: SparkSession,
    contours: DataFrame,
    root: str,
    names: Sequence[str],
    cities: Sequence[City],
    people: DataFrame | None,
    max_skipped: float,
) -> list[Load]:
    """Contours and the cells derived from them, each written once; neither shows unless both pass.

    With the population at hand the load must also cover enough of the candidate origins and hold each measured cell in
    its own reach.
    """
    checks = [
        lambda staged: qc.reach_inside_box(staged, cities),
        qc.reach_grows,
        qc.reach_nested,
        qc.origin_in_own_reach,
        lambda staged: qc.reach_ceiling(staged, cities),
        lambda staged: qc.reach_p999(staged, cities),
        lambda staged: qc.as_result(qc.far_origins_disjoint(staged, cities), "far origins share no cell", "shared_cells"),
    ]
    if people is not None:
        checks += [
            lambda staged: qc.cells_reach_themselves(staged, people, cities),
            lambda staged: qc.skip_rate(staged, candidate_origins(people, cities), max_skipped),
        ]
    drawn = stage(ingest_contours(contours), root, "isochrones", names)
    try:
        return [drawn, stage(derive_reach_cells(staged_table(spark, root, drawn), cities), root, "isochrone_cells", names, checks)]
    except BaseException:
        discard(spark, root, drawn)
        raise
