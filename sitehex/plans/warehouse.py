"""Stored tables behind the read-side queries.

The read side works on loaded tables, never on raw files. Each table is written once per session
and input folder, below the cluster's shared folder, and then read back as Parquet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from sitehex.operators.atscale import new_folder
from sitehex.operators.districts import district_resolution
from sitehex.operators.scoring import scored
from sitehex.operators.trend import momentum_rollup
from sitehex.plans import surrogates as S
from sitehex.reference_data import resolve_categories
from sitehex.sources.demand import capacity_rollup
from sitehex.sources.layout import LAYOUTS, Layout, laid_out, writer
from sitehex.tables import Tables

Builder = Callable[[SparkSession, str], DataFrame]


def _from(name: str, then: Callable[..., DataFrame]) -> Builder:
    """A table derived from another stored table."""
    return lambda spark, sf_dir: then(stored(spark, sf_dir, name))


def _unstored(name: str, then: Callable[..., DataFrame]) -> Builder:
    """A rollup of a table that need not be stored for it."""
    return lambda spark, sf_dir: then(rows_of(spark, sf_dir, name))


def _reach(build: Callable[..., DataFrame]) -> Builder:
    return lambda spark, sf_dir: build(spark, sf_dir, stored(spark, sf_dir, "population"))


# How each stored table is made; ``sources.layout`` says how it lies on disk.
BUILDERS: dict[str, Builder] = {
    "places": S.places,
    "population": S.population,
    "buildings": S.buildings,
    "cell_capacity": _unstored("buildings", capacity_rollup),
    "addr_density": S.addr_density,
    "isochrone_cells": _reach(S.isochrone_cells),
    "isochrones": _reach(S.isochrones),
    "isochrone_edges": _reach(S.isochrone_edges),
    "districts": lambda s, d: district_resolution(stored(s, d, "population"), S.divisions(s, d)),
    "poi_history": S.poi_history,
    "category_momentum": _from("poi_history", momentum_rollup),
    "saved_sites": S.saved_sites,
}
SURFACE = Layout("city")

_ROOTS: dict[tuple[str, str], str] = {}
_OPENED: dict[str, DataFrame] = {}
_LOCK = Lock()
_LOADING: dict[str, Lock] = {}


def _path(spark: SparkSession, sf_dir: str, name: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _ROOTS:
        _ROOTS[key] = new_folder(spark, "warehouse")
    return f"{_ROOTS[key]}/{name}"


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of one table for a single pass: the stored ones if it is loaded already, else as they are made.

    A table that is read once as a whole is not worth a range split and a copy on disk.
    """
    with _LOCK:
        loaded = _OPENED.get(_path(spark, sf_dir, name))
    return BUILDERS[name](spark, sf_dir) if loaded is None else loaded


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table, loading it on first use."""
    with _LOCK:
        path = _path(spark, sf_dir, name)
        loading = _LOADING.setdefault(path, Lock())
    with loading:
        if path in _OPENED:
            return _OPENED[path]
        layout = LAYOUTS.get(name, SURFACE)
        # As many ranges as the session shuffles into: fewer files would leave readers of small tables short of tasks.
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer(laid_out(BUILDERS[name](spark, sf_dir), layout, ranges), layout).mode("overwrite").parquet(path)
        # Tables do not change once written, so listing and footers are read once per session.
        _OPENED[path] = spark.read.parquet(path)
        return _OPENED[path]


def load(spark: SparkSession, sf_dir: str, names: Sequence[str], at_once: int = 4) -> None:
    """Load several tables with a few jobs in flight, so small ones do not wait for large ones.

    The tables other tables are derived from go first.
    """
    first = [n for n in ("population", "buildings", "poi_history") if n in names]
    for wave in (first, [n for n in names if n not in first]):
        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(lambda n: stored(spark, sf_dir, n), wave))


def surface(spark: SparkSession, sf_dir: str, word: str) -> DataFrame:
    """The scored surface of one trade word, computed once and stored by city."""
    name = "surface_" + word.replace(" ", "_")
    if name not in BUILDERS:
        cats = resolve_categories(word)
        BUILDERS[name] = lambda s, d: scored(market(s, d), cats)
    return stored(spark, sf_dir, name)


def market(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables a scored surface reads."""
    names = ("places", "population", "cell_capacity", "addr_density", "isochrone_cells")
    return Tables(**{n: stored(spark, sf_dir, n) for n in names})
