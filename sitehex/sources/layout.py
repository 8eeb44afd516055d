"""How stored tables lie on disk: partition column, cluster order and Bloom filters for point lookups.

Rows are split by ranges of (partition, cluster key) and sorted, so a range of keys is a few row groups whose minima and
maxima leave the rest unread. Columns that are looked up by value, but that the table is not ordered by, carry Parquet
Bloom filters: an equality on one skips every row group that cannot hold the value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from sitehex.functions import grid as G


def space_filling(lon="lon", lat="lat") -> Column:
    """Interleaved mercator coordinates (halved to stay within 62 bits): near points have near keys."""
    return G.morton(F.shiftright(G.mercator_x(lon), 1), F.shiftright(G.mercator_y(lat), 1))


@dataclass(frozen=True)
class Layout:
    """``order`` holds column names or functions that make a sort key of a table's columns."""

    by: str | None
    order: tuple[str | Callable[[], Column], ...] = ()
    bloom: tuple[str, ...] = ()

    def keys(self) -> list[Column]:
        return [F.col(k) if isinstance(k, str) else k() for k in self.order]


# Stored tables by the keys that their readers look for.
LAYOUTS: dict[str, Layout] = {
    "places": Layout("city", (space_filling,), ("h3_9", "h3_8")),
    "population": Layout("country", ("h3_8",)),
    "buildings": Layout("city", ("h3_8",)),
    "cell_capacity": Layout("city", ("h3_8",)),
    "addr_density": Layout("city", ("h3_8",)),
    "road_density": Layout("city", ("h3_8",)),
    "isochrones": Layout("city", ("origin_h3_9", "minutes")),
    "isochrone_cells": Layout("city", ("origin_h3_9", "minutes"), ("reachable_h3_9",)),
    "isochrone_edges": Layout("city", ("origin_h3_9", "duration_s")),
    "districts": Layout("city", ("h3_8",)),
    "poi_history": Layout("city"),
    "category_momentum": Layout(None),
    "saved_sites": Layout("city"),
}


def laid_out(df: DataFrame, layout: Layout, partitions: int | None = None) -> DataFrame:
    """``df`` split and sorted by its layout. A large key is spread over many tasks, small ones share one.

    A sort works its keys out anew for every pair of rows that it compares, so computed keys become columns first.
    """
    if not layout.order:
        return df
    made = {f"_key{i}": k() for i, k in enumerate(layout.order) if not isinstance(k, str)}
    keys = [layout.by] if layout.by else []
    keys += [k if isinstance(k, str) else f"_key{i}" for i, k in enumerate(layout.order)]
    keyed = df.withColumns(made) if made else df
    split = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    return split.sortWithinPartitions(*keys).drop(*made)


def writer(df: DataFrame, layout: Layout, row_group_bytes: int | None = None) -> DataFrameWriter:
    """A writer with the layout's partition column and Bloom filters, over rows that are laid out already."""
    out = df.write.partitionBy(layout.by) if layout.by else df.write
    for name in layout.bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{name}", "true")
    if layout.bloom:
        # Filters grow to what a row group holds instead of to a guess.
        out = out.option("parquet.bloom.filter.adaptive.enabled", "true")
    return out.option("parquet.block.size", row_group_bytes) if row_group_bytes else out


def one_of(column: str, values: Sequence[int]) -> Column:
    """Equality with any of a few values, in a form that reaches the Bloom filters however many there are.

    ``isin`` is pushed down as a mere range when it lists more than ten values.
    """
    values = sorted({int(v) for v in values})
    hit = F.lit(False)
    for i, v in enumerate(values):
        hit = F.col(column) == v if i == 0 else hit | (F.col(column) == v)
    return hit
