"""City registry: the bounding boxes every table is loaded and scored with.

The registry is driver-side configuration (a short Python list), so predicates and
lookups built from it are literals: they reach the Parquet scan and never need a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# Where a lattice id has the number of its city, a real H3 cell id has this one.
H3_IDX = 8


@dataclass(frozen=True)
class City:
    """One scored city. ``idx`` is part of every lattice cell id: 0 to 126, and not that of real H3 ids."""

    idx: int
    name: str
    country: str
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    lon0: float
    lat0: float
    metres_per_deg_lon: float

    def __post_init__(self):
        if not 0 <= self.idx < 127 or self.idx == H3_IDX:
            raise ValueError(f"city number {self.idx} of {self.name!r} does not fit a cell id")

    def contains(self, lon: Column, lat: Column, pad: float = 0.0) -> Column:
        return lon.between(self.lon_min - pad, self.lon_max + pad) & lat.between(
            self.lat_min - pad, self.lat_max + pad
        )

    def overlaps(self, xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
        return (
            (xmin <= self.lon_max)
            & (xmax >= self.lon_min)
            & (ymin <= self.lat_max)
            & (ymax >= self.lat_min)
        )


# City boxes, countries and projection anchors.
CITIES: tuple[City, ...] = (
    City(0, "berlin", "DE", 52.338, 52.675, 13.088, 13.761, 13.4245, 52.5065, 67681.2),
    City(1, "amsterdam", "NL", 52.27, 52.44, 4.68, 5.07, 4.875, 52.355, 67914.2),
    City(2, "belgrade", "RS", 44.66, 44.92, 20.2, 20.65, 20.425, 44.79, 78914.3),
)


class UnknownCity(ValueError):
    """Raised instead of returning an empty answer for a city that holds no data."""

    def __init__(self, city: str, available: Sequence[str]):
        super().__init__(f"unavailable city {city!r}; available: {', '.join(available)}")
        self.city = city
        self.available = list(available)


def check_city(city: str, cities: Sequence[City] = CITIES) -> City:
    wanted = city.strip().lower()
    for c in cities:
        if c.name == wanted:
            return c
    raise UnknownCity(city, [c.name for c in cities])


def select_cities(names: Sequence[str] | str | None, cities: Sequence[City] = CITIES) -> tuple[City, ...]:
    """All cities for ``None``, otherwise the named ones (each validated)."""
    if names is None:
        return tuple(cities)
    if isinstance(names, str):
        names = [names]
    return tuple(check_city(n, cities) for n in names)


def any_city(predicate, cities: Sequence[City]) -> Column:
    """OR of a per-city predicate; plain literals, so it is pushed down to the scan."""
    cond = F.lit(False)
    for i, c in enumerate(cities):
        cond = predicate(c) if i == 0 else cond | predicate(c)
    return cond


def matching_cities(predicate, cities: Sequence[City]) -> Column:
    """Array of the names of every city whose predicate holds (boxes may overlap)."""
    return F.array_compact(
        F.array(*[F.when(predicate(c), F.lit(c.name)) for c in cities])
    )


def country_of(city: Column, cities: Sequence[City] = CITIES) -> Column:
    out = F.when(city == cities[0].name, F.lit(cities[0].country))
    for c in cities[1:]:
        out = out.when(city == c.name, F.lit(c.country))
    return out


def idx_of(city: Column, cities: Sequence[City] = CITIES) -> Column:
    out = F.when(city == cities[0].name, F.lit(cities[0].idx))
    for c in cities[1:]:
        out = out.when(city == c.name, F.lit(c.idx))
    return out.cast("bigint")


def name_of(idx: Column, cities: Sequence[City] = CITIES) -> Column:
    out = F.when(idx == cities[0].idx, F.lit(cities[0].name))
    for c in cities[1:]:
        out = out.when(idx == c.idx, F.lit(c.name))
    return out


def anchor(idx: Column, attr: str, cities: Sequence[City] = CITIES) -> Column:
    """Per-city projection constant, looked up by index in a literal array."""
    by_idx = {c.idx: getattr(c, attr) for c in cities}
    size = max(by_idx) + 1
    return F.get(
        F.array(*[F.lit(by_idx.get(i)).cast("double") for i in range(size)]), idx.cast("int")
    )
