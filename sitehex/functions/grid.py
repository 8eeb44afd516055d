"""Hexagonal cell algebra as Column arithmetic.

Two families share the same contracts (7 children, ring of 7, centre child):

* real 64-bit H3 ids, handled with bit operations only (text, parent, centre child,
  children) — their ids arrive with the data;
* a native hex lattice, used whenever coordinates have to become cells. Axial ``(q, r)``
  coordinates over a per-city equirectangular projection, packed into one signed 64-bit id:
  ``(city_idx * 16 + res) * 2^52 + (q + 2^25) * 2^26 + (r + 2^25)``.

A lattice child centre is the parent's coordinate times ``2 + zeta`` (norm 7), so a parent has
exactly seven children and moving between resolutions is integer arithmetic without trigonometry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitehex.cities import CITIES, H3_IDX, City, anchor

BASE_RES = 8
EDGE_M = 531.0
M_PER_DEG_LAT = 111194.9

Q_UNIT = 1 << 26
RES_UNIT = 1 << 52
OFFSET = 1 << 25
MASK26 = (1 << 26) - 1

# The seven axial unit offsets, self first, and the child digit each one encodes.
RING1 = ((0, 0), (1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))
DIGIT_OFFSET = {0: (0, 0), 1: (1, 0), 5: (0, 1), 4: (-1, 1), 6: (-1, 0), 2: (0, -1), 3: (1, -1)}
# Hexagon corners in fractional axial coordinates, in ring order.
CORNERS = ((1, 1), (-1, 2), (-2, 1), (-1, -1), (1, -2), (2, -1))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- text ids (both families) ---------------------------------------------------------------


def cell_from_string(s) -> Column:
    return F.conv(_c(s), 16, 10).cast("bigint")


def cell_to_string(cell) -> Column:
    return F.lower(F.hex(_c(cell)))


# ---- lattice ids ----------------------------------------------------------------------------


def pack(idx, res, q, r) -> Column:
    head = _c(idx).cast("bigint") * 16 + (F.lit(res) if isinstance(res, int) else _c(res))
    return head * F.lit(RES_UNIT) + (_c(q) + OFFSET) * F.lit(Q_UNIT) + (_c(r) + OFFSET)


def cell_city_idx(cell) -> Column:
    return F.shiftright(_c(cell), 56)


def require_lattice(cell) -> Column:
    """``cell`` itself; a real H3 id, which lattice arithmetic would read as a far-away cell, is an error."""
    text = F.concat(F.lit("a real H3 id where a lattice cell is needed; re-key it by its centroid: "), cell_to_string(cell))
    return F.when(cell_city_idx(cell) == H3_IDX, F.raise_error(text).cast("bigint")).otherwise(_c(cell))


def cell_res(cell) -> Column:
    return F.shiftright(_c(cell), 52).bitwiseAND(F.lit(15).cast("bigint"))


def cell_q(cell) -> Column:
    return F.shiftright(_c(cell), 26).bitwiseAND(F.lit(MASK26).cast("bigint")) - OFFSET


def cell_r(cell) -> Column:
    return _c(cell).bitwiseAND(F.lit(MASK26).cast("bigint")) - OFFSET


def _finer(q, r):
    return q * 2 - r, q + r * 3


def _coarser_exact(q, r):
    return (q * 3 + r) / F.lit(7.0), (r * 2 - q) / F.lit(7.0)


def _nearest(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def with_cell(
    df: DataFrame, lon, lat, idx, outs: Mapping[str, int], cities: Sequence[City] = CITIES
) -> DataFrame:
    """Add the cell containing a point, one column per ``{name: resolution}``.

    Cube rounding reuses every intermediate value several times, so it is written as a short chain
    of projections instead of one nested expression; they run in one generated stage.
    """
    lon, lat, idx = _c(lon), _c(lat), _c(idx)
    keep = [c for c in df.columns if c not in outs]
    step = df.withColumns(
        {
            "_g_idx": idx.cast("bigint"),
            "_g_x": (lon - anchor(idx, "lon0", cities)) * anchor(idx, "metres_per_deg_lon", cities),
            "_g_y": (lat - anchor(idx, "lat0", cities)) * F.lit(M_PER_DEG_LAT),
        }
    ).withColumns(
        {
            "_g_q8": (F.col("_g_x") * F.lit(0.5773502691896258) - F.col("_g_y") * F.lit(0.3333333333333333)) / F.lit(EDGE_M),
            "_g_r8": F.col("_g_y") * F.lit(0.6666666666666666) / F.lit(EDGE_M),
        }
    )
    levels = sorted(set(outs.values()))
    for res in range(BASE_RES + 1, max(levels + [BASE_RES]) + 1):
        q, r = _finer(F.col(f"_g_q{res - 1}"), F.col(f"_g_r{res - 1}"))
        step = step.withColumns({f"_g_q{res}": q, f"_g_r{res}": r})
    for res in range(BASE_RES - 1, min(levels + [BASE_RES]) - 1, -1):
        q, r = _coarser_exact(F.col(f"_g_q{res + 1}"), F.col(f"_g_r{res + 1}"))
        step = step.withColumns({f"_g_q{res}": q, f"_g_r{res}": r})
    step = step.withColumns(
        {
            f"_g_{n}{res}": _nearest(v)
            for res in levels
            for n, v in (
                ("a", F.col(f"_g_q{res}")),
                ("b", F.col(f"_g_r{res}")),
                ("c", -F.col(f"_g_q{res}") - F.col(f"_g_r{res}")),
            )
        }
    ).withColumns(
        {
            f"_g_d{n}{res}": F.abs(v)
            for res in levels
            for n, v in (
                ("a", F.col(f"_g_a{res}") - F.col(f"_g_q{res}")),
                ("b", F.col(f"_g_b{res}") - F.col(f"_g_r{res}")),
                ("c", F.col(f"_g_c{res}") + F.col(f"_g_q{res}") + F.col(f"_g_r{res}")),
            )
        }
    )
    cells = {}
    for name, res in outs.items():
        a, b, c = (F.col(f"_g_{n}{res}") for n in "abc")
        da, db, dc = (F.col(f"_g_d{n}{res}") for n in "abc")
        q_worst = (da > db) & (da > dc)
        q = F.when(q_worst, -b - c).otherwise(a)
        r = F.when(q_worst, b).when(db > dc, -a - c).otherwise(b)
        cells[name] = pack(F.col("_g_idx"), res, q, r)
    return step.select(*keep, *[v.alias(n) for n, v in cells.items()])


def _to_lonlat(qf: Column, rf: Column, res, idx: Column, cities: Sequence[City]) -> Column:
    """Fractional axial coordinates at ``res`` to ``struct(lon, lat)``.

    ``res`` may be a Column: only the resolutions in use (7..9) are distinguished.
    """
    if isinstance(res, int):
        for _ in range(max(0, res - BASE_RES)):
            qf, rf = _coarser_exact(qf, rf)
        for _ in range(max(0, BASE_RES - res)):
            qf, rf = _finer(qf, rf)
    else:
        q9, r9 = _coarser_exact(qf, rf)
        q7, r7 = _finer(qf, rf)
        qf = F.when(res == 9, q9).when(res == 7, q7).otherwise(qf)
        rf = F.when(res == 9, r9).when(res == 7, r7).otherwise(rf)
    x = F.lit(EDGE_M) * (F.lit(1.7320508075688772) * qf + F.lit(0.8660254037844386) * rf)
    y = F.lit(EDGE_M) * F.lit(1.5) * rf
    lon = anchor(idx, "lon0", cities) + x / anchor(idx, "metres_per_deg_lon", cities)
    lat = anchor(idx, "lat0", cities) + y / F.lit(M_PER_DEG_LAT)
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def axial_center(q, r, res: int, idx, cities: Sequence[City] = CITIES) -> Column:
    """``struct(lon, lat)`` of a cell given by its coordinates; the same numbers as :func:`cell_center` has."""
    return _to_lonlat(_c(q).cast("double"), _c(r).cast("double"), res, _c(idx), cities)


def cell_center(cell, res=None, cities: Sequence[City] = CITIES) -> Column:
    """``struct(lon, lat)``. Pass ``res`` when it is known to keep the expression small."""
    cell = _c(cell)
    return _to_lonlat(
        cell_q(cell).cast("double"),
        cell_r(cell).cast("double"),
        cell_res(cell) if res is None else res,
        cell_city_idx(cell),
        cities,
    )


def with_center(
    df: DataFrame, cell: str, res: int, lon: str = "lon", lat: str = "lat", cities: Sequence[City] = CITIES
) -> DataFrame:
    """Add a cell's centre as two plain columns.

    Distances and containment tests mention a centre many times; as columns of their own they are
    computed once per row and the generated code stays small.
    """
    axial = df.withColumns(
        {"_g_q": cell_q(cell).cast("double"), "_g_r": cell_r(cell).cast("double"), "_g_i": cell_city_idx(cell)}
    )
    at = _to_lonlat(F.col("_g_q"), F.col("_g_r"), res, F.col("_g_i"), cities)
    # Extracting from a struct that is built on the spot leaves only the arithmetic in the plan.
    return axial.withColumns({lon: at["lon"], lat: at["lat"]}).drop("_g_q", "_g_r", "_g_i")


# Centres lie on parallels, numbered by an integer that is linear in q and r. Per resolution: the number's factors of q and r,
# how many parallels make one row of base resolution, the step (q, r) from one centre to the next one east, and the
# distance of two centres in base cells. A parallel ``k`` holds ``k * start + t * step`` for whole ``t``, whose first centre is
# ``k * shift`` base cells east of the anchor.
_PARALLELS = {
    7: {"of": (1, 3), "rows": 1, "step": (3, -1), "start": (1, 0), "width": 7.0, "shift": 2.5},
    8: {"of": (0, 1), "rows": 1, "step": (1, 0), "start": (0, 1), "width": 1.0, "shift": 0.5},
    9: {"of": (-1, 2), "rows": 7, "step": (2, 1), "start": (-1, 0), "width": 1.0, "shift": -5.0 / 14.0},
}
EAST_M = 1.7320508075688772 * EDGE_M


def parallels(res: int, idx, cities: Sequence[City] = CITIES):
    """Latitude of a numbered parallel of cell centres, and the (fractional) number of a latitude, as functions of Columns."""
    rows, lat0 = _PARALLELS[res]["rows"], anchor(_c(idx), "lat0", cities)

    def latitude(k: Column) -> Column:
        # The very arithmetic of `_to_lonlat`, so that a centre and its parallel have equal latitudes.
        rf = k.cast("double") if rows == 1 else k.cast("double") / F.lit(float(rows))
        return lat0 + F.lit(EDGE_M) * F.lit(1.5) * rf / F.lit(M_PER_DEG_LAT)

    def number(lat: Column) -> Column:
        return (lat - lat0) * F.lit(M_PER_DEG_LAT * rows / (EDGE_M * 1.5))

    return latitude, number


def steps_on_parallel(res: int, k, west, east, idx, cities: Sequence[City] = CITIES) -> tuple[Column, Column]:
    """First and last step of the centres between two longitudes of a parallel, padded by one for rounding."""
    way = _PARALLELS[res]
    per_deg, lon0 = anchor(_c(idx), "metres_per_deg_lon", cities), anchor(_c(idx), "lon0", cities)

    def step(lon: Column) -> Column:
        return ((lon - lon0) * per_deg / F.lit(EAST_M) - _c(k) * F.lit(way["shift"])) / F.lit(way["width"])

    return F.ceil(step(_c(west))) - 1, F.floor(step(_c(east))) + 1


def cell_on_parallel(res: int, k, t) -> tuple[Column, Column]:
    """``q`` and ``r`` of a step of a parallel."""
    way = _PARALLELS[res]
    return tuple(_c(k) * start + _c(t) * step for start, step in zip(way["start"], way["step"]))


def cell_boundary(cell, res=None, cities: Sequence[City] = CITIES) -> Column:
    """Closed ring of six corners plus the first one repeated."""
    cell = _c(cell)
    q, r = cell_q(cell).cast("double"), cell_r(cell).cast("double")
    res = cell_res(cell) if res is None else res
    idx = cell_city_idx(cell)
    ring = [
        _to_lonlat(q + F.lit(dq / 3.0), r + F.lit(dr / 3.0), res, idx, cities) for dq, dr in CORNERS
    ]
    return F.array(*ring, ring[0])


def cell_ring(cell, k: int = 1) -> Column:
    """All cells within ``k`` steps including the cell itself, as an array.

    A neighbour is the id plus a constant, so the ring is ``3k(k+1)+1`` additions.
    """
    cell = _c(cell)
    if k == 1:
        offsets = RING1
    else:
        offsets = disk_offsets(k)
    return F.array(*[cell + F.lit(dq * Q_UNIT + dr) for dq, dr in offsets])


def disk_offsets(k: int) -> tuple[tuple[int, int], ...]:
    return tuple(
        (dq, dr)
        for dq in range(-k, k + 1)
        for dr in range(-k, k + 1)
        if abs(dq + dr) <= k
    )


def _by_digit(digit: Column, axis: int) -> Column:
    return F.get(F.array(*[F.lit(DIGIT_OFFSET[d][axis]).cast("bigint") for d in range(7)]), digit)


def _lattice_parent_once(cell: Column) -> Column:
    q, r = cell_q(cell), cell_r(cell)
    digit = F.pmod(q + r * 5, F.lit(7).cast("bigint")).cast("int")
    a, b = q - _by_digit(digit, 0), r - _by_digit(digit, 1)
    # Both numerators are multiples of 7 and far below 2^53, so the division is exact.
    pq = ((a * 3 + b) / F.lit(7.0)).cast("bigint")
    pr = ((b * 2 - a) / F.lit(7.0)).cast("bigint")
    return pack(cell_city_idx(cell), cell_res(cell) - 1, pq, pr)


# ---- both families --------------------------------------------------------------------------


def _h3_with_res(cell: Column, res: int) -> Column:
    keep = ~(15 << 52) & ((1 << 63) - 1)
    return cell.bitwiseAND(F.lit(keep)).bitwiseOR(F.lit(res << 52))


def cell_to_parent(cell, res: int, from_res: int | None = None, grid: str = "lattice") -> Column:
    """Ancestor at ``res``. Lattice ids need ``from_res`` (the resolution they are at)."""
    cell = _c(cell)
    if grid == "h3":
        unused = (1 << (3 * (15 - res))) - 1
        return _h3_with_res(cell, res).bitwiseOR(F.lit(unused).cast("bigint"))
    steps = (res + 1 if from_res is None else from_res) - res
    for _ in range(steps):
        cell = _lattice_parent_once(cell)
    return cell


def cell_to_center_child(cell, res: int, from_res: int | None = None, grid: str = "lattice") -> Column:
    cell = _c(cell)
    from_res = res - 1 if from_res is None else from_res
    if grid == "h3":
        cleared = 0
        for level in range(from_res + 1, res + 1):
            cleared |= 7 << (3 * (15 - level))
        keep = ~cleared & ((1 << 63) - 1)
        return _h3_with_res(cell, res).bitwiseAND(F.lit(keep))
    q, r = cell_q(cell), cell_r(cell)
    for _ in range(res - from_res):
        q, r = _finer(q, r)
    return pack(cell_city_idx(cell), res, q, r)


def cell_to_children(cell, res: int, grid: str = "lattice") -> Column:
    """The seven children one resolution finer, as an array (explode for rows)."""
    centre = cell_to_center_child(cell, res, grid=grid)
    if grid == "h3":
        unit = 1 << (3 * (15 - res))
        return F.array(*[centre + F.lit(d * unit) for d in range(7)])
    return F.array(*[centre + F.lit(u * Q_UNIT + v) for u, v in RING1])


def is_center_child(cell, res: int, grid: str = "lattice") -> Column:
    """True when the cell is the centre child of its own parent; arithmetic only, no join."""
    cell = _c(cell)
    if grid == "h3":
        digit = F.shiftright(cell, 3 * (15 - res)).bitwiseAND(F.lit(7).cast("bigint"))
        return digit == 0
    return F.pmod(cell_q(cell) + cell_r(cell) * 5, F.lit(7).cast("bigint")) == 0


# ---- render / layout helpers ----------------------------------------------------------------

WORLD = 4294967295  # Fixed value: the mercator square spans the unsigned 32-bit range.


def mercator_x(lon) -> Column:
    return F.floor(F.lit(float(WORLD)) * ((_c(lon) + 180) / 360)).cast("bigint")


def mercator_y(lat) -> Column:
    lat = _c(lat)
    return F.floor(
        F.lit(float(WORLD)) * (F.lit(0.5) - F.log(F.tan((lat + 90) / 360 * F.pi())) / F.pi() / 2)
    ).cast("bigint")


def _spread(x: Column) -> Column:
    """Insert a zero bit between the low 31 bits of ``x``."""
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(x, y) -> Column:
    """Bit-interleaved sort key of two non-negative values below 2^31."""
    return _spread(_c(x).cast("bigint")).bitwiseOR(F.shiftleft(_spread(_c(y).cast("bigint")), 1))
