"""Whitening of embeddings: principal components by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries are scaled to whole numbers, ``x = floor(64 * c) + 1000000``, so that means and distances from them are exact. The
*fit list* holds each distinct vector once; with ``X`` its centred rows, ``n`` of them, the bidiagonalisation builds

    X v_k = alpha_k u_k + beta_{k-1} u_{k-1},        X' u_k = alpha_k v_k + beta_k v_{k+1}

with orthonormal ``v`` and ``u``. The long vectors ``u`` have one entry a row and are never stored: all of them are
``u_k = X w_k`` for short vectors ``w_k`` that the driver holds. One pass over the blocks of the fit list takes
``p = v_k - beta_{k-1} w_{k-1}``, forms ``t = X p``, and returns ``X' t``, ``t't`` and the products of ``t`` with all earlier
``X w_j``. That is both products of a step, and what full reorthogonalisation of ``u`` needs: subtracting ``c_j u_j`` from
``t`` subtracts ``c_j w_j`` from ``p`` and ``c_j X' u_j``, known from step ``j``, from ``X' t``. The ``v`` are
reorthogonalised on the driver. The small upper bidiagonal matrix has ``X``'s largest singular values and, through the
``v``, its right singular vectors, which are the components.

Vectors of up to ``FULL_STEPS`` entries take as many steps as they have entries; a product that vanishes starts afresh
from a direction orthogonal to all before, so equal eigenvalues are all found. Longer vectors stop when the wanted
components stand still (a residual below ``RESIDUAL`` of the size of the whole matrix).

A step is one Spark job over stored blocks of ``BLOCK_ROWS`` vectors; tasks return partial sums of as many numbers as a
vector has entries, which are added by position map-side and in one small shuffle. The driver holds numbers of one vector times the number of
steps and never a row. Vectors meet only to be made distinct, with map-side deduplication first, so a vector that
fills a third of the table is one row.

Rows: rows whose vector is null or has null or non-finite entries are dropped, as are vectors that are not of the most
common length (of equally common ones the longest): they miss entries. Every other row comes once for each component, repeated
and null ids included. Components are those with a variance of more than ``LEAST_SHARE`` of the whole; a single vector,
repeated or not, has none and so no result rows. Entries beyond 2^55 are held there. ``deviation`` is null where it
exceeds a long, the exact value is in ``deviation_exact``. Only the named columns are read, so others may be called
anything. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.llm.common import batch, staged

SCALE, SHIFT = 64, 1_000_000

COMPONENTS = 16
FULL_STEPS = 256
RESIDUAL = 1e-13
LEAST_SHARE = 1e-12
BLOCK_ROWS = 2048
WIDEST = float(1 << 61)
SEED = 20


def _vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and whole-number entries of every vector without missing or non-finite entries."""
    for i, value in enumerate(column):
        if not value.is_valid:
            continue
        entries = value.values
        if entries.null_count:
            continue
        c = entries.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(c).all():
            x = np.clip(np.floor(c * SCALE), -WIDEST, WIDEST).astype(np.int64) + SHIFT
            yield i, x


def whole_numbers(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """``id_col`` and ``x``, the entries of the vector as 64-bit little-endian whole numbers, of all usable rows, and the
    number of entries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picked, xs = [], []
            for i, x in _vectors(b.column(1)):
                picked.append(i)
                xs.append(x.tobytes())
            ids = b.column(0).take(pa.array(picked, pa.int64()))
            yield batch([(id_col, ids), ("x", pa.array(xs, pa.binary()))])

    kind = df.schema[id_col].dataType.simpleString()
    usable = df.select(id_col, vec_col).mapInArrow(rows, f"`{id_col}` {kind}, x binary")
    lengths = usable.groupBy(F.octet_length("x").alias("bytes")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("bytes")).first()
    size = common["bytes"] if common else 0
    return usable.where(F.octet_length("x") == size), size // 8


def _blocks(vectors: DataFrame) -> DataFrame:
    """Distinct vectors, up to ``BLOCK_ROWS`` of them end to end in one value."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(x)
                if len(held) == BLOCK_ROWS:
                    yield batch([("block", pa.array([b"".join(held)], pa.binary()))])
                    held = []
        if held:
            yield batch([("block", pa.array([b"".join(held)], pa.binary()))])

    return vectors.select("x").distinct().mapInArrow(rows, "block binary")


def _added(blocks: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of what ``part`` makes of a block's matrix of whole numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for block in b.column(0):
                one = part(np.frombuffer(block.as_buffer(), "<i8").reshape(-1, dims))
                total = one if total is None else total + one
        if total is not None:
            yield batch([("at", pa.array(np.arange(len(total)), pa.int32())), ("value", pa.array(total, pa.float64()))])

    sums = blocks.mapInArrow(rows, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(sums))
    for at, value in sums:
        out[at] = value
    return out


@dataclass(frozen=True)
class Centre:
    """Number of vectors and their exact sum, as ``sum = n * quotient + remainder`` for each entry."""

    n: int
    quotient: np.ndarray
    remainder: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.quotient) - self.remainder / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of ``(n * x - sum)^2`` over the entries of each row, exact."""
        apart = x - self.quotient
        reach = (float(np.abs(apart).max(initial=0)) + 1) * self.n
        if reach < 2.0**31 and reach * reach * x.shape[1] < 2.0**62:
            d = apart * self.n - self.remainder
            return (d * d).sum(axis=1).tolist()
        d = apart.astype(object) * self.n - self.remainder.astype(object)
        return [sum(v * v for v in row) for row in d]


def _centre(blocks: DataFrame, dims: int) -> Centre:
    """Exact sums: halves of 32 bits are added, so that a sum of whole numbers cannot leave its type."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0):
                x = np.frombuffer(block.as_buffer(), "<i8").reshape(-1, dims)
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                at = np.arange(dims + 1)
                yield batch(
                    [
                        ("at", pa.array(at, pa.int32())),
                        ("high", pa.array(np.r_[high, 0], pa.int64())),
                        ("low", pa.array(np.r_[low, len(x)], pa.int64())),
                    ]
                )

    wide = "decimal(38,0)"
    parts = blocks.mapInArrow(rows, "at int, high long, low long").groupBy("at")
    sums = parts.agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).collect()
    total = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in sums}
    n = total.get(dims, 0)
    if n == 0:
        return Centre(0, np.zeros(dims, np.int64), np.zeros(dims, np.int64))
    split = [divmod(total[i], n) for i in range(dims)]
    return Centre(n, np.array([q for q, _ in split], np.int64), np.array([r for _, r in split], np.int64))


@dataclass(frozen=True)
class Whitening:
    """``components`` (one a column), their variances ``eigenvalues`` and the variance of all entries together."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    steps: int


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``basis``; twice is enough."""
    if basis:
        q = np.stack(basis, axis=1)
        for _ in range(2):
            v = v - q @ (q.T @ v)
    return v


def bidiagonalise(
    product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]],
    dims: int,
    wanted: int,
    size: float,
    full_steps: int = FULL_STEPS,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Leading singular values of ``X`` and its right singular vectors, as columns, with the number of steps.

    ``product(p, w)`` gives ``X'Xp``, ``p'X'Xp`` and ``w'X'Xp`` for columns ``w``; ``size`` is the Frobenius norm of ``X``.
    """
    rng = np.random.default_rng(SEED)

    def fresh(basis: list[np.ndarray]) -> np.ndarray:
        v = _orthogonal(rng.standard_normal(dims), basis)
        return v / np.linalg.norm(v)

    vs: list[np.ndarray] = []
    ws: list[np.ndarray] = []  # u_k = X w_k
    backs: list[np.ndarray] = []  # X'u_k
    alphas: list[float] = []
    betas: list[float] = []
    # Below these, a column or a direction is rounding noise.
    no_column, no_direction = size * 1e-10, size * 1e-14
    v, beta = fresh(vs), 0.0
    values, right = np.empty(0), np.empty((dims, 0))
    while len(vs) < dims:
        p = v - beta * ws[-1] if ws else v
        back, norm2, along = product(p, np.stack(ws, axis=1) if ws else np.empty((dims, 0)))
        for c, w, b in zip(along, ws, backs):
            p, back, norm2 = p - c * w, back - c * b, norm2 - c * c
        vs.append(v)
        alpha = float(np.sqrt(max(norm2, 0.0)))
        if alpha > no_column:
            ws.append(p / alpha)
            backs.append(back / alpha)
        else:  # X v lies in what is known already: u_k is taken as nothing
            alpha = 0.0
            ws.append(np.zeros(dims))
            backs.append(np.zeros(dims))
        alphas.append(alpha)
        rest = _orthogonal(backs[-1] - alpha * v, vs)
        beta = float(np.linalg.norm(rest))
        k = len(vs)
        if k == dims or k % 8 == 0:
            b = np.diag(alphas) + np.diag(betas, 1)
            left, values, vt = np.linalg.svd(b)
            right = np.stack(vs, axis=1) @ vt.T
            settled = np.abs(left[-1, :wanted]) * beta <= RESIDUAL * size
            if k == dims or (dims > full_steps and k > wanted and settled.all()):
                break
        if beta > no_direction:
            v = _orthogonal(rest / beta, vs)
            v = v / np.linalg.norm(v)
        else:
            beta, v = 0.0, fresh(vs)
        betas.append(beta)
    return values[:wanted], right[:, :wanted], len(vs)


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS, full_steps: int = FULL_STEPS) -> Whitening:
    """Components of the distinct vectors of column ``x``, of ``dims`` entries each (see :func:`whole_numbers`)."""
    blocks = staged(_blocks(vectors), "fit-blocks")
    centre = _centre(blocks, dims)
    if centre.n == 0 or dims == 0:
        return Whitening(centre, np.empty((dims, 0)), np.empty(0), 0.0, 0.0, 0)
    n = centre.n

    def squares(x: np.ndarray) -> np.ndarray:
        return (centre.centred(x) ** 2).sum(axis=0)

    total = float(_added(blocks, dims, squares).sum())
    if total == 0.0:
        return Whitening(centre, np.empty((dims, 0)), np.empty(0), 0.0, 0.0, 0)

    def product(p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        def part(x: np.ndarray) -> np.ndarray:
            rows = centre.centred(x)
            t = rows @ p
            return np.r_[rows.T @ t, t @ t, (rows @ w).T @ t]

        out = _added(blocks, dims, part)
        return out[:dims], float(out[dims]), out[dims + 1 :]

    values, right, steps = bidiagonalise(product, dims, min(components, dims), float(np.sqrt(total)), full_steps)
    eigenvalues = values**2 / n
    kept = eigenvalues > LEAST_SHARE * total / n
    right, eigenvalues = right[:, kept], eigenvalues[kept]
    # Either sign would do; the largest entry is made positive.
    right = right * np.where(right[np.abs(right).argmax(axis=0), np.arange(right.shape[1])] < 0, -1.0, 1.0)
    white = right / np.sqrt(eigenvalues)
    count = white.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        z = centre.centred(x) @ white
        return np.r_[(z.T @ z).ravel(), z.sum(axis=0)]

    sums = _added(blocks, dims, moments)
    mean = sums[count * count :] / n
    covariance = sums[: count * count].reshape(count, count) / n - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(count)).max())
    return Whitening(centre, right, eigenvalues, total / n, error, steps)


def transform(vectors: DataFrame, model: Whitening, id_col: str) -> DataFrame:
    """Every row of ``vectors`` once for each component."""
    count = len(model.eigenvalues)
    dims = model.components.shape[0]
    white = model.components / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace if count else np.empty(0)
    kind = vectors.schema[id_col].dataType.simpleString()
    longest = (1 << 63) - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not count or not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i8").reshape(-1, dims)
            z = model.centre.centred(x) @ white
            deviations = model.centre.deviations(x)
            every = np.repeat(np.arange(len(x)), count)
            exact = pa.array([str(d) for d in deviations], pa.string())
            fits = pa.array([d if d <= longest else None for d in deviations], pa.int64())
            yield batch(
                [
                    (id_col, b.column(0).take(pa.array(every))),
                    ("component", pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32())),
                    ("n", pa.array(np.full(len(every), model.centre.n), pa.int64())),
                    ("deviation", fits.take(pa.array(every))),
                    ("whitened", pa.array(z.ravel(), pa.float64())),
                    ("explained", pa.array(np.tile(explained, len(x)), pa.float64())),
                    ("identity_error", pa.array(np.full(len(every), model.identity_error), pa.float64())),
                    ("deviation_exact", exact.take(pa.array(every))),
                ]
            )

    out = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    return vectors.select(id_col, "x").mapInArrow(rows, f"`{id_col}` {kind}, {out}")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors of ``df`` and transform all of them: one row for each vector and component."""
    vectors, dims = whole_numbers(df, id_col, vec_col)
    return transform(vectors, fit(vectors, dims, components), id_col)
