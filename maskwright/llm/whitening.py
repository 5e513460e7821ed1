"""Embedding whitening by LOBPCG (locally optimal block preconditioned conjugate gradients, without a preconditioner).

1. Vectors become integers x; their number, per-dimension sums and spread are exact sums over tasks.
2. The covariance V is never formed. A task multiplies its centred rows with a block B of at most 3m columns, C'(C B); Spark sums the blocks' entries, so
   the driver gets d x 3m numbers however many rows there are.
3. Each round takes the iterate X, the residuals V X - X diag(e) and the previous direction P, makes them orthonormal, applies V in one pass over the
   rows, and takes the best m vectors of that space (Rayleigh-Ritz).
4. It ends when the residuals of all asked components, measured with a fresh product, are below the tolerance; a bound that is not
   reached is an error, not a result.
5. Rows are projected with the certified components; the covariance of what comes out is measured against the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, write_once

COMPONENTS = 8
#: Columns of the iterate beyond the components that are asked for: they take the part of the spectrum that would slow convergence.
GUARD = 8
#: A component's residual, in units of the largest eigenvalue, and rounds at most.
TOLERANCE, ROUNDS = 1e-12, 400
#: Eigenvalues up to this share of the largest are no components: nothing varies along them.
LEAST = 1e-12
#: x = floor(SCALE * c) + SHIFT; entries beyond 2**53 count as 2**53.
SCALE, SHIFT = 1024, 100_000
_EDGE = float(2**53)
_CELL = "cell long, value double"
_WHITE = "vec_id %s, carried %s, component int, n long, deviation decimal(38,0), whitened double"


def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, carried, embedding) to (vec_id, carried, x, width), without null vectors and those that hold a null or a non-finite entry."""
    for batch in batches:
        vectors = batch.column("embedding")
        batch = batch.filter(pc.is_valid(vectors))
        vectors = batch.column("embedding")
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten()
        good = pc.fill_null(pc.is_finite(pc.fill_null(flat.cast(pa.float64()), float("nan"))), False).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        keep = np.bincount(owner[~good], minlength=len(sizes)) == 0
        c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)[keep[owner]]
        x = np.clip(np.floor(c * SCALE), -_EDGE, _EDGE).astype(np.int64) + SHIFT
        left = batch.filter(pa.array(keep))
        offsets = pa.array(np.r_[0, np.cumsum(sizes[keep])].astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(x))
        yield pa.RecordBatch.from_arrays([left.column("vec_id"), left.column("carried"), lists, pa.array(sizes[keep].astype(np.int32))], names=["vec_id", "carried", "x", "width"])


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Fit:
    """Number of rows, exact sums per dimension, trace of the covariance."""

    n: int
    sums: np.ndarray
    trace: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n from the exact n x - S."""
        return self.scaled(x).astype(np.float64) / self.n

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S as integers; of Python's own where 64 bits could be too few."""
        if len(x) and self.n * max(abs(int(x.min())), abs(int(x.max()))) < 2**61 and int(np.abs(self.sums).max()) < 2**61:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], d: int, cells: int) -> np.ndarray:
    """The sum over all rows of part(x), an array of the given number of cells. A task sends one row per cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch, d)).reshape(-1)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(cells)), "value": pa.array(total)})

    out = np.zeros(cells)
    for r in rows.select("x").mapInArrow(run, _CELL).groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out


def fit(rows: DataFrame) -> Fit | None:
    """rows: (x, width). None without rows. Vectors of different lengths are an error."""
    state = rows.agg(F.count("*").alias("n"), F.min("width").alias("low"), F.max("width").alias("high")).first()
    if not state.n:
        return None
    if state.low != state.high:
        raise ValueError(f"vectors have from {state.low} to {state.high} entries")
    d = int(state.high)
    if not d:
        return Fit(int(state.n), np.zeros(0, object))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, d)
                # Halves of 32 bits, so that a batch's sum fits 64.
                total += (x >> 32).sum(0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(0).astype(object)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(d), pa.int64()), "value": pa.array([str(v) for v in total], pa.string())})

    sums = rows.select("x").mapInArrow(run, "cell long, value string").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    s = np.zeros(d, object)
    for r in sums:
        s[r["cell"]] = int(r["value"])
    out = Fit(int(state.n), s)
    out.trace = float(_summed(rows, lambda x: (out.centred(x) ** 2).sum(keepdims=True), d, 1)[0]) / out.n
    return out


def _orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """A basis of what the blocks span: each block against those before it, twice, without directions that are lost in rounding."""
    basis = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
            size = np.linalg.norm(block, axis=0)
            block = block[:, size > 1e-9] / size[size > 1e-9]
        if block.shape[1]:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            u = u[:, s > 1e-8]
            u -= basis @ (basis.T @ u)
            basis = np.hstack((basis, np.linalg.qr(u)[0]))
    return basis


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, *, guard: int = GUARD, tolerance: float = TOLERANCE, rounds: int = ROUNDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """product(B): V B for a symmetric V of which nothing else is known. The k largest eigenvalues (d, if there are fewer), falling, their unit vectors as
    columns, and the residuals |V x - e x|, measured with a product of their own. An error if they aren't below tolerance times the largest eigenvalue."""
    k, m = min(d, k), min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    ax, p, worst = product(x), np.zeros((d, 0)), np.inf
    for _ in range(rounds):
        e, c = _ritz(x, ax)
        x, ax = x @ c, ax @ c
        residual = ax - x * e
        sizes = np.linalg.norm(residual[:, :k], axis=0)
        worst = sizes.max(initial=0.0) / max(e[0], 1e-300)
        if e[0] <= 0 or worst <= tolerance:
            x = np.linalg.qr(x)[0]
            ax = product(x)
            e = (x * ax).sum(0)
            residual = ax - x * e
            sizes = np.linalg.norm(residual[:, :k], axis=0)
            if e[0] <= 0 or sizes.max() <= 2 * tolerance * e[0]:
                return e[:k], x[:, :k], sizes
        basis = _orthonormal([x, residual, p])
        ab = product(basis)
        _, c = _ritz(basis, ab, m)
        x, ax, p = basis @ c, ab @ c, basis[:, m:] @ c[m:]
    raise ArithmeticError(f"no convergence in {rounds} rounds: residual {worst:.1e} of the largest eigenvalue")


def _ritz(basis: np.ndarray, product: np.ndarray, m: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values of the basis, falling, and the combinations of its columns that belong to the first m."""
    g = basis.T @ product
    e, c = np.linalg.eigh((g + g.T) / 2)
    return e[::-1][:m], c[:, ::-1][:, :m]


def _deviations(scaled: np.ndarray) -> pa.Array:
    """Exact sums of squares by row; null for one of more than 38 digits."""
    if scaled.dtype == np.int64 and (not scaled.size or float(np.abs(scaled).max()) ** 2 * max(1, scaled.shape[1]) < 2**62):
        return pa.array((scaled * scaled).sum(1)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(int(v)) if v < 10**38 else None for v in (scaled.astype(object) ** 2).sum(1)], pa.decimal128(38, 0))


def whiten(docs: DataFrame, *, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per vector and component: vec_id, carried (a struct of the columns named in carry), component (from 1, by falling eigenvalue), n (vectors), deviation
    (the exact sum over dimensions of (n x - S)^2), whitened, explained (the component's share of the trace), identity_error (the largest entry by which the
    covariance of whitened differs from the identity).

    Vectors that are null or hold a null or a non-finite entry are left out. Null or repeated ids are rows like any other. Vectors of different lengths are an
    error. Directions along which nothing varies are no components: a table of equal vectors, one vector, empty vectors or no rows give no rows.
    """
    carried = F.struct(F.lit(len(carry)).alias("columns"), *(F.col(f"`{c}`") for c in carry))
    rows = docs.select(F.col(f"`{id_col}`").alias("vec_id"), carried.alias("carried"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    id_type, carry_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "carried"))
    clean = write_once(rows.mapInArrow(integers, f"vec_id {id_type}, carried {carry_type}, x array<long>, width int"), "whitening")
    known = fit(clean)
    schema = _WHITE % (id_type, carry_type)
    nothing = docs.sparkSession.createDataFrame([], schema).withColumns({c: F.lit(None).cast("double") for c in ("explained", "identity_error")})
    if known is None or not known.trace > 0:
        return nothing
    d = len(known.sums)

    def product(b: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = known.centred(x)
            return c.T @ (c @ b)

        return _summed(clean, part, d, d * b.shape[1]).reshape(d, -1) / known.n

    e, vectors, _ = lobpcg(product, d, components)
    k = int((e > LEAST * e[0]).sum())
    axes = vectors[:, :k] / np.sqrt(e[:k])
    project = lambda x: known.centred(x) @ axes
    mean = _summed(clean, lambda x: project(x).sum(0), d, k) / known.n
    covariance = _summed(clean, lambda x: (w := project(x) - mean).T @ w, d, k * k).reshape(k, k) / known.n
    error = float(np.abs(covariance - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, d)
            row = pa.array(np.repeat(np.arange(len(x)), k))
            values = {
                "vec_id": batch.column("vec_id").take(row), "carried": batch.column("carried").take(row), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(x) * k, known.n)), "deviation": _deviations(known.scaled(x)).take(row), "whitened": pa.array(project(x).reshape(-1)),
            }
            yield pa.RecordBatch.from_pydict(values)

    shares = F.array(*(F.lit(float(v / known.trace)) for v in e[:k]))
    return clean.select("vec_id", "carried", "x").mapInArrow(run, schema).withColumn("explained", F.get(shares, F.col("component") - 1)).withColumn("identity_error", F.lit(error))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of embeddings. whiten() has deviations as exact decimals; here, as long, one that needs more than 64 bits (from some two million vectors like
    these) is null."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    exact = F.when(F.col("deviation") <= 2**63 - 1, F.col("deviation").cast("long"))
    return out.select("vec_id", "component", "n", exact.alias("deviation"), "whitened", "explained", "identity_error")
