"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred distinct vectors as rows, the steps alternate u = X v and v' = X^T u, each
orthogonal to all before. The rows stay where they are: as every u is X p for some p of the
vectors' dimension, only v and p are kept, on the driver, and tasks make their part of u from
their rows when they need it. A step is one pass: each task works out its part of X v, of its
products with all earlier u, and of X^T (X v), and Spark adds these sums up. The small bidiagonal
matrix has the singular values of X, and its singular vectors turn the v into components.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from antecede.session import written

#: Components returned.
COMPONENTS = 16
#: Entries become integers: floor of so many times the entry, plus an offset.
SCALE, OFFSET = 64, 1_000_000
#: Entries of a larger size have no such integer that sums of rows could hold.
LARGEST = 2.0**40
#: A direction counts as exhausted below this share of the largest one.
_NOTHING = 1e-12
_SEED = 12


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the rows whose vector has only finite entries; x has the integers of ``SCALE``.

    Rows with a null vector, or a null, infinite, undefined or larger entry than ``LARGEST``, are
    left out, and so are empty vectors and those whose length is not the commonest one (the
    longer one of two that are equally common).
    """
    values = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    good = F.forall("c", lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)) & ~F.isnan(c))
    rows = df.select(F.col(f"`{key}`").alias("key"), values.alias("c")).filter(good & (F.size("c") > 0))
    sizes = rows.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.agg(F.max(F.struct("n", "d"))["d"]).scalar()
    whole = F.transform("c", lambda c: (F.floor(c * SCALE) + OFFSET).cast("long"))
    return rows.filter(F.size("c") == common).select("key", whole.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _summed(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], dims: int, kind: str = "double") -> np.ndarray:
    """The sum over all rows of a vector that ``work`` makes of a batch of them, added up in tasks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = work(_matrix(batch.column(0), dims))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(arrow))], names=["sums"])

    arrow = pa.int64() if kind == "long" else pa.float64()
    parts = rows.select("x").mapInArrow(add, f"sums array<{kind}>")
    totals = parts.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    found = totals.toArrow()
    out = np.zeros(found.num_rows, np.int64 if kind == "long" else np.float64)
    out[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return out


@dataclass
class Whitening:
    """Components (one per column) with their eigenvalues, by falling eigenvalue, and the centre."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.components / np.sqrt(self.eigenvalues))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean, from whole numbers: nothing is rounded before the difference."""
    return (n * x - sums) / n


def bidiagonalise(distinct: DataFrame, n: int, sums: np.ndarray, steps: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """The v, one per column, and the upper bidiagonal B with X V = U B, of ``steps`` steps.

    ``spread`` is the Frobenius norm of X. A v that X takes to nothing has a zero column, and
    where X^T u is exhausted, the next v is a new direction orthogonal to all before, so that after as many
    steps as there are dimensions V is a whole basis and repeated singular values are all found.
    """
    dims, rng = len(sums), np.random.default_rng(_SEED)
    vs, ps, zs = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0))
    b = np.zeros((steps, steps))

    def new_direction() -> np.ndarray:
        v = rng.standard_normal(dims)
        for _ in range(3):
            v -= vs @ (vs.T @ v)
        return v / np.linalg.norm(v)

    v, beta, last = new_direction(), 0.0, np.zeros(dims)
    for j in range(steps):
        a = v - beta * last

        def products(x: np.ndarray, a: np.ndarray = a, ps: np.ndarray = ps) -> np.ndarray:
            rows = centred(x, n, sums)
            u = rows @ a
            return np.concatenate([rows.T @ u, (rows @ ps).T @ u, [u @ u]])

        found = _summed(distinct, products, dims)
        z, onto, length = found[:dims], found[dims:-1], found[-1]
        alpha = np.sqrt(max(length - onto @ onto, 0.0))
        vs = np.column_stack([vs, v])
        b[j, j] = alpha
        if j:
            b[j - 1, j] = beta
        if alpha > _NOTHING * spread:
            p, z = (a - ps @ onto) / alpha, (z - zs @ onto) / alpha
            rest = z - alpha * v
        else:
            b[j, j], p, z, rest = 0.0, np.zeros(dims), np.zeros(dims), np.zeros(dims)
        ps, zs, last = np.column_stack([ps, p]), np.column_stack([zs, z]), p
        if j + 1 == steps:
            break
        for _ in range(2):
            rest = rest - vs @ (vs.T @ rest)
        beta = float(np.linalg.norm(rest))
        if beta > _NOTHING * spread:
            v = rest / beta
        else:
            beta, v = 0.0, new_direction()
    return vs, b


def fit(vectors: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> Whitening | None:
    """The whitening of integer vectors (x), each distinct one counted once; None if there are none.

    ``steps`` defaults to the dimension, which finds all components to double precision; with fewer, the
    first ones are found as far as the steps have converged, and equal eigenvalues may be missed. Each step is
    a pass over the distinct vectors. Components whose eigenvalue is zero up to rounding are left
    out, as nothing can be scaled by them.
    """
    distinct = written(vectors.select("x").distinct(), "distinct")
    first = distinct.select(F.size("x")).first()
    if first is None:
        return None
    dims = first[0]
    totals = _summed(distinct, lambda x: np.append(x.sum(axis=0), len(x)), dims, "long")
    n, sums = int(totals[-1]), totals[:-1]
    squares = _summed(distinct, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]), dims)[0]
    steps = min(steps or dims, dims)
    vs, b = bidiagonalise(distinct, n, sums, steps, float(np.sqrt(squares)))
    _, sigma, right = np.linalg.svd(b)
    kept = [i for i in range(min(components, steps)) if sigma[i] > 1e-9 * np.sqrt(squares)]
    out = Whitening(n, sums, vs @ right.T[:, kept], sigma[kept] ** 2 / n, squares / n)
    if kept:

        def moments(x: np.ndarray) -> np.ndarray:
            y = out.project(x)
            return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

        found = _summed(distinct, moments, dims) / n
        mean = found[len(kept) ** 2 :]
        covariance = found[: len(kept) ** 2].reshape(len(kept), -1) - np.outer(mean, mean)
        out.identity_error = float(np.abs(covariance - np.eye(len(kept))).max())
    return out


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n x - S)^2 of every row, exactly; None where it is beyond 64 bits."""
    apart = n * x - sums
    if len(apart) and int(np.abs(apart).max()) ** 2 * apart.shape[1] >= 2**63:
        whole = (apart.astype(object) ** 2).sum(axis=1)
        return [int(d) if d < 2**63 else None for d in whole]
    return (apart**2).sum(axis=1).tolist()


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, steps: int | None = None
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row per vector and component.

    Vectors become integers (``integer_vectors`` tells which rows are left out); mean and covariance are those of the
    distinct ones, divided by their number ``n``. Components are unit eigenvectors, from 1 on by falling
    eigenvalue, their signs free; equal eigenvalues have any basis of their space. ``deviation`` is the sum
    over dimensions of (n x - S)^2, null beyond 64 bits; ``whitened`` the projection over the root of the eigenvalue;
    ``explained`` the eigenvalue's share of all; ``identity_error`` the largest entry by which the
    covariance of whitened distinct vectors differs from the identity.

    Rows with null or repeated keys have their own results, equal vectors the same ones; other columns
    play no part. Without two different vectors there is no component and no row. What the
    driver holds depends on the dimension alone.
    """
    rows = written(integer_vectors(df, key, vector), "vectors")
    kind = rows.schema["key"].dataType.simpleString()
    model = fit(rows, components, steps)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(model.sums))
            y = model.project(x)
            bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * y.shape[1])
            listed = pa.ListArray.from_arrays(bounds, pa.array(y.ravel()))
            columns = [batch.column(0), pa.array(_deviations(x, model.n, model.sums), pa.int64()), listed]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "deviation", "y"])

    schema = f"key {kind}, deviation long, y array<double>"
    found = model is not None and len(model.eigenvalues)
    placed = rows.mapInArrow(work, schema) if found else df.sparkSession.createDataFrame([], schema)
    shares = (model.eigenvalues / model.trace).tolist() if found else []
    explained = F.array(*[F.lit(float(s)) for s in shares]).cast("array<double>")
    return placed.select("key", "deviation", F.posexplode("y").alias("at", "whitened")).select(
        F.col("key").alias(key),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if found else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error if found else 0.0).alias("identity_error"),
    )
