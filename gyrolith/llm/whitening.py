"""Whitening of embeddings along their principal components, found by LOBPCG.

Vectors of whole numbers give exact sums over all rows; every row is centred as (n x - S) / n, whose numerator is exact, before anything
is multiplied. The covariance itself is never formed: each step sends a block of at most three parts (the iterate, its residuals
and the last directions, orthonormal) to the rows, which return the covariance's product with it, partition by
partition and merged in a tree. Rayleigh-Ritz on the block gives the next iterate, and, as the product is fresh, residuals that hold
for the covariance itself: the search ends when each wanted component's residual is below TOLERANCE times the largest
eigenvalue, and raises an error if it doesn't get there.

The driver holds blocks of (length of a vector) x (3 BLOCK) numbers, whatever the number of rows. Every pass reads the written table of
vectors anew, so a lost executor costs its tasks only.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, as are empty vectors; repeated rows count
each; rows without id take part and keep their null; vectors of each length are whitened by themselves. A component whose eigenvalue is not above
FLAT times the largest has no direction to speak of (a constant dimension, or fewer rows than dimensions) and is not
returned, so equal vectors give no rows. A deviation that no long can hold is null. Entries are whole numbers below 2 ** 53 in magnitude;
beyond, an error says so. Columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.llm.common import shared_folder, written

#: Components wanted at most, columns of the iterate, largest residual (of the largest eigenvalue), least eigenvalue (likewise), and steps at most.
COMPONENTS, BLOCK, TOLERANCE, FLAT, STEPS = 32, 40, 1e-13, 1e-12, 1000
#: Parts that a node of the tree of sums adds up.
WIDTH = 32
SEED = 23

LONG = (1 << 63) - 1


def rows_of(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dim)


def gathered(rows: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of `part`(vectors of a batch) over all rows: within tasks, then in a tree, and at last over WIDTH parts here."""

    def within(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(rows_of(batch, dim))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId()], pa.int32()), "data": pa.array([pickle.dumps(total, 5)], pa.binary())})

    def together(table: pa.Table) -> pa.Table:
        total = reduce(np.add, (pickle.loads(x.as_py()) for x in table["data"]))
        return pa.table({"k": table["k"].slice(0, 1), "data": pa.array([pickle.dumps(total, 5)], pa.binary())})

    parts = rows.select("x").mapInArrow(within, "k int, data binary")
    tasks = len(rows.inputFiles())
    while tasks > WIDTH:
        tasks = -(-tasks // WIDTH)
        parts = parts.withColumn("k", F.col("k") % tasks).groupBy("k").applyInArrow(together, "k int, data binary")
    return reduce(np.add, (pickle.loads(r["data"]) for r in parts.collect()))


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: in longs where these hold it, else in Python's integers."""
    if n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0) > LONG:
        x, sums = x.astype(object), np.array(sums, object)
    return x * n - np.array(sums)


def deviations(d: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly."""
    most = int(np.abs(d).max(initial=0))
    if most * most * d.shape[1] > LONG:
        return [s if s <= LONG else None for s in (d.astype(object) ** 2).sum(1).tolist()]
    return (d * d).sum(1).tolist()


def independent(basis: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The basis, and orthonormal directions of `more` that it lacks."""
    if basis.shape[1]:
        for _ in range(2):
            more = more - basis @ (basis.T @ more)
            size = np.linalg.norm(more, axis=0)
            more = more[:, size > 0] / size[size > 0]
    if not more.shape[1]:
        return basis
    u, s, _ = np.linalg.svd(more, full_matrices=False)
    u = u[:, s > 1e-6 * s[0]][:, : len(basis) - basis.shape[1]]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(np.hstack([basis, u]))[0] if u.shape[1] else basis


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(eigenvalues, eigenvectors, largest relative residual, products) of the `wanted` largest, from products with blocks alone."""
    block = min(dim, max(block, wanted))
    basis, size = independent(np.empty((dim, 0)), np.random.default_rng(SEED).standard_normal((dim, block))), 0
    for step in range(1, steps + 1):
        image = product(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:block], turn[:, ::-1][:, :block]
        found = basis @ turn
        residual = image @ turn - found * values
        worst = np.linalg.norm(residual[:, :wanted], axis=0).max(initial=0)
        if values[0] <= 0 or worst <= tolerance * values[0]:
            return values[:wanted], found[:, :wanted], float(worst / values[0]) if values[0] > 0 else 0.0, step
        last = basis[:, size:] @ turn[size:] if size else np.empty((dim, 0))  # the new iterate's part outside the old one
        size, basis = block, np.linalg.qr(found)[0]
        basis = independent(independent(basis, residual), last)
    raise ArithmeticError(f"residuals are at {worst / values[0]:.1e} of the largest eigenvalue after {steps} products")


@dataclass
class Whitening:
    """What whitens vectors of one length: rows fitted, sums by dimension, eigenvalues with their vectors as columns, the trace, and how it was reached."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    products: int
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact differences n x - S, and the whitened rows."""
        d = differences(x, self.n, self.sums)
        return d, (d.astype(np.float64) / self.n) @ (self.vectors / np.sqrt(self.values))


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS, tolerance: float = TOLERANCE) -> Whitening | None:
    """The model of the rows (x array<long>), all of length `dim`; None for no rows."""
    n = rows.count()
    if not n:
        return None

    def totals(x):
        if int(np.abs(x).max()) >= 1 << 53:
            raise ArithmeticError("entries must be below 2 ** 53 in magnitude")
        return x.astype(object).sum(0)

    sums = gathered(rows, dim, totals).tolist()
    centred = lambda x: differences(x, n, sums).astype(np.float64) / n
    trace = float(gathered(rows, dim, lambda x: np.square(centred(x)).sum(keepdims=True))[0, 0]) / n

    def product(block):
        def part(x):
            c = centred(x)
            return c.T @ (c @ block)

        return gathered(rows, dim, part) / n

    values, vectors, residual, products = lobpcg(product, dim, min(components, dim), tolerance=tolerance)
    keep = values > FLAT * max(values[0], 0.0)
    model = Whitening(n, sums, values[keep], vectors[:, keep], trace, residual, products)
    if keep.any():

        def moments(x):
            w = model.whitened(x)[1]
            return np.vstack([w.T @ w, w.sum(0)])

        both = gathered(rows, dim, moments) / n
        model.identity_error = float(np.abs(both[:-1] - np.outer(both[-1], both[-1]) - np.eye(len(model.values))).max())
    return model


def whole(vector, scale: float, offset: int = 0):
    """floor(scale * c) + offset of each entry, in double precision; null for a vector that is null or holds null or non-finite entries."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long")))


def whiten(table: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """(key, n, deviation, whitened array<double>, explained array<double>, identity_error) of every row; vectors hold whole numbers (array<long>)."""
    rows = table.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("x"), F.size(F.col(f"`{vector}`")).alias("dim"))
    rows = written(rows.where(F.col("x").isNotNull() & (F.col("dim") > 0) & F.forall("x", lambda v: v.isNotNull())), f"{shared_folder(table.sparkSession)}/vectors")
    kind = rows.schema["id"].dataType
    schema = f"`{key}` {kind.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    found = table.sparkSession.createDataFrame([], schema)
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):
        own = rows.where(F.col("dim") == dim).select("id", "x")
        model = fit(own, dim, components)

        def run(batches, dim=dim, model=model):
            share = (model.values / model.trace).tolist()
            for batch in batches:
                d, w = model.whitened(rows_of(batch, dim))
                count = batch.num_rows
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * len(share), pa.int32()), pa.array(a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([model.n] * count, pa.int64()), pa.array(deviations(d), pa.int64()), lists(w.ravel()), lists(share * count), pa.array([model.identity_error] * count, pa.float64())],
                    [key, "n", "deviation", "whitened", "explained", "identity_error"],
                )

        if len(model.values):
            found = found.unionByName(own.mapInArrow(run, schema))
    return found


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Every embedding's first 32 whitened components, of 64ths counted from -1,000,000."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", whole(F.col("embedding"), 64.0, 1_000_000).alias("x"))
    found = whiten(rows, "vec_id", "x")
    each = F.posexplode(F.arrays_zip("whitened", "explained"))
    found = found.select("vec_id", "n", "deviation", "identity_error", each.alias("at", "c"))
    return found.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
