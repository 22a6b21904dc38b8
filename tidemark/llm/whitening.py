"""Whitening of embeddings by LOBPCG.

The covariance is never formed: each round multiplies it with a block of directions in one distributed
pass over the centred rows. A Rayleigh-Ritz step on the span of the iterate, its residuals and the
previous directions gives the next iterate, until the residuals certify the eigenpairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .vectors import matrix, packed, usable

#: A residual certifies below this share of the largest eigenvalue; rounds go on to ``AIM`` while they get
#: nearer, and end in an error after ``ROUNDS``.
TOLERANCE, AIM, ROUNDS = 1e-12, 1e-15, 500
#: Directions iterated beside those asked for; they widen the gap that convergence depends on.
GUARD = 8
SEED = 11
#: Eigenvalues below this share of the trace are no components.
LEAST = 1e-12
#: Rows of a batch that are multiplied at a time.
ROWS = 4096


def _summed(rows: DataFrame, width: int, of_rows) -> np.ndarray:
    """The sum of ``of_rows(x)``, a block of fixed shape, over all rows.

    Each task sums its rows' blocks and sends them by lines; Spark sums the lines, and the driver gets as
    many as one block has.
    """
    shape = of_rows(np.zeros((0, width), "<i8"))
    whole = np.issubdtype(shape.dtype, np.integer)

    def run(batches):
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                block = of_rows(matrix(batch.slice(lo, ROWS), width))
                total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.from_numpy_dtype(total.dtype)))], names=["line", "block"])

    lines = rows.select("vec").mapInArrow(run, f"line int, block array<{'long' if whole else 'double'}>")
    out = np.zeros_like(shape)
    for r in lines.groupBy("line").agg(*[F.sum(F.get("block", F.lit(j))).alias(f"c{j}") for j in range(shape.shape[1])]).collect():
        out[r[0]] = r[1:]
    return out


def _orthonormal(block: np.ndarray) -> np.ndarray:
    """A basis of the block's span, twice orthogonalised; directions that depend on the others go."""
    basis = np.zeros((len(block), 0))
    for v in block.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10:
            v = v / left
            v = v - basis @ (basis.T @ v)
            basis = np.column_stack([basis, v / np.linalg.norm(v)])
    return basis


def lobpcg(product, width: int, components: int, guard: int = GUARD, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(eigenvalues, eigenvectors, residual norms, rounds) of the ``components`` largest eigenpairs of the symmetric
    matrix behind ``product``, which multiplies it with a block.

    The pairs are certified: an eigenvalue lies within its residual's norm of the value given. What isn't
    certified after ``rounds`` is an error.
    """
    components = min(components, width)
    size = min(width, components + guard)
    basis = _orthonormal(np.random.default_rng(SEED).standard_normal((width, size)))
    best, worse = np.inf, 0
    for done in range(1, rounds + 1):
        times = product(basis)  # of the whole basis: nothing is carried on, so errors don't add up
        small = basis.T @ times
        values, coords = np.linalg.eigh((small + small.T) / 2)
        values, coords = values[::-1][:size], coords[:, ::-1][:, :size]
        iterate, image = basis @ coords, times @ coords
        residual = image - iterate * values
        norms = np.linalg.norm(residual[:, :components], axis=0)
        scale = max(values[0], np.finfo(float).tiny)
        worst = norms.max() / scale
        worse = 0 if worst < 0.98 * best else worse + 1
        if worst < best:
            best, kept = worst, (values[:components], iterate[:, :components], norms)
        if worst <= AIM or (best <= TOLERANCE and worse >= 4) or values[0] <= 0:
            return *kept, done
        # What the round added to the iterate: the columns of the basis after the first come from residuals and steps.
        step = basis[:, size:] @ coords[size:]
        basis = _orthonormal(np.column_stack([iterate, residual, step]))
    if best <= TOLERANCE:
        return *kept, rounds
    raise RuntimeError(f"no certified eigenpairs after {rounds} rounds: residual {best:.1e} of the largest eigenvalue")


def whiten(rows: DataFrame, entries: Column, components: int = 8, id_col: str = "vec_id") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): the rows of ``rows`` projected on the
    largest principal components of all of them, each with variance 1.

    ``entries`` is an array of long, without nulls; rows where it is null are dropped. All other rows count,
    repeated ones and null ids too, and come out once for each component; of equal eigenvalues any basis of
    their space is taken. Components without variance are left out, so a table of equal rows, like an empty
    one, gives an empty result. Vectors of several lengths are an error, and so is a deviation beyond a long.
    Other columns aren't read. The driver holds blocks as wide as three times components and guard, never rows.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    usable_rows = rows.select(F.col(f"`{id_col}`").alias("id"), entries.alias("entries")).where(F.col("entries").isNotNull())
    data, width = packed(usable_rows, "entries", "whitening")
    none = rows.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {SCHEMA}")
    if not width:
        return none
    n = data.count()
    total = _summed(data, width, lambda x: x.sum(axis=0, dtype="int64")[:, None])[:, 0]

    def centred(x):
        return (n * x - total) / n  # n * x - total is exact

    trace = _summed(data, width, lambda x: (centred(x) ** 2).sum(axis=0)[:, None]).sum() / n

    def product(block):
        def of_rows(x):
            c = centred(x)
            return c.T @ (c @ block)

        return _summed(data, width, of_rows) / n

    values, vectors, _, _ = lobpcg(product, width, components)
    found = int((values > LEAST * trace).sum()) if trace > 0 else 0
    if not found:
        return none
    values, vectors = values[:found], vectors[:, :found]
    scaled = vectors / np.sqrt(values)

    def moments(x):
        w = centred(x) @ scaled
        return np.vstack([w.sum(axis=0), w.T @ w])

    sums = _summed(data, width, moments) / n
    identity_error = float(np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(found)).max())
    explained = values / trace

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = matrix(part, width)
                apart = n * x - total
                if (apart.astype(float) ** 2).sum(axis=1).max(initial=0) > 9.2e18:
                    raise OverflowError("a deviation doesn't fit a long")
                again = np.repeat(np.arange(len(x)), found)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, found + 1, dtype="int32"), len(x))), pa.array(np.full(len(again), n)), pa.array((apart**2).sum(axis=1)[again]),
                        pa.array(((apart / n) @ scaled).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(again), identity_error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return data.select("id", "vec").mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """All usable rows of ``embeddings``, projected on the first eight components of their covariance."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vector = F.col("embedding").cast("array<double>")
    return whiten(rows, F.when(usable(vector), F.transform(vector, lambda c: F.floor(c * 1024.0) + 100000)))
