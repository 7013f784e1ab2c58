"""Embedding whitening by matrix-free block Lanczos with full reorthogonalisation.

The covariance is never built: a pass over the rows multiplies it with a block of vectors, as the sum of
(x - mean) ((x - mean) . block) over all rows, added up in the tasks first. The driver holds blocks of
vectors only, as high as an embedding is long. A block whose columns break down restarts with random
directions, and the passes end once the residuals of all wanted components are at rounding level and stay so
after a block of random directions, or the whole space is spanned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, materialize

#: Components, vectors of a block, and the residual, as a share of the greatest eigenvalue, that counts as none.
COMPONENTS, BLOCK, TOLERANCE, SEED = 32, 16, 1e-13, 12
#: Entries are counted in steps of 1 / SCALE from -SHIFT / SCALE.
SCALE, SHIFT = 64, 1_000_000


def finite(vector: Column) -> Column:
    """Not null, not without entries, and every entry a finite number."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & (F.size(vector) > 0)


def _added(rows: DataFrame, column: str, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all batches of part(matrix of the column's arrays), each of this shape; tasks add up first, then a shuffle by row number."""
    height, width = shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                mine = part(np.stack(pdf[column].to_numpy()))
                total = mine if total is None else total + mine
        if total is not None:
            yield pd.DataFrame({"i": np.arange(height, dtype=np.int32)} | {f"v{k}": total[:, k] for k in range(width)})

    names = [f"v{k}" for k in range(width)]
    partial = rows.select(column).mapInPandas(run, ", ".join(["i int", *(f"{n} {kind}" for n in names)]))
    got = partial.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).toPandas().sort_values("i")
    return got[names].to_numpy() if len(got) else np.zeros(shape)


def _orthonormal(fresh: np.ndarray, basis: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """`count` columns that span the fresh ones besides the basis; random directions in place of those that break down."""
    got = basis
    for k in range(count):
        v = fresh[:, k]
        while True:
            size = np.linalg.norm(v)
            w = v / size if size > 0 else v
            for _ in range(3):
                w = w - got @ (got.T @ w)
            left = np.linalg.norm(w)
            if left > 1e-10:
                break
            v = rng.normal(size=len(v))
        w = w / left
        got = np.c_[got, w - got @ (got.T @ w)]
        got[:, -1] /= np.linalg.norm(got[:, -1])
    return got[:, basis.shape[1] :]


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The greatest `wanted` eigenvalues, falling, and their unit vectors of the symmetric matrix that `multiply` applies to a block."""
    rng = np.random.default_rng(seed)
    basis = image = np.zeros((dim, 0))
    fresh, settled = rng.normal(size=(dim, block)), None
    while True:
        new = _orthonormal(fresh, basis, min(block, dim - basis.shape[1]), rng)
        basis, image = np.c_[basis, new], np.c_[image, multiply(new)]
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        top, vectors = values[:wanted], basis @ turn[:, :wanted]
        if basis.shape[1] == dim:
            return top, vectors
        bound = tolerance * max(abs(values[0]), np.finfo(float).tiny)
        fresh = image[:, -block:]
        if len(top) == wanted and np.linalg.norm(image @ turn[:, :wanted] - vectors * top, axis=0).max() <= bound:
            # A block finds as many copies of one eigenvalue as it has vectors: random directions would show others.
            if settled is not None and np.abs(settled - top).max() <= 10 * bound:
                return top, vectors
            settled, fresh = top, rng.normal(size=(dim, block))


def whiten(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries c become x = floor(64 c) + 1000000; x's covariance (divisor n) has the components, numbered from 1
    by falling eigenvalue. Rows whose vector is null, has no entries, or holds null or non-finite ones take no
    part, all others do, repeated ones and those without an id too. Fewer components come out where the
    covariance's rank is less: a direction without variance can't be whitened; with no rows, one row or equal
    rows there is none. Vectors of different lengths raise ValueError; a deviation beyond 64 bits raises
    Spark's overflow error. Of equal eigenvalues any basis may come out, the same for all rows. Other columns
    are not read.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    vec = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec")).where(finite(F.col("vec")))
    xs = materialize(vec.select("vec_id", F.transform("vec", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x")), "steps")
    n, dim, longest = xs.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not n:
        return empty
    if dim != longest:
        raise ValueError(f"vectors of {dim} and of {longest} entries can't be whitened together")
    sums = [int(s) for s in _added(xs, "x", (dim, 1), lambda m: m.sum(0)[:, None], "long")[:, 0]]
    # The mean in two parts, so that subtracting it loses nothing.
    steps, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    centred = lambda m: (m - steps).astype(np.float64) - rest

    def multiply(block: np.ndarray) -> np.ndarray:
        def part(m: np.ndarray) -> np.ndarray:
            c = centred(m)
            return c.T @ (c @ block)

        return _added(xs, "x", block.shape, part) / n

    values, vectors = block_lanczos(multiply, dim, min(components, dim))
    usable = values > values[0] * dim * 64 * np.finfo(float).eps if values[0] > 0 else np.zeros(len(values), bool)
    values, vectors = values[usable], vectors[:, usable]
    if not len(values):
        return empty
    scaled = vectors / np.sqrt(values)

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(centred(np.stack(x.to_numpy())) @ scaled) if len(x) else [], dtype=object)

    total = F.array(*[F.lit(s).cast("long") for s in sums])
    deviation = F.aggregate(F.transform(F.arrays_zip(F.col("x"), total.alias("s")), lambda z: n * z["x"] - z["s"]), F.lit(0).cast("long"), lambda acc, d: acc + d * d)
    white = materialize(xs.select("vec_id", deviation.alias("deviation"), project("x").alias("y")), "whitened")
    k = len(values)
    mean = _added(white, "y", (k, 1), lambda m: m.sum(0)[:, None])[:, 0] / n
    covariance = _added(white, "y", (k, k), lambda m: (m - mean).T @ (m - mean)) / n
    trace = white.agg(F.sum(F.col("deviation").cast("double"))).first()[0] / float(n) ** 3
    shares = F.array(*[F.lit(float(e / trace)) for e in values])
    out = white.select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(float(np.abs(covariance - np.eye(k)).max())).alias("identity_error"),
    )
