"""Whitening of embeddings (operator 13): blockwise QR of the centred rows, then a bidiagonal qd solver on the small factor.

Entries become whole numbers (floor of 256 times the value), so sums, duplicates and deviations are exact. Every different vector counts once
in the fit. Tasks reduce their centred rows block by block to a triangular factor; factors are stacked and reduced again in rounds until one
of dimensions x dimensions is left, which is all that reaches the driver. Its right singular vectors are the components, and its squared
singular values divided by the number of vectors are the variances. The rows are never multiplied with each other, so small
variances keep their accuracy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.plans.lineage import settle

from .batches import map_batches
from .bidiagonal import right_vectors

SCALE = 256
LARGEST = float(1 << 62)  # entries beyond this, scaled, do not fit and make a vector unusable
FAN_IN = 16  # factors that one task stacks


@dataclass(frozen=True)
class Whitening:
    """A fit: ``sums`` over the ``n`` different vectors, variances and components (as columns) by falling variance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0


def whole_numbers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(_id, _x): the usable vectors as whole numbers.

    Vectors that are null, empty, or hold a null, a non-finite entry or one too large for a long are left out. All vectors are expected to have one
    length; the most common one is taken (the largest of those that tie), others are left out.
    """
    vector = F.col(vector_col)
    usable = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * SCALE) >= LARGEST))
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    kept = rows.select(F.col(id_col).alias("_id"), vector).filter(usable).select("_id", x.alias("_x"))
    lengths = rows.select(vector).filter(usable).groupBy(F.size(vector).alias("d")).count()
    best = lengths.agg(F.max(F.struct("count", "d"))).first()[0]
    return kept.filter(F.size("_x") == (best["d"] if best else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fits(n: int, sums: list[int], x: np.ndarray) -> bool:
    return n * int(max(x.max(), -x.min())) + max(map(abs, sums)) < 1 << 62


def centred(n: int, sums: list[int], x: np.ndarray) -> np.ndarray:
    """n * x - S, exact: as longs where they fit, else as Python integers."""
    if _fits(n, sums, x):
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(shifted: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row; None where one does not fit a long."""
    top = int(max(abs(shifted.max()), abs(shifted.min())))
    if top * top * shifted.shape[1] < 1 << 63:
        return (shifted.astype(np.int64) ** 2).sum(axis=1).tolist()
    found = (sum(int(v) ** 2 for v in row) for row in shifted)
    return [v if v < 1 << 63 else None for v in found]


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension. Longs are summed in two halves, so no sum overflows."""

    def run(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch.column(0))
        high = x >> 31
        return {"dim": np.arange(x.shape[1]), "rows": np.full(x.shape[1], len(x)), "high": high.sum(axis=0), "low": (x - (high << 31)).sum(axis=0)}

    parts = map_batches(fit.select("_x"), run, "dim int, rows bigint, high bigint, low bigint")
    total = parts.groupBy("dim").agg(F.sum("rows").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("h"), F.sum(F.col("low").cast("decimal(38,0)")).alias("l"))
    found = total.orderBy("dim").collect()  # one row per dimension
    return (found[0]["n"] if found else 0), [(int(r["h"]) << 31) + int(r["l"]) for r in found]


def _factors(df: DataFrame, block: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """One triangular factor per task: the factor so far is stacked on each block and reduced again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                rows = block(batch)
                r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["r"])

    return df.mapInArrow(run, "r binary")


def triangular_factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows x - S/n, square, with R'R = n times their covariance."""
    d = len(sums)

    def unpack(batch: pa.RecordBatch) -> np.ndarray:
        return np.vstack([np.frombuffer(v.as_buffer(), "<f8").reshape(-1, d) for v in batch.column(0)])

    factors = settle(_factors(fit.select("_x"), lambda b: centred(n, sums, _matrix(b.column(0))).astype(float) / n))
    parts = factors.count()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        factors = _factors(factors.repartition(parts), unpack)
    found = np.frombuffer(factors.first()["r"], "<f8").reshape(-1, d)
    return np.vstack([found, np.zeros((d - len(found), d))]) if len(found) < d else found


def fit(numbers: DataFrame, most: int = 4) -> Whitening:
    """Fit on every different vector of ``numbers`` once. Components without variance are left out."""
    distinct = settle(numbers.select("_x").distinct())
    n, sums = column_sums(distinct)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    r = triangular_factor(distinct, n, sums)
    squares, vectors = right_vectors(r, most)
    found = Whitening(n, sums, squares / n, vectors, float((r**2).sum()) / n)
    return Whitening(n, sums, found.variances, found.components, found.trace, identity_error(distinct, found))


def project(model: Whitening, shifted: np.ndarray) -> np.ndarray:
    """Whitened coordinates of rows given as n * x - S."""
    return (shifted.astype(float) / model.n) @ (model.components / np.sqrt(model.variances))


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened covariance minus the identity, over the fit list.

    Every batch gives its number of rows, its mean and its centred products; these are combined without forming sums of squares.
    """
    k = len(model.variances)
    if not k:
        return 0.0

    def run(batch: pa.RecordBatch) -> dict:
        w = project(model, centred(model.n, model.sums, _matrix(batch.column(0))))
        mean = w.mean(axis=0)
        return {"rows": [len(w)], "mean": [mean.tolist()], "products": [((w - mean).T @ (w - mean)).ravel().tolist()]}

    parts = map_batches(distinct.select("_x"), run, "rows bigint, mean array<double>, products array<double>")
    rows = parts.withColumn("_part", F.spark_partition_id())
    # k + k * k sums per pair of columns: the grand mean first, then products around it.
    mean = rows.agg(F.sum("rows").alias("n"), *[F.sum(F.col("rows") * F.col("mean")[i]).alias(f"m{i}") for i in range(k)]).first()
    centre = [mean[f"m{i}"] / mean["n"] for i in range(k)]

    def entry(i: int, j: int) -> Column:
        return F.sum(F.col("products")[i * k + j] + F.col("rows") * (F.col("mean")[i] - centre[i]) * (F.col("mean")[j] - centre[j]))

    cov = rows.agg(*[entry(i, j).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]).first()
    return max(abs(cov[f"c{i}_{j}"] / mean["n"] - (i == j)) for i in range(k) for j in range(k))


def transform(numbers: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Null and repeated ids come back as they are, and repeated vectors get equal values. Where all vectors are equal, or the table is empty,
    there is no component and no row. A deviation that does not fit a long is null.
    """
    k = len(model.variances)
    explained = (model.variances / model.trace).tolist() if k else []

    def run(batch: pa.RecordBatch) -> dict:
        shifted = centred(model.n, model.sums, _matrix(batch.column(1)))
        b = len(shifted)
        each = np.repeat(np.arange(b), k)
        return {
            "id": batch.column(0).take(pa.array(each)), "component": np.tile(np.arange(1, k + 1), b), "n": np.full(b * k, model.n),
            "deviation": pa.array(deviations(shifted), pa.int64()).take(pa.array(each)), "whitened": project(model, shifted).ravel(),
            "explained": np.tile(explained, b), "identity_error": np.full(b * k, model.identity_error),
        }

    kind = dict(numbers.dtypes)["_id"]
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = numbers if k else numbers.limit(0)
    return map_batches(rows.select("_id", "_x"), run, schema).withColumnRenamed("id", id_col)


def whiten(rows: DataFrame, most: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit on the usable vectors and transform all of them."""
    numbers = whole_numbers(rows, id_col, vector_col)
    return transform(numbers, fit(numbers, most), id_col)
