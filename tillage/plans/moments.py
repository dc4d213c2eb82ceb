"""Co-moments of many columns over the rows where both are present, in one scan and few bytes per task.

Every batch gives, for each pair of columns, the number of rows with both, the mean of the first over these rows, the sum of its squared
deviations and the sum of the products of both deviations: four square matrices, made by matrix products of values and presence masks.
Two such partials are combined exactly as moments are, by their means' difference; each task leaves one, and rounds of a few per task combine those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle

FAN_IN = 16  # partials that one task combines


@dataclass
class Moments:
    """Per pair (i, j): rows with both, mean of i, squared deviations of i, products of the deviations of i and j."""

    n: np.ndarray
    mean: np.ndarray
    squares: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> Moments:
        """Rows of values with NaN where missing."""
        present = ~np.isnan(values)
        counts = present.sum(axis=0)
        x = np.where(present, values, 0.0)
        low, high = np.where(present, values, np.inf).min(axis=0), np.where(present, values, -np.inf).max(axis=0)
        middle = np.where(low == high, low, x.sum(axis=0) / np.maximum(counts, 1))  # a constant column is centred without rounding
        middle = np.where(counts > 0, middle, 0.0)
        x = np.where(present, values - middle, 0.0)
        mask = present.astype(float)
        n = mask.T @ mask
        some = np.maximum(n, 1.0)
        sums, squares = x.T @ mask, (x * x).T @ mask
        own = squares - sums * sums / some
        own[own <= 1e-13 * squares] = 0.0  # what rounding leaves of a column that is constant over the shared rows
        return Moments(n, middle[:, None] + sums / some, own, x.T @ x - sums * sums.T / some)

    def add(self, other: Moments) -> Moments:
        n = self.n + other.n
        some = np.maximum(n, 1.0)
        apart = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        share = self.n * other.n / some
        mean = np.where(self.n > 0, self.mean, other.mean) + apart * np.where(self.n > 0, other.n, 0.0) / some
        return Moments(n, mean, self.squares + other.squares + apart * apart * share, self.products + other.products + apart * apart.T * share)

    def pack(self) -> bytes:
        return np.stack([self.n, self.mean, self.squares, self.products]).astype("<f8").tobytes()

    @staticmethod
    def unpack(data: bytes, columns: int) -> Moments:
        return Moments(*np.frombuffer(data, "<f8").reshape(4, columns, columns))

    def correlation(self) -> np.ndarray:
        """Pearson correlation; NaN where a column does not vary over the shared rows."""
        own = np.abs(np.diag(self.mean)) + np.sqrt(np.diag(self.squares) / np.maximum(np.diag(self.n), 1.0))
        scale = np.abs(self.mean) + own[:, None]  # the size of the numbers that were rounded
        still = self.squares <= self.n * (16 * np.finfo(float).eps * scale) ** 2
        spread = np.sqrt(np.where(still, np.nan, self.squares))
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.products / (spread * spread.T)


def _partials(df: DataFrame, columns: int, read: Callable[[pa.RecordBatch], list[Moments]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                for part in read(batch):
                    total = part if total is None else total.add(part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.pack()], pa.binary())], names=["m"])

    return df.mapInArrow(run, "m binary")


def pair_moments(df: DataFrame, columns: Sequence[str]) -> Moments | None:
    """The moments of all pairs of the given numeric columns; None for an empty table. Columns x columns numbers reach the driver."""
    d = len(columns)
    rows = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(columns)])

    def values(batch: pa.RecordBatch) -> list[Moments]:
        return [Moments.of(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))]

    parts = settle(_partials(rows, d, values))
    count = parts.count()
    while count > 1:
        count = -(-count // FAN_IN)
        parts = _partials(parts.repartition(count), d, lambda b: [Moments.unpack(v.as_py(), d) for v in b.column(0)])
    found = parts.first()
    return Moments.unpack(bytes(found["m"]), d) if found else None
