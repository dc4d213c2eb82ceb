"""Regression forests grown from histograms: every split is decided by an exact aggregate over all rows.

Features are cut into bins at their exact quantiles. A level of all trees is one pass: each task adds up the rows of every (tree, node,
feature, bin), one ``groupBy`` adds up the tasks, and a window over the bins of a feature gives the gain of every cut. Targets are summed
as whole numbers in fixed point, so that neither the number of tasks nor their order changes a split. Only the chosen cuts reach the
driver: at most ``trees * 2 ** depth`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.quantiles import quantiles

BINS = 32
# Steps between the smallest and the largest target in fixed point. Whole sums stay exact up to 2 ** 40 rows of a node.
STEPS = 1 << 21
# Counters that a task may hold for a level; beyond it a task hands on the counters of each batch.
DENSE = 4_000_000
# Chances that a row is drawn 0, 1, 2, ... times, when as many rows are drawn as there are.
DRAWN = np.cumsum([0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.06131324019524039, 0.015328310048810098, 0.0030656620097620196])


@dataclass
class Forest:
    """Per tree and node (children of n: 2n, 2n + 1): the feature (-1: a leaf), the last bin that goes left, and the mean target."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def binned(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x, side="left") for e, x in zip(self.edges, columns)])

    def nodes(self, tree: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of every row after so many levels; rows stay at a leaf."""
        node = np.ones(bins.shape[1], dtype=np.int64)
        rows = np.arange(bins.shape[1])
        for _ in range(levels):
            f = self.feature[tree, node]
            right = bins[np.maximum(f, 0), rows] > self.cut[tree, node]
            node = np.where(f >= 0, 2 * node + right, node)
        return node


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, np.ndarray]:
    """Different inner quantiles of each column, by its present values. A value belongs to the bin of the first edge that is not below it."""
    found: dict[str, list[float]] = {c: [] for c in columns}
    for r in quantiles(df, columns, [i / bins for i in range(1, bins)]).select("column", "quantile").collect():
        found[r["column"]].append(r["quantile"])
    return {c: np.unique(np.array([v for v in vs if v is not None], dtype=float)) for c, vs in found.items()}


def times_drawn(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row, by the row's hash alone: a mixed hash against the chances of 0, 1, 2, ... draws."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % 2**32) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(DRAWN, (x >> np.uint64(11)) / float(1 << 53), side="right")


def _tally(forest: Forest, trees: int, level: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counters of one level over batches of (hash, target, fixed-point target, features ...)."""
    first, width = 1 << level, max(len(e) + 1 for e in forest.edges)
    inputs = len(forest.edges)
    cells = trees * first * inputs * width

    def out(keys: np.ndarray, sums: Sequence[np.ndarray]) -> pa.RecordBatch:
        rest, bin_ = np.divmod(keys, width)
        rest, feature = np.divmod(rest, inputs)
        tree, node = np.divmod(rest, first)
        ints = [tree, node + first, feature, bin_, np.rint(sums[0]), np.rint(sums[1])]
        return pa.RecordBatch.from_arrays(
            [*[pa.array(v.astype(np.int64)) for v in ints], pa.array(sums[2])], names=["tree", "node", "feature", "bin", "w", "q", "y"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts and fixed-point sums of a task stay below 2 ** 53, so adding them as doubles is exact.
        held = [np.zeros(cells) for _ in range(3)] if cells <= DENSE else None
        for batch in batches:
            hashes, y, q, *columns = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            bins = forest.binned(columns)
            for tree in range(trees):
                node = forest.nodes(tree, bins, level)
                w = np.ones(len(y), dtype=np.int64) if trees == 1 else times_drawn(hashes, tree, seed)
                use = (node >= first) & (w > 0)
                place = (tree * first + node[use] - first) * inputs
                keys = np.concatenate([(place + f) * width + bins[f, use] for f in range(inputs)])
                sums = [np.tile(v[use] * w[use], inputs).astype(float) for v in (np.ones(len(y)), q, y)]
                if held is None:
                    some, where = np.unique(keys, return_inverse=True)
                    yield out(some, [np.bincount(where, weights=s, minlength=len(some)) for s in sums])
                else:
                    own = slice(tree * first * inputs * width, (tree + 1) * first * inputs * width)
                    for total, s in zip(held, sums):
                        total[own] += np.bincount(keys - own.start, weights=s, minlength=own.stop - own.start)
        if held is not None:
            some = np.flatnonzero(held[0])
            yield out(some, [total[some] for total in held])

    return run


def _best_cuts(counters: DataFrame) -> DataFrame:
    """Per tree and node: rows, target sum, and the cut that gains most (ties: the first feature, then the lowest bin), if any gains."""
    summed = counters.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("w", "q", "y")])
    group = Window.partitionBy("tree", "node", "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cuts = summed.select(
        "tree", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"l{c}") for c in ("w", "q", "y")],
        *[F.sum(c).over(group).alias(f"a{c}") for c in ("w", "q", "y")],
    )
    square = lambda q, w: q.cast("double") * q.cast("double") / w.cast("double")
    lw, lq, aw, aq = (F.col(c) for c in ("lw", "lq", "aw", "aq"))
    gain = square(lq, lw) + square(aq - lq, aw - lw) - square(aq, aw)
    # A split has to gain more than one squared step a row; below that, only rounding would decide.
    gain = F.when(lw < aw, F.when(gain > aw.cast("double"), gain))
    best = F.min(F.when(gain.isNotNull(), F.struct((-gain).alias("g"), "feature", "bin", "lw", "ly"))).alias("best")
    return cuts.groupBy("tree", "node").agg(F.max("aw").alias("w"), F.max_by("ay", F.struct(-F.col("feature"), F.col("bin"))).alias("y"), best)


def grow(
    df: DataFrame, target: str, inputs: Sequence[str], edges: dict[str, np.ndarray], row_hash: str, trees: int, depth: int, seed: int,
) -> Forest:
    """A forest that predicts ``target`` from ``inputs``, all numbers without nulls.

    With several trees each draws its rows with repetition, by ``row_hash``; a single tree takes every row once.
    """
    size = 1 << (depth + 1)
    forest = Forest([edges[c] for c in inputs], np.full((trees, size), -1), np.zeros((trees, size), dtype=np.int64), np.zeros((trees, size)))
    y = F.col(target)
    low, high, mean = df.agg(F.min(y), F.max(y), F.avg(y)).first()
    forest.value[:] = 0.0 if mean is None else mean
    if low is None or not low < high or not inputs:
        return forest
    q = F.floor((y - low) / (high - low) * STEPS).cast("long") - STEPS // 2
    rows = df.select(row_hash, y.alias("_y"), q.alias("_q"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(inputs)])
    for level in range(depth):
        counters = rows.mapInArrow(_tally(forest, trees, level, seed), "tree long, node long, feature long, bin long, w long, q long, y double")
        grown = False
        for r in _best_cuts(counters).collect():
            t, n, best = r["tree"], r["node"], r["best"]
            if level == 0:
                forest.value[t, n] = r["y"] / r["w"]
            if best is not None:
                grown = True
                forest.feature[t, n], forest.cut[t, n] = best["feature"], best["bin"]
                forest.value[t, 2 * n] = best["ly"] / best["lw"]
                forest.value[t, 2 * n + 1] = (r["y"] - best["ly"]) / (r["w"] - best["lw"])
        if not grown:
            break
    return forest


def predict(forest: Forest, inputs: Sequence[str]) -> Column:
    """The mean of the trees' predictions as a column. Only ``inputs`` pass to Python."""
    trees, size = forest.feature.shape
    levels = size.bit_length() - 2

    @F.pandas_udf("double")
    def run(columns: pd.DataFrame) -> pd.Series:
        bins = forest.binned([columns[c].to_numpy(dtype=float) for c in columns])
        return pd.Series(sum(forest.value[t, forest.nodes(t, bins, levels)] for t in range(trees)) / trees)

    return run(F.struct(*[F.col(c).alias(f"_x{i}") for i, c in enumerate(inputs)]))
