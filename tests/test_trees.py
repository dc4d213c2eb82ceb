"""Forests grown from histograms, beside a plain version that looks at the rows of each node."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.operators import model_impute, trees


def plain_tree(bins, y, w, depth):
    """Predictions of one tree for every row, split by split; the same rule without histograms."""
    low, high = y.min(), y.max()
    q = np.floor((y - low) / (high - low) * trees.STEPS) - trees.STEPS // 2
    out = np.zeros(len(y))

    def split(rows, left):
        use = rows & (w > 0)
        out[rows] = (y[use] * w[use]).sum() / w[use].sum()
        if not left:
            return
        best = None
        for f in range(len(bins)):
            for cut in np.unique(bins[f][use])[:-1]:
                l, r = use & (bins[f] <= cut), use & (bins[f] > cut)
                part = lambda m: (q[m] * w[m]).sum() ** 2 / w[m].sum()
                gain = part(l) + part(r) - part(use)
                if gain > w[use].sum() and (best is None or gain > best[0]):
                    best = gain, f, cut
        if best:
            split(rows & (bins[best[1]] <= best[2]), left - 1)
            split(rows & (bins[best[1]] > best[2]), left - 1)

    split(np.ones(len(y), dtype=bool), depth)
    return out


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, float(i % 37), float(i * i % 101), float(3 * (i % 37) + (i * i % 101 > 50) * 40 + i % 3)) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double").repartition(5).withColumn("h", F.xxhash64("id")).cache()


@pytest.mark.parametrize(("count", "dense"), [(1, True), (3, True), (3, False)])
def test_forest_equals_plain_version(points, monkeypatch, count, dense):
    if not dense:
        monkeypatch.setattr(trees, "DENSE", 0)
    edges = trees.bin_edges(points, ["a", "b"])
    forest = trees.grow(points, "y", ["a", "b"], edges, "h", count, 4, 7)
    rows = points.select("*", trees.predict(forest, ["a", "b"]).alias("p")).toPandas()
    bins = forest.binned([rows["a"].to_numpy(), rows["b"].to_numpy()])
    want = 0
    for t in range(count):
        w = np.ones(len(rows), dtype=int) if count == 1 else trees.times_drawn(rows["h"].to_numpy(), t, 7)
        want = want + plain_tree(bins, rows["y"].to_numpy(), w, 4) / count
    assert np.allclose(rows["p"], want, rtol=1e-9)


def test_draws_are_even():
    drawn = np.stack([trees.times_drawn(np.arange(50_000, dtype=np.int64) - 25_000, t, 42) for t in range(4)])
    assert abs(drawn.mean() - 1) < 0.02 and abs((drawn == 0).mean() - 0.3679) < 0.01
    assert not (drawn[0] == drawn[1]).all()


def test_splits_do_not_depend_on_partitions(points):
    edges = trees.bin_edges(points, ["a", "b"])
    one, many = (trees.grow(points.repartition(n), "y", ["a", "b"], edges, "h", 2, 4, 1) for n in (1, 9))
    assert (one.feature == many.feature).all() and (one.cut == many.cut).all()


def test_hidden_cells_are_predicted_better_than_by_the_mean(points):
    gaps = points.select("id", "a", "b", F.when(F.col("id") % 6 != 0, F.col("y")).alias("y"))
    both = model_impute.fill_model(gaps, "y", ["a", "b", "y"]).select("id", F.col("y").alias("filled")).join(points, "id").filter(F.col("id") % 6 == 0).toPandas()
    assert np.abs(both["filled"] - both["y"]).mean() < 0.15 * np.abs(both["y"] - both["y"].mean()).mean()


def test_columns_with_gaps_in_turn(points):
    gaps = points.select("id", F.when(F.col("id") % 5 != 1, F.col("a")).alias("a"), "b", F.when(F.col("id") % 6 != 0, F.col("y")).alias("y"))
    filled = model_impute.fill_model(gaps, "y", ["a", "b", "y"], rounds=2, trees=2, depth=4)
    assert filled.columns == gaps.columns
    assert filled.filter(F.col("y").isNull()).count() == 0 and filled.filter(F.col("a").isNull()).count() == 300


def test_constant_and_empty_targets(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, None), (4.0, 5.0)], "a double, y double")
    assert [r["y"] for r in model_impute.fill_model(df, "y").orderBy("a").collect()] == [5.0] * 4
    assert model_impute.fill_model(df.limit(0), "y").count() == 0
