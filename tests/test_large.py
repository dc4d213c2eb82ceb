"""Operators on inputs that once cost a plan, a round or a row per pair."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.operators import chartdata, imagecopies
from tillage.plans import groups, lineage, moments


def test_many_columns_correlate_as_few(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n, d = 700, 14
    x = rng.standard_normal((n, d)) * np.geomspace(1e-3, 1e6, d) + np.geomspace(1, 1e8, d)
    x[:, 3] = 0.1
    x[:, 5] = x[:, 4] * -2 + 7
    rows = [[None if rng.random() < 0.2 and j > 1 else float(x[i, j]) for j in range(d)] for i in range(n)]
    for i, r in enumerate(rows):
        r[6] = 0.3 if i % 2 else (None if i % 3 else float(i))
        r[7] = None if not i % 2 else float(i % 11)  # over the rows it shares, the sixth column is constant
        r[8] = None
    df = spark.createDataFrame(rows, ", ".join(f"k{i} double" for i in range(d))).repartition(9)
    for undefined in (None, 0.0):
        monkeypatch.setattr(chartdata, "FEW_COLUMNS", 100)
        few = {(r["a"], r["b"]): r["r"] for r in chartdata.correlation(df, undefined=undefined).collect()}
        monkeypatch.setattr(chartdata, "FEW_COLUMNS", 5)
        many = {(r["a"], r["b"]): r["r"] for r in chartdata.correlation(df, undefined=undefined).collect()}
        assert few.keys() == many.keys()
        for k, v in few.items():
            assert (many[k] is None) == (v is None) and (v is None or abs(many[k] - v) < 1e-9), (k, v, many[k])
        assert many[("k4", "k5")] == pytest.approx(-1)
    assert chartdata.correlation(df.limit(0), ["k0", "k1", "k2", "k3", "k4", "k5"]).filter("r IS NOT NULL").count() == 0


def test_three_hundred_columns_in_one_scan(spark):
    columns = [F.hash("id", F.lit(i)).cast("double").alias(f"h{i}") for i in range(300)]
    df = spark.range(2000).repartition(6).select(*columns)
    found = chartdata.correlation(df)
    x = np.array(df.orderBy("h0").collect(), float)
    true = np.corrcoef(x.T)
    got = {(r["a"], r["b"]): r["r"] for r in found.collect()}
    assert len(got) == 90_000
    assert max(abs(got[(f"h{i}", f"h{j}")] - true[i, j]) for i in range(300) for j in range(0, 300, 7)) < 1e-9


def test_moments_add_up():
    rng = np.random.default_rng(1)
    x = np.where(rng.random((90, 4)) < 0.3, np.nan, rng.standard_normal((90, 4)) + 50)
    whole = moments.Moments.of(x)
    parts = moments.Moments.of(x[:13]).add(moments.Moments.of(x[13:14])).add(moments.Moments.of(x[14:]))
    for a, b in zip((whole.n, whole.mean, whole.squares, whole.products), (parts.n, parts.mean, parts.squares, parts.products)):
        assert np.allclose(a, b, rtol=1e-12)


def test_density_meets_few_points(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0, 1), "a") for _ in range(3000)] + [(rng.gauss(500, 2), "b") for _ in range(400)] + [(1000.0, "c")]
    df = spark.createDataFrame(rows, "v double, g string")
    got = {(r["hue"], r["point"]): r["density"] for r in chartdata.density(df, "v", "g").collect()}
    low, high = min(r[0] for r in rows), max(r[0] for r in rows)
    for g in "ab":
        v = np.array([x for x, h in rows if h == g])
        h = len(v) ** -0.2 * v.std(ddof=1)
        grid = low + np.arange(200) * ((high - low) / 199)
        true = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(axis=1) / (h * math.sqrt(2 * math.pi)) / len(rows)
        assert max(abs(got[(g, i)] - true[i]) for i in range(200)) < 1e-12
    assert len(got) == 400  # one value has no bandwidth
    wide = df.filter("g <> 'c'").withColumn("h", F.lit(1.0))
    expanded = chartdata.reach(wide, low, (high - low) / 199, 200).count()
    assert expanded < 6 * 3400  # of 200 points each


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(3000)] + [(rng.randrange(-9000, -5000), rng.randrange(-9000, -5000)) for _ in range(1500)] + [(7777, 7777)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in groups.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {a: find(a) for a in list(parent)}


def brute_following(edges):
    """Walk in order: node -> first anchor before it."""
    before, out = {}, {}
    for a, b in edges:
        before.setdefault(max(a, b), set()).add(min(a, b))
    anchors = set()
    for v in sorted({x for e in edges for x in e}):
        found = [u for u in before.get(v, ()) if u in anchors]
        if found:
            out[v] = min(found)
        else:
            anchors.add(v)
    return out


@pytest.mark.parametrize("whole", [500_000, 40])
def test_long_chains_need_few_rounds(spark, monkeypatch, whole):
    """A chain whose order is its path, and random graphs; with a small limit the large components go on in rounds."""
    rng = random.Random(5)
    n = 10_000 if whole > 100 else 60
    edges = {(i, i + 1) for i in range(n)}
    edges |= {tuple(sorted(rng.sample(range(20_000, 20_400), 2))) for _ in range(700)}
    monkeypatch.setattr(imagecopies, "WHOLE_COMPONENT", whole)
    pairs = spark.createDataFrame([(a, b, a, b) for a, b in edges], "h_a long, h_b long, first_a long, first_b long")
    monkeypatch.setattr(imagecopies, "similar_hashes", lambda *a, **k: pairs)
    calls = []
    monkeypatch.setattr(imagecopies, "pinned", lambda df, plain=lineage.pinned: calls.append(1) or plain(df))
    got = Counter((r["h"], r["near_of"]) for r in imagecopies.similar_groups(pairs).collect())
    assert got == Counter(brute_following(edges).items())
    if whole > 100:
        assert len(calls) < 20
