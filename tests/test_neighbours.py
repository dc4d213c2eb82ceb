"""The neighbour search against brute force, and how many blocks meet."""

import math
import random
from collections import Counter

from tillage.operators import model_impute
from tillage.plans.lineage import settle


def brute(rows, target, k):
    """rows: tuples of codes. {pattern lacking the target: filled code}."""
    counts, out = Counter(rows), {}
    donors = [(p, n) for p, n in counts.items() if p[target] is not None]
    for p in counts:
        if p[target] is not None:
            continue
        near = []
        for d, n in donors:
            shared = [i for i in range(len(p)) if p[i] is not None and d[i] is not None]
            if shared:
                dist = round(math.sqrt(len(p) / len(shared) * sum((p[i] - d[i]) ** 2 for i in shared)), 12)
                near.append((dist, [-1 if x is None else x for x in d], n, d[target]))
        near.sort()
        taken, total = 0, 0
        for _, _, n, v in near:
            use = min(n, k - taken)
            taken, total = taken + use, total + use * v
        if taken:
            out[p] = round(total / taken)  # half to even
    return out


def patterns(rng, n, spread):
    rows = []
    for _ in range(n):
        centre = rng.choice(spread)
        p = [max(0, c + rng.randint(-3, 3)) for c in centre]
        p = [None if rng.random() < 0.08 else x for x in p[:-1]] + [None if rng.random() < 0.3 else p[-1]]
        rows.append(tuple(p))
    return rows


def run(spark, rows, target, k=5):
    df = spark.createDataFrame(rows, ", ".join(f"_c{i} long" for i in range(len(rows[0])))).repartition(4)
    found = model_impute._nearest_codes(df, f"t{target}", [f"t{i}" for i in range(len(rows[0]))], k)
    return {tuple(r[: len(rows[0])]): r["code"] for r in found.collect()}


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(model_impute, "RECEIVER_BLOCK", 7)
    monkeypatch.setattr(model_impute, "DONOR_BLOCK", 9)
    rng = random.Random(1)
    rows = patterns(rng, 600, [(5, 80, 3, 2), (200, 1, 40, 8), (90, 90, 90, 4)])
    rows += [(None, None, None, None), (None, None, None, 3), (5, None, None, None)] + [rows[0]] * 40
    assert run(spark, rows, 3) == brute(rows, 3, 5)
    few = [(1, None, 4), (2, 3, None), (9, 9, 1)]
    assert run(spark, few, 2) == brute(few, 2, 5)


def test_far_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(model_impute, "RECEIVER_BLOCK", 20)
    monkeypatch.setattr(model_impute, "DONOR_BLOCK", 20)

    def met(spread):
        rng = random.Random(2)
        rows = [tuple([*(max(0, c + rng.randint(-4, 4)) for c in rng.choice(spread)), rng.choice([None, 1, 2])]) for _ in range(3000)]
        df = spark.createDataFrame(list({*rows}), "_c0 long, _c1 long, _c2 long, _c3 long").selectExpr("*", "1L AS n")
        blocks = settle(model_impute.pattern_blocks(df, "_c3", ["_c0", "_c1", "_c2"]))
        pairs = model_impute.near_blocks(blocks, ["_c0", "_c1", "_c2"], 4, 5).count()
        return pairs, blocks.select("rb").distinct().count() * blocks.select("db").distinct().count()

    spread = random.Random(3)
    pairs, every = met([tuple(spread.randint(0, 5000) for _ in range(3)) for _ in range(8)])
    assert pairs < every / 4
    dense, all_dense = met([(5, 5, 5)])
    assert pairs / every < dense / all_dense  # fewer on clustered data
