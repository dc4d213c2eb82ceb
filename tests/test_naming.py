"""Unique names against a walk over the rows in order."""

import random

from tillage.operators import naming
from tillage.operators.labels import unique_names


def walk(rows):
    """rows (order, folder, stem, ext) -> {order: name}."""
    used, out = set(), {}
    for at, folder, stem, ext in sorted(rows, key=lambda r: r[0]):
        k, name = 0, stem + ext
        while (folder, name.lower()) in used:
            k += 1
            name = f"{stem}_{k}{ext}"
        used.add((folder, name.lower()))
        out[at] = name
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "o long, _folder string, stem string, ext string").repartition(5)
    got = unique_names(df, "_folder", "stem", "ext", ["o"])
    assert got.columns == ["o", "_folder", "stem", "ext", "target"]
    assert {r["o"]: r["target"] for r in got.collect()} == walk(rows)


def test_names_equal_a_walk(spark, monkeypatch):
    rounds = []
    plain = naming._settle_rest
    monkeypatch.setattr(naming, "_settle_rest", lambda rows, *a: rounds.append(1) or plain(rows, *a))
    rng = random.Random(6)
    stems = ["a", "A", "a_1", "a_2", "A_1_1", "a_1_2", "a_01", "a_0", "b", "a_3", "a_12", "a_1_1_1", "_1", "", "a_99999999999999999999"]
    rows = [(i, rng.choice(["x", "y", None]), rng.choice(stems), rng.choice([".t", ".T", ""])) for i in range(500)]
    check(spark, rows)
    # adversarial: every number of a stem is wished for by a row of its own, at any time; and chains of stems
    rows = [(i, "x", rng.choice(["a", f"a_{rng.randint(1, 90)}", f"a_{rng.randint(1, 5)}_{rng.randint(1, 9)}"]), ".t") for i in range(400)]
    check(spark, rows)
    rows = [(i, "x", "a" + "_1" * (i % 7), ".t") for i in range(120)]
    check(spark, rows)
    check(spark, [(i, "x", f"n{i}", ".t") for i in range(30)])


def test_rounds_do_not_grow_with_the_rows(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(naming, "settle", lambda df, plain=naming.settle: calls.append(1) or plain(df))
    counts = []
    for n in (40, 400):
        calls.clear()
        rng = random.Random(1)
        check(spark, [(i, "x", rng.choice(["a", f"a_{rng.randint(1, n)}"]), ".t") for i in range(n)])
        counts.append(len(calls))
    assert counts[0] == counts[1]


def test_differently_cut_names(spark):
    rows = [(0, "x", "a", ".b.c"), (1, "x", "a.b", ".c"), (2, "x", "a", ".b.c"), (3, "x", "a.b", ".c")]
    df = spark.createDataFrame(rows, "o long, _folder string, stem string, ext string")
    names = [r["target"] for r in unique_names(df, "_folder", "stem", "ext", ["o"]).collect()]
    assert len(set(names)) == 4
    empty = unique_names(df.limit(0), "_folder", "stem", "ext", ["o"])
    assert empty.collect() == []
