"""Table operators on small tables made by rules and on hand-made rows."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.conftest import visit_rows
from tillage.operators import chartdata, columns, dedup, encode, impute, model_impute, profile, split


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_profile_of_the_visits(visits):
    rows = visit_rows()
    p = by(profile.column_profile(visits), "column")
    floors, fees = [r[0] for r in rows], [r[2] for r in rows if r[2] is not None]
    assert (p["floor"]["median"], p["floor"]["min"], p["floor"]["max"], p["floor"]["nulls"]) == (statistics.median(floors), min(floors), max(floors), 0)
    assert (p["fee"]["median"], p["fee"]["nulls"]) == (statistics.median(fees), 1)
    assert p["tier"]["distinct_values"] == 3 and p["opened"]["distinct_values"] == len({r[5] for r in rows})
    health = profile.table_health(visits).first()
    assert (health["missing_cells"], health["duplicate_rows"]) == (3, 2)
    assert profile.issue_summary(visits).first()[:] == (3, 2)


def test_semantic_types(spark):
    df = spark.createDataFrame([("7", "1999-11-30", "oak", None, "1999-00-09", "1d"), ("-0.25", "2003-04-17T08:30", "", "", "1999-01-09", "2f")], "n string, d string, t string, e string, b string, g string")
    got = {r["column"]: r["semantic_type"] for r in profile.semantic_types(df).collect()}
    assert got == {"n": "numeric", "d": "date", "t": "text", "e": "text", "b": "text", "g": "text"}


def test_quartiles_and_correlation(visits):
    rows = visit_rows()
    b = chartdata.box_stats(visits, "floor").first()
    assert (b["q1"], b["median"], b["q3"]) == tuple(statistics.quantiles([r[0] for r in rows], n=4, method="inclusive"))
    c = {(r.a, r.b): r.r for r in chartdata.correlation(visits.select("floor", "fee", "rating")).collect()}
    for (i, a), (j, b) in itertools.permutations([(0, "floor"), (2, "fee"), (3, "rating")], 2):
        both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        assert c[(a, b)] == pytest.approx(statistics.correlation(*zip(*both)), abs=1e-9)


def test_undefined_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    assert {(r.a, r.b): r.r for r in chartdata.correlation(df).collect()}[("a", "b")] is None
    assert {(r.a, r.b): r.r for r in chartdata.correlation(df, undefined=0).collect()}[("a", "b")] == 0


def test_fills_round_whole_columns(visits):
    rows = visit_rows()
    fees, ratings = ([r[i] for r in rows if r[i] is not None] for i in (2, 3))
    p = by(impute.fit(visits, {"fee": "mean", "rating": "mean"}), "column")
    assert float(p["fee"]["value"]) == round(statistics.mean(fees)) and float(p["rating"]["value"]) == round(statistics.mean(ratings))
    filled = impute.fill(visits, {"fee": "mode", "tier": "mode", "rating": "median"})
    assert filled.filter("fee IS NULL OR tier IS NULL OR rating IS NULL").count() == 0
    gap = rows[11]
    assert filled.filter((F.col("floor") == gap[0]) & (F.col("opened").cast("string") == gap[5])).first()["fee"] in statistics.multimode(fees)
    assert filled.schema["fee"].dataType == visits.schema["fee"].dataType


def test_mode_ties(members):
    assert members.schema["term"].dataType.simpleString() == "bigint"  # NA is a missing cell
    assert by(impute.fit(members, {"age": "mode"}), "column")["age"]["value"] == "31"
    seen_last = members.withColumn("at", -F.col("age"))
    assert by(impute.fit(seen_last, {"age": "mode"}, order_by=["at"]), "column")["age"]["value"] == "47"


def test_fill_errors_and_no_ops(visits):
    with pytest.raises(ValueError):
        impute.fit(visits, {"tier": "mean"})
    with pytest.raises(ValueError):
        impute.fit(visits, {"fee": "constant"})
    assert impute.fit(visits, {"nothing": "mean"}).count() == 0


def test_parameters_of_the_training_part_fill_the_rest(spark):
    df = spark.createDataFrame([(1, 10.0, "train"), (2, 20.0, "train"), (3, None, "train"), (4, None, "test"), (5, 90.0, "test")], "i int, v double, split string")
    params = impute.fit(df.filter("split = 'train'"), {"v": "mean"})
    assert by(impute.transform(df, params), "i")[4]["v"] == 15.0


def test_model_fill_is_better_than_the_mean(spark):
    rng = random.Random(1)
    rows = [(i, float(i % 50), 3.0 * (i % 50) + rng.random(), i % 6 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, x double, y double, hide boolean")
    gaps = df.select("i", "x", F.when(~F.col("hide"), F.col("y")).alias("y"))
    filled = by(model_impute.fill_model(gaps, "y", ["x", "y"]), "i")
    mean = sum(r[2] for r in rows if not r[3]) / sum(1 for r in rows if not r[3])
    model_error = sum(abs(filled[r[0]]["y"] - r[2]) for r in rows if r[3])
    mean_error = sum(abs(mean - r[2]) for r in rows if r[3])
    assert model_error < mean_error / 5
    assert all(filled[r[0]]["y"] == r[2] for r in rows if not r[3])


def brute_neighbours(rows, target, k=5):
    """Nearest-neighbour fill of coded rows by trying all pairs."""
    out = []
    for r in rows:
        if r[target] is not None:
            continue
        found = []
        for d in rows:
            if d[target] is None:
                continue
            both = [(a, b) for a, b in zip(r, d) if a is not None and b is not None]
            if both:
                dist = math.sqrt(len(r) / len(both) * sum((a - b) ** 2 for a, b in both))
                found.append((round(dist, 12), tuple(-1 if x is None else x for x in d), d[target]))
        near = sorted(found)[:k]
        if near:  # a row sharing no present column with any donor has no neighbour
            out.append((r, round(sum(n[2] for n in near) / len(near))))
    return out


@pytest.mark.parametrize("blocks", [(2000, 20000), (7, 11)])
def test_neighbours_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(model_impute, "RECEIVER_BLOCK", blocks[0])
    monkeypatch.setattr(model_impute, "DONOR_BLOCK", blocks[1])
    rng = random.Random(5)
    pick = lambda n: None if rng.random() < 0.2 else f"v{rng.randrange(n):02d}"
    rows = [(pick(4), pick(12), pick(5)) for _ in range(250)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    kinds = [sorted({r[i] for r in rows if r[i] is not None}) for i in range(3)]
    coded = [tuple(None if v is None else kinds[i].index(v) for i, v in enumerate(r)) for r in rows]
    want = dict(brute_neighbours(coded, 1))
    got = {(r._c0, r._c1, r._c2): r.code for r in model_impute.neighbour_fills(df, "b").collect()}
    assert got == want
    assert model_impute.fill_neighbours(df, "b").filter("b IS NULL").count() == 0


def test_encoding_errors(visits):
    for column, method in (("floor", "label"), ("wing", "dates")):
        with pytest.raises(ValueError):
            encode.check_encodable(visits, column, method)
    encode.check_encodable(visits, "opened", "dates")
    with pytest.raises(ValueError):
        encode.one_hot(visits, "opened", max_columns=5)
    with pytest.raises(ValueError, match="gold"):
        encode.ordinal_by(visits, "tier", ["silver", "bronze"])


def test_one_hot_names_and_places(visits):
    out = encode.one_hot(visits, "tier")
    assert out.columns[4:7] == ["tier_bronze", "tier_gold", "tier_silver"]
    first = encode.one_hot(visits, "tier", order_by=["opened"], at_end=True, null_column=True)
    seen = [t for t in dict.fromkeys(r[4] for r in sorted(visit_rows(), key=lambda r: r[5])) if t]
    assert first.columns[-4:] == [*(f"tier_{t}" for t in seen), "tier_null"]
    parts = encode.date_parts(visits, "opened")
    assert parts.columns[-3:] == ["opened_year", "opened_month", "opened_day"]


def test_rename_and_swap_rules(visits):
    with pytest.raises(ValueError):
        columns.rename(visits, "floor", "wing")
    with pytest.raises(ValueError):
        columns.rename(visits, "floor", " ")
    assert columns.rename(visits, "nothing", "x", strict=False).columns == visits.columns
    assert columns.swap(visits, "floor", "nothing").columns == visits.columns


@pytest.mark.parametrize("from_share", [0.0, 2.0, 1e9])
def test_duplicates_point_to_the_first_copy(spark, monkeypatch, from_share):
    """Both plans, and the one chosen by the share of repeats."""
    monkeypatch.setattr(dedup, "FULL_GROUPING", from_share)
    df = spark.createDataFrame([(0, "a", None), (1, "b", 1), (2, "a", None), (3, "a", None), (4, "b", 2)], "_row long, x string, y int")
    marked = by(dedup.mark_duplicates(df), "_row")
    assert [marked[i]["first_row"] for i in range(5)] == [0, 1, 0, 0, 4]
    assert sorted(r._row for r in dedup.drop_duplicates(df, "_row").collect()) == [0, 1, 4]
    plain = df.drop("_row")
    assert tuple(dedup.duplicate_count(plain).first()) == (5, 3, 2)
    assert tuple(profile.issue_summary(plain).first()) == (1, 2)
    assert tuple(profile.table_health(plain).first())[:4] == (5, 10, 3, 2)
    assert tuple(profile.table_health(plain.limit(0)).first())[:5] == (0, 0, 0, 0, 100.0)


def sizes_of(df):
    return {r.split: r.n for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_split_sizes_and_repeatability(spark):
    df = spark.range(240).select(F.format_string("item-%d", "id").alias("name"))
    one = split.split(df, ["name"], (60, 25, 15), 1)
    assert sizes_of(one) == {"train": 144, "valid": 60, "test": 36}
    rows = sorted(one.collect())
    assert len({r.name for r in rows}) == 240
    for n in (1, 8, 64):
        assert sorted(split.split(df.orderBy(F.rand()).repartition(n), ["name"], (60, 25, 15), 1).collect()) == rows
    assert sorted(split.split(df, ["name"], (60, 25, 15), 2).collect()) != rows
    assert sizes_of(split.split(df.limit(4), ["name"], (90, 5, 5))) == {"train": 2, "valid": 1, "test": 1}
    assert sizes_of(split.split(df.limit(1), ["name"], (40, 30, 30))) == {"train": 1}
    assert sizes_of(split.split(df, ["name"], (100, 0, 0))) == {"train": 240}
    with pytest.raises(ValueError):
        split.fractions((50, 20, 10))
    with pytest.raises(ValueError):
        split.fractions((0, 50, 50))


def test_stratified_shares(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 6 == 0, "rare").otherwise("common").alias("g"))
    out = split.split(df, ["id"], (60, 20, 20), 7, by="g")
    assert sizes_of(out.filter("g = 'rare'")) == {"train": 30, "valid": 10, "test": 10}
    assert sizes_of(out.filter("g = 'common'")) == {"train": 150, "valid": 50, "test": 50}


def test_train_test_valid_without_test(spark):
    assert sizes_of(split.train_test_valid(spark.range(10).select("id"), ["id"], 0.0, 0.25)) == {"train": 7, "valid": 3}
    assert sizes_of(split.train_test_valid(spark.range(11).select("id"), ["id"])) == {"train": 7, "test": 3, "valid": 1}  # test ceil(2.2), valid ceil(8 * 0.125)


def test_many_hues_are_refused(spark):
    with pytest.raises(ValueError):
        chartdata.group_counts(spark.range(20).select(F.col("id").alias("h")), "h")


def test_page_is_clamped(spark):
    df = spark.range(45).select("id")
    assert sorted(r.position for r in profile.page(df, 99, ["id"]).collect()) == list(range(40, 45))
    assert sorted(r.id for r in profile.page(df, 0, ["id"]).collect()) == list(range(20))
