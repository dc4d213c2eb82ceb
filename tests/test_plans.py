"""The shared building blocks, above all on their large-data paths."""

import random

import pytest
from pyspark.sql import functions as F

from tillage.plans import lineage
from tillage.plans.lookup import lookup
from tillage.plans.quantiles import quantiles
from tillage.plans.recipe import Recipe, action
from tillage.plans.rows import fill_along, hash_rank, number_within, with_row_id


def test_row_ids_do_not_depend_on_partitioning(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("v"))
    want = {r.v: i for i, r in enumerate(sorted(df.collect()))}
    for n in (1, 8, 64):
        got = {r.v: r._row for r in with_row_id(df.repartition(n), ["v"]).collect()}
        assert got == want


def test_number_within_a_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 != 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    rows = number_within(df, ["k"], ["id"], "n").collect()
    seen = {}
    for r in sorted(rows, key=lambda r: r.id):
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r.n == seen[r.k]


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("limit", [0, 10_000])
def test_lookup_gives_the_same_rows_on_every_path(spark, null_safe, limit):
    """limit 0 forces the shuffle with spread hot keys."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 2500)
    df = spark.range(9000).select("id", key.cast("long").alias("k"))
    table = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    sums = {}
    for r in df.collect():
        sums[r.k] = sums.get(r.k, 0) + r.id
    got = lookup(df, table, ["k"], ["s", "n"], weight="n", null_safe=null_safe, max_broadcast=limit)
    assert got.columns == ["id", "k", "s", "n"]
    rows = got.collect()
    assert len(rows) == 9000
    for r in rows:
        assert r.s == (sums[r.k] if r.k is not None or null_safe else None)


@pytest.mark.parametrize("band", [50, 1_000_000])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_are_exact_when_brackets_are_narrowed(spark, band, by):
    rng = random.Random(3)
    rows = [(i % 3, float(rng.choice([5.0, rng.gauss(0, 1) * 10 ** rng.randint(0, 6)])), None if i % 5 else i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, v double, w int")
    got = {(r.g if by else 0, r.column, r.prob): r.quantile for r in quantiles(df, ["v", "w"], (0.25, 0.5, 0.9), by, band_rows=band).collect()}
    for g in (range(3) if by else [0]):
        for c, at in (("v", 1), ("w", 2)):
            s = sorted(r[at] for r in rows if (not by or r[0] == g) and r[at] is not None)
            for p in (0.25, 0.5, 0.9):
                i = (len(s) - 1) * p
                lo, hi = s[int(i)], s[min(len(s) - 1, int(i) + (i > int(i)))]
                assert got[(g, c, p)] == pytest.approx(lo + (hi - lo) * (i - int(i)), rel=1e-12)


def test_hash_rank_per_group(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"))
    rows = hash_rank(df.repartition(13), ["id"], 5, ["g"]).collect()
    for g in range(7):
        assert sorted(r._rank for r in rows if r.g == g) == list(range(sum(1 for i in range(1000) if i % 7 == g)))
    again = {r.id: r._rank for r in hash_rank(df.orderBy(F.desc("id")), ["id"], 5, ["g"]).collect()}
    assert again == {r.id: r._rank for r in rows}


@pytest.mark.parametrize("forward", [True, False])
def test_fill_crosses_blocks(spark, forward):
    values = [None] * 3 + [1] + [None] * 20 + [2, None, 3] + [None] * 9
    df = with_row_id(spark.createDataFrame(list(enumerate(values)), "i int, v int"), ["i"])
    got = [r.v for r in fill_along(df, "v", "_row", forward, block_rows=4).orderBy("i").collect()]
    want, last = [], None
    for v in values if forward else values[::-1]:
        last = v if v is not None else last
        want.append(last)
    assert got == (want if forward else want[::-1])


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    spark.conf.set("spark.checkpoint.dir", str(tmp_path)) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if spark.conf.get("spark.checkpoint.dir", None) == str(tmp_path):
        lineage.settle(spark.range(3))
        assert list(tmp_path.iterdir())
        spark.conf.unset("spark.checkpoint.dir")


def test_recipe_steps(spark, tmp_path):
    action("above", lambda df, low: df.filter(F.col("id") > low))
    action("twice", lambda df: df.select((F.col("id") * 2).alias("id")))
    recipe = Recipe(spark.range(10)).then("above", low=4).then("twice")
    assert sorted(r.id for r in recipe.result().collect()) == [10, 12, 14, 16, 18]
    assert [(r.step, r.action, r.rows_before, r.rows_after) for r in recipe.log().orderBy("step").collect()] == [(1, "above", 10, 5), (2, "twice", 5, 5)]
    assert sorted(r.id for r in recipe.undo().result().collect()) == [5, 6, 7, 8, 9]
    assert recipe.revert().result().count() == 10
    with pytest.raises(ValueError):
        recipe.then("unknown")
    recipe.save(str(tmp_path / "session"))
    back = Recipe.resume(spark, str(tmp_path / "session"))
    assert back.steps == recipe.steps
    assert sorted(r.id for r in back.result().collect()) == [10, 12, 14, 16, 18]
    recipe.write_log(str(tmp_path / "log"), file="numbers")
    log = spark.read.json(str(tmp_path / "log")).first()
    assert log.rows_before == 10 and log.rows_now == 5 and [s.action for s in log.steps] == ["above", "twice"]
    many = Recipe(spark.range(1))
    for _ in range(30):
        many = many.then("twice")
    assert len(many.steps) == 30 and len(many.undo().steps) == 29


def test_wide_values_do_not_pass_the_driver(spark, monkeypatch):
    df = spark.range(30).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array("id").alias("a"))
    rows = lineage.small(df)
    assert sorted(r.id for r in rows.collect()) == list(range(30)) and rows.schema == df.schema
    assert lineage.small(df, 29) is None
    monkeypatch.setattr(lineage, "SMALL_BYTES", 20_000)
    assert lineage.small(df) is None
    stored, is_small = lineage.pinned(df)
    assert not is_small and sorted(r.id for r in stored.collect()) == list(range(30))
    assert lineage.may_broadcast(stored, 30)
    monkeypatch.setattr(lineage, "BROADCAST_BYTES", 20_000)
    assert not lineage.may_broadcast(stored, 30)


def test_hot_keys_of_equal_rows_are_spread(spark):
    """A table too large to broadcast (by order), half of the rows one value and a tenth null, in rows without an id."""
    k = F.when(F.col("id") % 10 < 5, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    df = spark.range(60_000).select(k.alias("k"))
    table = df.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = lookup(df, table.select("k", F.col("n").alias("times"), "n"), ["k"], ["times"], weight="n", max_broadcast=10)
        parts = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(parts) == 60_000 and max(parts) < 0.25 * 60_000
        assert {r.k: r.times for r in found.distinct().collect()} == {r.k: r.n for r in table.collect()} | {None: None}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_equal_order_values_are_spread(spark):
    rows = with_row_id(spark.range(50_000).select(F.lit("same").alias("v")), ["v"], "at")
    assert sorted(r.at for r in rows.collect()) == list(range(50_000))


def test_settle_drops_its_shuffle_files_and_the_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    assert lineage.settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert spark.conf.get(name, None) == was
