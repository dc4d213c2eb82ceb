"""Mixing sources to target weights by entropy balancing (operator 6), by DataFrame functions only.

The rates r of the documents minimise the relative entropy sum(r * ln r - r + 1) against one copy each, under one token constraint per
source, sum(size * r) = target, and r <= ``MOST_COPIES``. The dual of this convex problem has one multiplier per source, and the solution is the
exponential tilt r = min(MOST_COPIES, exp(multiplier * size)). Every Newton round takes the mass and its slope of all sources by one distributed
aggregate over the classes of (source, size); a step that leaves the bracket of a source's multiplier is replaced by its middle.

Rates are whole multiples of 1 / ``UNITS`` and their sums are exact, so neither partitions nor lost tasks change a multiplier.

Rates become whole copies in three steps. Systematic rounding over the classes in order of falling size gives every class its number of copies: each prefix
misses its sum of rates by less than one copy, so the token sum misses the target by at most the largest document. What is missing or
too much is then made up by single copies of the largest documents that fit into it, by falling size, down to less than the smallest document. The
copies of a class are spread evenly over its documents in the order of a hash; their places come from counts per hash bucket, so that no window
ever holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.plans.lineage import settle

from .batches import words_array

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
UNIT_BITS = 20
UNITS = 1 << UNIT_BITS  # rates are counted in these parts of one
NEAR = 1e-6  # a multiplier is found when the mass is this near to its target, relatively
NEWTON_ROUNDS = 60  # no source needs that many: see the bracket
BUCKETS = 4096  # hash buckets of one (source, size) class; a window holds the rows of one bucket


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target tokens per source (_source, _total): sources by code point, null last, weigh ``weights`` in turn.

    The sum of all sizes is shared out by weight; no target exceeds ``most`` times its source's size, and the excess is shared again. The
    capped sources are those with the smallest size per weight, so the level is found by one running sum in that order, without rounds:
    a source is capped exactly if the level at its place exceeds ``most`` * size / weight. One row per source passes these windows.
    """
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("_source") == "", "_source"))
    w = F.array(*map(F.lit, weights))
    rows = by_source.withColumn("_rank", n).withColumn("_w", w[(F.col("_rank") - 1) % len(weights)])
    rows = rows.withColumn("_ratio", most * F.col("_total") / F.col("_w"))
    order = Window.partitionBy(F.lit(0)).orderBy("_ratio", "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("_total").over(every) - most * F.coalesce(F.sum("_total").over(before), F.lit(0))
    rows = rows.withColumn("_level", left / F.sum("_w").over(after))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(every)["_level"]
    return rows.select("_source", "_total", F.least(F.col("_w") * F.coalesce(level, F.lit(0.0)), (most * F.col("_total")).cast("double")).alias("_target"))


def rate_units(multiplier: Column, size: Column, most: int) -> Column:
    """The tilted rate of documents of one size, in whole units."""
    tilt = F.exp(F.least(multiplier * size, F.lit(math.log(most) + 1)))
    return F.when(size > 0, F.round(F.least(F.lit(float(most)), tilt) * UNITS)).otherwise(0).cast("long")


def multipliers(classes: DataFrame, wanted: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(_source, _multiplier) of every source with words: Newton's method on the dual of each token constraint.

    ``classes`` has _source, _size and the number _n of documents, ``wanted`` the targets. The logarithm of the mass is brought to that of the target: below
    one copy it is convex in the multiplier, and steps from 0 never overshoot; towards the cap the bracket holds them. The bracket begins at 0 and
    at the multiplier with which the smallest document alone would do.
    """
    sized = classes.filter(F.col("_size") > 0)
    least = sized.groupBy("_source").agg(F.min("_size").alias("_least"))
    start = wanted.filter(F.col("_target") > 0).join(least, "_source")
    far = F.log(F.least(F.lit(float(most)), F.col("_target") / F.col("_total"))) / F.col("_least")
    full = F.col("_target") >= most * F.col("_total") * (1 - 1e-9)
    # A little beyond the far end, where rounding to units cannot hide the target.
    low, high = F.least(far * 1.01, F.lit(0.0)), F.greatest(far * 1.01, F.lit(0.0))
    state = settle(start.select("_source", "_target", low.alias("_low"), high.alias("_high"), F.when(full, high).otherwise(F.lit(0.0)).alias("_multiplier"), full.alias("_done")))
    for _ in range(NEWTON_ROUNDS):
        if state.filter(~F.col("_done")).isEmpty():
            break
        state = settle(_newton_round(sized, state, most))
    return state.select("_source", "_multiplier")


def _newton_round(sized: DataFrame, state: DataFrame, most: int) -> DataFrame:
    units = rate_units(F.col("_multiplier"), F.col("_size"), most)
    words = (F.col("_n") * F.col("_size")).cast("decimal(19,0)") * units.cast("decimal(10,0)")  # sums of whole numbers do not depend on their order
    open_ = F.when(units < most * UNITS, words.cast("decimal(29,0)") * F.col("_size").cast("decimal(9,0)")).otherwise(F.lit(0))
    last = ("_target", "_low", "_high", "_multiplier", "_done")
    sums = sized.join(state, "_source").groupBy("_source").agg(
        (F.sum(words).cast("double") / UNITS).alias("_mass"), (F.sum(open_).cast("double") / UNITS).alias("_slope"), *[F.first(c).alias(c) for c in last]
    )
    m, mass, target = F.col("_multiplier"), F.col("_mass"), F.col("_target")
    sums = sums.withColumn("_near", F.col("_done") | (F.abs(mass - target) <= NEAR * target))
    sums = sums.withColumn("_low", F.when(mass < target, m).otherwise(F.col("_low"))).withColumn("_high", F.when(mass < target, F.col("_high")).otherwise(m))
    low, high = F.col("_low"), F.col("_high")
    newton = F.when((mass > 0) & (F.col("_slope") > 0), m + (F.log(target) - F.log(mass)) * mass / F.col("_slope"))
    middle = F.when(low * high > 0, F.signum(low) * F.sqrt(low * high)).otherwise((low + high) / 2)
    inside = (newton > low) & (newton < high)
    closed = high - low <= 1e-12 * F.greatest(F.abs(low), F.abs(high))
    return sums.select(
        "_source", "_target", "_low", "_high", F.when(F.col("_near"), m).when(inside, newton).otherwise(middle).alias("_multiplier"), (F.col("_near") | closed).alias("_done")
    )


def class_copies(rated: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Adds ``_copies``, the copies of all documents of a class together, to classes with _source, _size, _n, _units, _before (running units) and _target."""
    floored = lambda units: F.shiftright(units + UNITS // 2, UNIT_BITS)
    rated = rated.withColumn("_copies", floored(F.col("_before") + F.col("_n") * F.col("_units")) - floored(F.col("_before")))
    kind = "struct<missing:bigint,moves:array<struct<_size:bigint,_move:bigint>>>"

    def fill(state: Column, one: Column) -> Column:
        fits = (state["missing"] / one["_size"]).cast("long")
        move = F.least(F.greatest(fits, -one["_copies"]), most * one["_n"] - one["_copies"])
        added = F.concat(state["moves"], F.array(F.struct(one["_size"].alias("_size"), move.alias("_move"))))
        return F.struct((state["missing"] - move * one["_size"]).alias("missing"), F.when(move == 0, state["moves"]).otherwise(added).alias("moves")).cast(kind)

    # One row per source, an entry per distinct size; every move halves what is missing at least, or empties or fills a class.
    missing = F.round(F.first("_target")).cast("long") - F.sum(F.col("_copies") * F.col("_size"))
    by_size = F.sort_array(F.collect_list(F.struct("_size", "_n", "_copies")), asc=False)
    sources = rated.filter(F.col("_size") > 0).groupBy("_source").agg(missing.alias("_missing"), by_size.alias("_classes"))
    nothing = F.struct(F.col("_missing").alias("missing"), F.array().alias("moves")).cast(kind)
    moves = sources.select("_source", F.explode(F.aggregate("_classes", nothing, fill)["moves"]).alias("_m")).select("_source", "_m.*")
    return rated.join(moves, ["_source", "_size"], "left").withColumn("_copies", F.col("_copies") + F.coalesce("_move", F.lit(0))).drop("_move")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row, copies being whole and at most ``most``.

    A null text has size 0 and a null source is a source of its own. Rows with equal ids are rounded one by one; where source, size, id and text are
    equal, which of the rows gets an extra copy is open, but their number is not. Documents of size 0 get no copy. Reruns agree.
    """
    out, copies = _decided(docs, weights, most, seed, id_col, source_col, text_col, [])
    return out.select(
        F.col("_id").alias(id_col), F.when(F.col("_source") != "", F.substr("_source", F.lit(2))).alias(source_col), F.col("_size").alias("size"), F.col("_total").cast("long").alias("source_size"),
        F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).alias("taken"),
    )


def repeat(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "copy",
) -> DataFrame:
    """The mixed documents themselves: every row with all its columns as often as ``mix`` says, numbered from 1 in ``copy_col``.

    Rows without a copy are gone. A column of ``docs`` that is called like ``copy_col`` is replaced.
    """
    whole = [c for c in docs.columns if c != copy_col]
    out, copies = _decided(docs, weights, most, seed, id_col, source_col, text_col, [F.struct(*[F.col(f"`{c}`") for c in whole]).alias("_doc")])
    kept = out.select("_doc", copies.alias("_copies")).filter(F.col("_copies") > 0)
    return kept.select(*[F.col("_doc")[c].alias(c) for c in whole], F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias(copy_col))


def _decided(
    docs: DataFrame, weights: tuple[float, ...], most: int, seed: int, id_col: str, source_col: str, text_col: str, carried: list[Column]
) -> tuple[DataFrame, Column]:
    """Every row with its source's figures and any ``carried`` columns, and the copies it gets."""
    mark = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))
    words = F.size(words_array(F.coalesce(F.col(text_col), F.lit(""))))
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    named = docs.select(F.col(id_col).alias("_id"), source.alias("_source"), words.cast("long").alias("_size"), mark.alias("_mark"), *carried)
    named = named if carried else settle(named)  # four small columns; texts that are carried are read twice instead
    rows = named.drop("_doc").withColumn("_bucket", F.pmod(F.col("_mark"), F.lit(BUCKETS)).cast("int"))
    cells = rows.groupBy("_source", "_size", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    cells = settle(cells)
    # One row per distinct size of a source: bounded by the longest document, not by the number of documents.
    classes = settle(cells.groupBy("_source", "_size").agg(F.sum("_n").alias("_n")))
    by_source = classes.groupBy("_source").agg(F.sum(F.col("_n") * F.col("_size")).alias("_total"))
    wanted = settle(targets(by_source, weights, most))
    tilted = classes.join(wanted, "_source").join(multipliers(classes, wanted, most), "_source", "left")
    tilted = tilted.withColumn("_units", F.coalesce(rate_units(F.col("_multiplier"), F.col("_size"), most), F.lit(0).cast("long")))
    larger = Window.partitionBy("_source").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    rated = settle(tilted.withColumn("_before", F.coalesce(F.sum(F.col("_n") * F.col("_units")).over(larger), F.lit(0).cast("long"))))
    rated = class_copies(rated, most).select("_source", "_size", F.col("_n").alias("_among"), "_copies", "_total", "_target")

    # Sources meet their rates while there is one row per size; what grows with the documents is dealt by source, size and bucket.
    earlier = Window.partitionBy("_source", "_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    table = cells.join(rated, ["_source", "_size"]).select("_source", "_size", "_bucket", "_earlier", "_among", "_copies", "_total", "_target")
    inside = Window.partitionBy("_source", "_size", "_bucket").orderBy("_mark", F.col("_id").cast("string"))
    ranked = named.withColumn("_bucket", F.pmod(F.col("_mark"), F.lit(BUCKETS)).cast("int")).withColumn("_rank", F.row_number().over(inside))
    out = ranked.join(table, ["_source", "_size", "_bucket"]).withColumn("_place", F.col("_earlier") + F.col("_rank"))
    return out, F.expr("_copies div _among + _place * (_copies % _among) div _among - (_place - 1) * (_copies % _among) div _among")
