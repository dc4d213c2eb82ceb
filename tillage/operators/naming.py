"""File names that are unique in their folder: every row takes the first free one of ``stem``, ``stem_1``, ``stem_2`` ...

Rows with the same stem share one line of numbered names. A name of that line can be wanted by one other stem only: ``a_1`` is number 1 of ``a``
and number 0 of ``a_1``. So lines meet in single names, and who has such a name follows from who comes first:
the first row of ``a_1``, or the row of ``a`` that has used up the free numbers before. Once these names are settled, a row's number is its place
in the sequence of its own line's rows and of the numbers that others hold: the k-th free slot, found by rank.

Lines are settled along the stems, ``a`` before ``a_1`` before ``a_1_1``: one round per suffix in the longest chain of stems, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import pinned, settle
from ..plans.lookup import lookup
from ..plans.rows import number_within, with_row_id

# A stem that is a number of another stem. Numbers of more digits than this are never reached.
NUMBERED = r"^(.*)_([1-9][0-9]{0,17})$"


def unique_names(df: DataFrame, folder: str, stem: str, ext: str, order_by: Sequence[str], name: str = "target") -> DataFrame:
    """Add a target file name that is unique in its folder, ignoring case: ``stem``, ``stem_1``, ``stem_2`` ...

    In the given order every row takes its first free name. Rows that tie in the order are told apart by where they come from. A null stem or
    extension gives a null name.
    """
    key = df.columns
    rows = with_row_id(df, order_by, "_o").withColumn("_f", F.col(folder)).withColumn("_s", F.lower(stem)).withColumn("_e", F.lower(ext))
    line = ["_f", "_s", "_e"]
    groups = settle(rows.groupBy(*line).agg(F.count(F.lit(1)).alias("_size"), F.min("_o").alias("_first")))
    held = _held_numbers(rows, groups, line)
    if held is None:
        info = groups.filter(F.col("_size") > 1).withColumn("_held", F.lit(False))
    else:
        lines = held.groupBy(*line).agg(F.lit(True).alias("_held"))
        info = groups.join(lines, _same(groups, lines, line), "left").select(*[groups[c] for c in line], "_size", F.coalesce("_held", F.lit(False)).alias("_held"))
        info = info.filter((F.col("_size") > 1) | F.col("_held"))
    marked = settle(lookup(rows.drop("_size"), info, line, ["_size", "_held"], weight="_size", null_safe=True))
    alone = marked.filter(F.col("_size").isNull()).withColumn("_k", F.lit(0).cast("long"))
    ranked = number_within(marked.filter(F.col("_size").isNotNull()), line, ["_o"], "_rank").withColumn("_rank", F.col("_rank") - 1)
    if held is not None:
        ranked = settle(ranked)
    placed = ranked.filter(~F.col("_held")).withColumn("_k", F.col("_rank")).drop("_rank")
    if held is not None:
        # In the order of free numbers before them, rows and held numbers together fill the line without a gap.
        moved = ranked.filter("_held").withColumn("_row", F.lit(1))
        others = held.select(*line, F.col("_free").alias("_rank"), F.lit(0).alias("_row"))
        both = number_within(moved.unionByName(others, allowMissingColumns=True), line, ["_rank", "_row"], "_k")
        shifted = both.filter(F.col("_row") == 1).withColumn("_k", F.col("_k") - 1)
        placed = placed.unionByName(shifted.select(*placed.columns))
    named = alone.unionByName(placed).select(*key, "_o", "_k")
    return _settle_rest(named, key, folder, stem, ext, name)


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & a[c].eqNullSafe(b[c])
    return found


def _held_numbers(rows: DataFrame, groups: DataFrame, line: list[str]) -> DataFrame | None:
    """(line, _free): the numbers of each line that other lines hold, given by how many free numbers lie before. None if no two lines meet."""
    kids = groups.select(
        F.col("_f").alias("_kf"), F.col("_e").alias("_ke"), F.regexp_extract("_s", NUMBERED, 1).alias("_ks"),
        F.regexp_extract("_s", NUMBERED, 2).try_cast("long").alias("_number"), F.col("_s").alias("_child"), F.col("_first").alias("_at"),
    ).filter(F.col("_number").isNotNull())
    parent = groups["_f"].eqNullSafe(kids["_kf"]) & (groups["_s"] == kids["_ks"]) & (groups["_e"] == kids["_ke"])
    links = settle(kids.join(groups, parent).select(*line, "_size", "_number", "_child", "_at"))
    # A line of n rows and m meetings uses no number above n + m.
    meetings = links.groupBy(*line).agg(F.count(F.lit(1)).alias("_m"))
    near = lookup(links, meetings, line, ["_m"], weight="_m", null_safe=True).filter(F.col("_number") <= F.col("_size") + F.col("_m")).drop("_m")
    links, _ = pinned(near)
    if not links.take(1):
        return None
    # How many rows of the line come before the first row of the other stem?
    lines = links.groupBy(*line).agg(F.max("_size").alias("_size"), F.lit(True).alias("_met"))
    own = lookup(rows.select(*line, "_o"), lines, line, ["_met"], weight="_size", null_safe=True).filter("_met").select(*line, "_o", F.lit(None).cast("long").alias("_number"))
    marks = links.select(*line, F.col("_at").alias("_o"), "_number")
    among_all = number_within(own.unionByName(marks), line, ["_o"], "_p").filter(F.col("_number").isNotNull()).select(*line, "_number", "_p")
    among_marks = number_within(marks, line, ["_o"], "_q").select(*[F.col(c).alias(f"_x{c}") for c in line], F.col("_number").alias("_xn"), "_q")
    same = (F.col("_number") == F.col("_xn")) & among_all["_f"].eqNullSafe(among_marks["_x_f"]) & (among_all["_s"] == among_marks["_x_s"]) & (among_all["_e"] == among_marks["_x_e"])
    before = among_all.join(among_marks, same).select(*line, "_number", (F.col("_p") - F.col("_q")).alias("_before"))
    met = settle(links.join(before, _same(links, before, [*line, "_number"])).select(*[links[c] for c in line], links["_number"], "_child", "_before"))

    held: DataFrame | None = None
    below = met.select("_f", "_e", F.col("_child").alias("_s")).withColumn("_is_child", F.lit(True))
    active = met.join(below, _same(met, below, line), "left_anti").withColumn("_lost", F.lit(False))
    while True:
        # The rows of one line pass in order; a single number is carried along, so a line of any length needs no memory.
        parts = active.repartition(*line).sortWithinPartitions(*line, "_number")
        done = settle(parts.mapInArrow(_decide, "_f {}, _s string, _e string, _child string, _free bigint, _held boolean".format(dict(met.dtypes)["_f"])))
        if not done.take(1):
            return held
        found = done.filter("_held").select(*line, "_free")
        # A stem whose own name went to the other line has number 0 held.
        lost = done.filter(~F.col("_held")).select("_f", F.col("_child").alias("_s"), "_e", F.lit(0).cast("long").alias("_free"))
        found = found.unionByName(lost)
        held = found if held is None else held.unionByName(found)
        next_lines = done.select("_f", F.col("_child").alias("_s"), "_e", (~F.col("_held")).alias("_lost"))
        active = met.join(next_lines, _same(met, next_lines, line)).select(*[met[c] for c in met.columns], "_lost")


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Who holds each name where two lines meet: the other stem, if its first row comes before the row whose turn the name would be."""
    key, taken = object(), 0
    for batch in batches:
        column = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        free, held = [], []
        for f, s, e, number, before, lost in zip(*(column[n] for n in ("_f", "_s", "_e", "_number", "_before", "_lost"))):
            if (f, s, e) != key:
                key, taken = (f, s, e), int(lost)
            free.append(number - taken)
            held.append(before < number + 1 - taken)
            taken += held[-1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_f"), batch.column("_s"), batch.column("_e"), batch.column("_child"), pa.array(free, pa.int64()), pa.array(held, pa.bool_())],
            names=["_f", "_s", "_e", "_child", "_free", "_held"],
        )


def _settle_rest(rows: DataFrame, key: list[str], folder: str, stem: str, ext: str, name: str) -> DataFrame:
    """Make the names, and look for two that are equal: only stems and extensions cut at different places can still meet (``a.b`` + ``.c``, ``a`` + ``.b.c``).

    Of such rows the earliest keeps its name and the others move up, in rounds.
    """
    while True:
        made = F.when(F.col("_k") == 0, F.concat(stem, ext)).otherwise(F.concat(F.col(stem), F.lit("_"), F.col("_k").cast("string"), F.col(ext)))
        rows = settle(rows.select(*key, "_o", "_k").withColumn(name, made))
        named = rows.filter(F.col(name).isNotNull())
        clash = named.groupBy(F.col(folder).alias("_f"), F.lower(name).alias("_low")).agg(F.min("_o").alias("_keeps"), F.count(F.lit(1)).alias("_size"))
        clash, _ = pinned(clash.filter(F.col("_size") > 1))
        if not clash.take(1):
            return rows.select(*key, name)
        hit = lookup(rows.withColumn("_f", F.col(folder)).withColumn("_low", F.lower(name)), clash, ["_f", "_low"], ["_keeps"], weight="_size", null_safe=True)
        rows = hit.withColumn("_k", F.col("_k") + F.when(F.col("_keeps") != F.col("_o"), 1).otherwise(0))
