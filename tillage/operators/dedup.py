"""Exact duplicates of whole rows. Null equals null, and the first copy is the one that stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import may_broadcast, settle
from ..plans.lookup import lookup


def repeated_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows whose 64-bit row hash occurs more than once, with the hash as ``_hash``; other rows have no copy.

    Only hashes are shuffled to find them, so a table with few duplicates does not move its cells. The caller compares full rows.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*[_comparable(df, c) for c in columns]))
    twice = settle(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_times")).filter(F.col("_times") > 1))
    if may_broadcast(twice, twice.count()):
        return hashed.join(F.broadcast(twice.select("_hash")), "_hash", "left_semi")
    found = lookup(hashed, twice, ["_hash"], ["_times"], weight="_times")
    return found.filter(F.col("_times").isNotNull()).drop("_times")


def _comparable(df: DataFrame, column: str) -> Column:
    """0.0 and -0.0 are equal as values and must have equal hashes."""
    kind = df.schema[column].dataType
    return F.col(column) + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(column)


# From this many rows per different one on, whole rows are grouped at once: tasks then combine most rows before the shuffle.
FULL_GROUPING = 2.0


# Rows that are looked at to choose a plan. Both plans are exact; the choice only decides what they cost.
PROBE_ROWS = 10_000


def mostly_repeated(df: DataFrame, columns: Sequence[str]) -> bool:
    """Do the first rows repeat so much that grouping whole rows moves little?"""
    probe = df.select(F.xxhash64(*[_comparable(df, c) for c in columns]).alias("_hash")).limit(PROBE_ROWS)
    rows, different = probe.agg(F.count(F.lit(1)), F.count_distinct("_hash")).first()
    return rows >= FULL_GROUPING * different


def extra_copies(df: DataFrame) -> int:
    """Number of copies after the first, over the whole table."""
    columns = df.columns
    rows = df if mostly_repeated(df, columns) else repeated_rows(df, columns)
    groups = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, duplicates (every copy after the first)."""
    extra = F.lit(extra_copies(df)).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", (F.col("rows") - extra).alias("distinct_rows"), extra.alias("duplicate_rows"))


def mark_duplicates(df: DataFrame, row: str = "_row", columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``first_row`` (row id of the first copy) and ``is_duplicate``.

    Where most rows are copies, whole rows are grouped and looked up. Otherwise rows whose hash occurs once are their own first copy, the others
    are compared in full, and what comes back to the table is one entry per later copy, by row id.
    """
    columns = list(columns or [c for c in df.columns if c != row])
    if mostly_repeated(df, columns):
        copies = df.groupBy(*columns).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > 1)
        return _marked(lookup(df, copies, columns, ["_first"], weight="_copies", null_safe=True), row)
    again = settle(repeated_rows(df, columns).select(row, "_hash", *columns))
    copies = again.groupBy("_hash", *columns).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > 1)
    right = copies.select(F.col("_hash").alias("_h"), *[F.col(c).alias(f"_c_{i}") for i, c in enumerate(columns)], "_first")
    same = F.col("_hash") == F.col("_h")
    for i, c in enumerate(columns):
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{i}"))
    later = again.join(right, same).filter(F.col("_first") < F.col(row)).select(F.col(row).alias("_later"), "_first")
    later = settle(later)
    later = F.broadcast(later) if may_broadcast(later, later.count()) else later
    return _marked(df.join(later, F.col(row) == F.col("_later"), "left").drop("_later"), row)


def _marked(found: DataFrame, row: str) -> DataFrame:
    return found.withColumn("first_row", F.coalesce("_first", row)).drop("_first").withColumn("is_duplicate", F.col("first_row") < F.col(row))


def drop_duplicates(df: DataFrame, row: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep one copy of every row. With ``row`` the id of the first copy is kept."""
    if row is None:
        return df.dropDuplicates(list(columns) if columns else None)
    columns = list(columns or [c for c in df.columns if c != row])
    rest = [c for c in df.columns if c != row and c not in columns]
    if not rest:
        return df.groupBy(*columns).agg(F.min(row).alias(row)).select(*df.columns)
    first = df.groupBy(*columns).agg(F.min(F.struct(row, *rest)).alias("_f"))
    return first.select(*[F.col(c) if c in columns else F.col(f"_f.{c}").alias(c) for c in df.columns])


def drop_rows_with_gaps(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=list(subset) if subset else None)
