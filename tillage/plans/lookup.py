"""Joining a wide data table with a table of per-key values, safe for hot keys.

A lookup table of a counted, small size is broadcast. A larger one is joined by shuffling, and
the keys that hold a large share of the data rows are answered by a broadcast of only those keys (there can be
at most ``HOT_PARTS`` of them) while their data rows are spread over salts, so that no task receives a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import SMALL_ROWS, may_broadcast, pinned

# A key is hot when it holds more than 1/HOT_PARTS of the rows: there are fewer than HOT_PARTS such keys.
HOT_PARTS = 1000
SALTS = 256


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool, prefix: str) -> Column:
    pairs = [(left[k], right[prefix + k]) for k in keys]
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])


def _position() -> Column:
    """Partition and place of a row: equal rows get different salts. The salt decides nothing but where a row is joined."""
    return F.monotonically_increasing_id()


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    weight: str | None = None,
    null_safe: bool = False,
    max_broadcast: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add the ``values`` columns of ``table`` (unique per ``keys``) to ``df``; no match gives nulls.

    ``weight`` names the column of ``table`` with the number of data rows per key. It is required for the
    hot-key handling when the table turns out to be too large to broadcast. ``max_broadcast`` sets the largest number
    of rows to broadcast; by default the rows and bytes are counted. ``bounded`` says that the
    caller has already checked the size (the table is derived from a pinned small one).
    """
    keys, values = list(keys), list(values)
    if bounded:
        is_small = True
    else:
        table, is_small = pinned(table, SMALL_ROWS if max_broadcast is None else max_broadcast)
    if not is_small and max_broadcast is None:
        is_small = may_broadcast(table, table.count())
    right = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *values, *([weight] if weight and weight not in values else []))
    extra = [] if weight is None or weight in values else [weight]
    if is_small:
        joined = df.join(F.broadcast(right), _same(df, right, keys, null_safe, "_k_"), "left")
        return joined.drop(*[f"_k_{k}" for k in keys], *extra)

    if weight is None:
        joined = df.join(right, _same(df, right, keys, null_safe, "_k_"), "left")
        return joined.drop(*[f"_k_{k}" for k in keys])

    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = right.filter(F.col(weight) > total / HOT_PARTS).select(
        *[F.col(f"_k_{k}").alias(f"_h_{k}") for k in keys],
        *[F.col(v).alias(f"_h_v_{v}") for v in values],
        F.lit(True).alias("_hot"),
    )
    # Rows with a null key match nothing (unless null-safe), so they are spread as well.
    spread = F.coalesce(F.col("_hot"), F.lit(False))
    if not null_safe:
        spread = reduce(lambda a, k: a | F.col(k).isNull(), keys, spread)
    marked = df.join(F.broadcast(hot), _same(df, hot, keys, null_safe, "_h_"), "left").withColumn(
        "_salt", F.when(spread, F.pmod(F.xxhash64(_position()), F.lit(SALTS)) + 1).otherwise(0)
    )
    # Always 0, but not a literal: a literal would leave the join keys, and with it the salt.
    cold = right.withColumn("_cold", F.pmod(F.xxhash64(*[F.col(f"_k_{k}") for k in keys]), F.lit(1)).cast("long"))
    joined = marked.join(
        cold, _same(marked, cold, keys, null_safe, "_k_") & (marked["_salt"] == cold["_cold"]), "left"
    )
    picked = [F.when(F.col("_hot"), F.col(f"_h_v_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    return joined.select(*[F.col(c) for c in df.columns], *picked)
