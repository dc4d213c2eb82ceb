"""Row numbers, ranks and running fills without ever sending the data through one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import local_rows, pinned, settle
from .lookup import lookup

_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, position inside the partition below


def _as_columns(order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def with_row_id(df: DataFrame, order_by: Sequence[str | Column], name: str = "_row") -> DataFrame:
    """Add the 0-based position of every row in the given total order.

    One range shuffle sorts the data; every task then numbers its own rows, and the only thing that is
    gathered is one row count per partition. Rows that tie in the order are told apart by where they come from, so
    that a value of very many rows is spread over several tasks.
    """
    order = [*_as_columns(order_by), F.col("_tie")]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = settle(
        tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", _LOCAL_BITS)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())  # one row per partition
    starts = [0, *accumulate(n for _, n in counts)]
    table = local_rows(df.sparkSession, [(p, s) for (p, _), s in zip(counts, starts)], "_part bigint, _start bigint")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_at", "_part", "_start")
    )


def number_within(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], name: str) -> DataFrame:
    """1-based position inside each key group, for groups of any size.

    A window over the key would put a hot group into one task. Here all rows are numbered in the order
    (keys, order_by), and the first number of each group is subtracted.
    """
    numbered = with_row_id(df, [*keys, *order_by], "_all")
    first = numbered.groupBy(*keys).agg(F.min("_all").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return (
        lookup(numbered, first, keys, ["_first"], weight="_n", null_safe=True)
        .withColumn(name, F.col("_all") - F.col("_first") + 1)
        .drop("_all", "_first")
    )


def hash_key(key: Sequence[str], seed: int) -> Column:
    """The order used by every seeded shuffle: MD5 of seed and key, equal on every engine and partitioning.

    The parts of a composite key carry their lengths, and nulls a mark of their own, so that different keys give different texts.
    """
    texts = [F.col(k).cast("string") for k in key]
    if len(texts) == 1:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(texts[0], F.lit("\x00null"))))
    parts = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit("="), t), F.lit("null")) for t in texts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def bucket_digits(rows: int, per_bucket: int = 200_000) -> int:
    """How many hex digits of the hash make buckets of at most about ``per_bucket`` rows."""
    digits = 1
    while rows / 16**digits > per_bucket and digits < 8:
        digits += 1
    return digits


def hash_rank(df: DataFrame, key: Sequence[str], seed: int, by: Sequence[str] = (), name: str = "_rank") -> DataFrame:
    """0-based rank of every row in seeded hash order (inside each ``by`` group), exact and repeatable.

    Rows are ranked inside hash buckets; the bucket starts come from bucket counts. ``key`` must identify rows.
    """
    by = list(by)
    hashed = df.withColumn("_h", hash_key(key, seed))
    digits = bucket_digits(df.count())
    hashed = hashed.withColumn("_b", F.substring("_h", 1, digits))
    sizes = hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    if not by:  # one row per bucket: at most 16**digits rows
        before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_b").orderBy("_h", *key)
    ranked = hashed.withColumn("_i", F.row_number().over(inside) - 1)
    same = ranked["_b"] == starts["_b"]
    for c in by:
        same = same & ranked[c].eqNullSafe(starts[c])
    return ranked.join(starts, same).select(*[ranked[c] for c in df.columns], (F.col("_i") + F.col("_start")).alias(name))


def fill_along(
    df: DataFrame, column: str, row: str = "_row", forward: bool = True, block_rows: int | None = None
) -> DataFrame:
    """Replace nulls by the nearest present value before (or after) in the order of the dense id ``row``.

    The running window works inside blocks of rows; a value that has to cross a block border comes from a
    table with one row per block.
    """
    if block_rows is None:
        block_rows = max(4096, df.count() // 50_000 + 1)
    blocked = df.withColumn("_block", F.floor(F.col(row) / block_rows).cast("long"))
    at = F.when(F.col(column).isNotNull(), F.col(row))
    edge = (F.max_by if forward else F.min_by)(column, at)
    edges, _ = pinned(blocked.groupBy("_block").agg(F.count(column).alias("_present"), edge.alias("_value")))
    # One row per block (at most about 50,000 of them): which block does a carried value come from? Only block numbers
    # pass through this window; the values stay distributed.
    over = Window.partitionBy(F.lit(0)).orderBy(F.col("_block") if forward else F.col("_block").desc())
    source = F.last(F.when(F.col("_present") > 0, F.col("_block")), ignorenulls=True)
    carry = edges.select("_block", source.over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_from"))
    values = edges.select(F.col("_block").alias("_from"), F.col("_value").alias("_carry"))
    carry = carry.join(values, "_from").select("_block", "_carry")
    inside = Window.partitionBy("_block").orderBy(F.col(row) if forward else F.col(row).desc())
    near = F.last(F.col(column), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    # The rows are partitioned by block already, so this join moves only the carried values.
    joined = blocked.withColumn("_near", near).join(carry, "_block", "left")
    return joined.select(
        *[F.coalesce("_near", "_carry").alias(c) if c == column else F.col(c) for c in df.columns]
    )


def unpivot_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), drop_nulls: bool = True) -> DataFrame:
    """One row per (kept columns, column position, value as double)."""
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast(T.DoubleType()).alias("value")) for i, c in enumerate(columns)])
    out = df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.column", "_c.value")
    return out.filter(F.col("value").isNotNull()) if drop_nulls else out
