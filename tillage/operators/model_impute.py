"""Model-based filling: chained random forests for numbers, nearest neighbours for categories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import numeric_columns, text_columns
from ..plans.lineage import settle
from ..plans.lookup import lookup
from ..plans.rows import number_within
from . import impute
from .encode import category_table
from .trees import bin_edges, grow, predict

# Forest size, rounds, tolerance, seed and number of neighbours.
TREES, ROUNDS, TOLERANCE, SEED = 10, 10, 1e-3, 42
NEIGHBOURS = 5
# Distinct patterns of a block, and the most donor blocks: their boxes are known to every task that looks for near ones.
RECEIVER_BLOCK, DONOR_BLOCK, DONOR_BLOCKS = 500, 2_000, 20_000


def fill_model(
    df: DataFrame, column: str, features: Sequence[str] | None = None, rounds: int = ROUNDS, trees: int = TREES,
    depth: int = 10, seed: int = SEED, key: Sequence[str] | None = None,
) -> DataFrame:
    """Fill a numeric column by chained equations over all numeric columns.

    Gaps start at the mean; in every round each column with gaps, fewest first, is predicted from the others by a
    random forest grown on its present rows (``trees.grow``). Rounds end when the largest change is small, and after one where only
    this column has gaps. With one numeric column the median is used. Trees draw rows by a hash of ``key`` (the numeric columns
    unless given), so reruns and other partitionings grow the same forest; rows with equal keys are drawn together. The table
    is written to the shared folder between rounds.
    """
    numbers = list(features or numeric_columns(df))
    if column not in numbers:
        raise ValueError(f"{column} is not numeric")
    if len(numbers) == 1:
        return impute.fill(df, {column: "median"})
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(numbers):
        v = F.col(c).cast("double")
        aggs += [F.count(c).alias(f"p_{i}"), F.avg(v).alias(f"a_{i}"), F.max(F.abs(v)).alias(f"m_{i}"), F.bool_and(v == F.floor(v)).alias(f"w_{i}")]
    stats = df.agg(*aggs).first()
    at = {c: i for i, c in enumerate(numbers)}
    usable = [c for c in numbers if stats[f"p_{at[c]}"] > 0]
    gaps = sorted((c for c in usable if stats[f"p_{at[c]}"] < stats["n"]), key=lambda c: stats["n"] - stats[f"p_{at[c]}"])
    if column not in gaps:
        return df
    edges = {f"_v_{c}": e for c, e in bin_edges(df.select(*[F.col(c).cast("double").alias(c) for c in usable]), usable).items()}
    work = df.select(
        "*",
        *[F.coalesce(F.col(c).cast("double"), F.lit(stats[f"a_{at[c]}"])).alias(f"_v_{c}") for c in usable],
        F.xxhash64(*(key or numbers)).alias("_hash"),
    )
    limit = TOLERANCE * max(stats[f"m_{at[c]}"] for c in usable)
    for _ in range(rounds if len(gaps) > 1 else 1):
        before = {c: f"_b_{c}" for c in gaps}
        work = settle(work.select("*", *[F.col(f"_v_{c}").alias(b) for c, b in before.items()]))
        for c in gaps:
            inputs = [f"_v_{o}" for o in usable if o != c]
            forest = grow(work.filter(F.col(c).isNotNull()), f"_v_{c}", inputs, edges, "_hash", trees, depth, seed)
            value = F.when(F.col(c).isNull(), predict(forest, inputs)).otherwise(F.col(f"_v_{c}"))
            work = settle(work.withColumn(f"_v_{c}", value))
        change = work.agg(F.max(F.greatest(*[F.abs(F.col(f"_v_{c}") - F.col(b)) for c, b in before.items()], F.lit(0.0)))).first()[0]
        work = work.drop(*before.values())
        if change < limit:
            break
    whole = bool(stats[f"w_{at[column]}"])
    value = F.bround(f"_v_{column}", 0 if whole else 2)
    kind = df.schema[column].dataType
    filled = F.coalesce(F.col(column), value.cast(kind if not whole or isinstance(kind, T.IntegralType) else T.LongType()).cast(kind))
    return work.select(*[filled.alias(c) if c == column else F.col(c) for c in df.columns])


def _coded(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The table with one code column per text column, and the category tables."""
    tables = {c: category_table(df, c) for c in columns}
    for i, c in enumerate(columns):
        table = tables[c].withColumnsRenamed({"value": c, "code": f"_c{i}"})
        df = lookup(df, table, [c], [f"_c{i}"], weight="n")
    return df, tables


def neighbour_fills(df: DataFrame, column: str, columns: Sequence[str] | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """One row per distinct pattern of codes that lacks ``column``: the code columns, ``n`` and the filled ``code``.

    Rows are collapsed to distinct patterns with counts. The distance of two patterns uses the columns present in
    both: ``sqrt(all / shared * sum of squares)``. The fill is the mean code of the ``k`` nearest rows, half-even
    rounded; ties are ordered by pattern. Patterns are put in blocks of near ones, and a block of receivers meets only those blocks of
    donors that can hold one of its nearest (``near_blocks``); each block pair keeps the nearest ``k`` rows per receiver, and those are merged.
    """
    columns = list(columns or text_columns(df))
    return _nearest_codes(_coded(df, columns)[0], column, columns, k)


def _nearest_codes(coded: DataFrame, column: str, columns: Sequence[str], k: int) -> DataFrame:
    codes = [f"_c{i}" for i in range(len(columns))]
    target = f"_c{columns.index(column)}"
    patterns = settle(coded.groupBy(*codes).agg(F.count(F.lit(1)).alias("n")))
    dims = [c for c in codes if c != target]
    blocks = settle(pattern_blocks(patterns, target, dims))
    pairs = near_blocks(blocks, dims, len(codes), k)
    left = blocks.filter(F.col(target).isNull()).drop("db").join(pairs, "rb").select(*codes, "n", "rb", "db")
    # Own names: both sides share a source.
    right = blocks.filter(F.col(target).isNotNull()).drop("rb").join(pairs.select("rb", "db"), "db").select(*[F.col(c).alias(f"d{c}") for c in (*codes, "n", "db", "rb")])
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in codes] + [T.StructField("n", T.LongType()), T.StructField("distance", T.DoubleType())]
        + [T.StructField("donor", T.ArrayType(T.LongType())), T.StructField("donors", T.LongType()), T.StructField("value", T.LongType())]
    )

    def nearest(r: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(r) and len(d):
            d = d.rename(columns=lambda c: c[1:]).sort_values(codes, na_position="first", kind="stable")
            a, b = r[codes].to_numpy(float), d[codes].to_numpy(float)
            counts, values = d["n"].to_numpy(), d[target].to_numpy(dtype=np.int64)
            for row, pattern, n in zip(a, r[codes].itertuples(index=False), r["n"]):
                gap = b - row
                shared = (~np.isnan(gap)).sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    dist = np.round(np.sqrt(np.nansum(gap * gap, axis=1) * len(codes) / shared), 12)
                dist[shared == 0] = np.inf
                order = np.argsort(dist, kind="stable")[: k]
                seen = 0
                for j in order:
                    if seen >= k or np.isinf(dist[j]):
                        break
                    out.append((
                        *[None if pd.isna(x) else int(x) for x in pattern], int(n), float(dist[j]),
                        [None if np.isnan(x) else int(x) for x in b[j]], int(counts[j]), int(values[j]),
                    ))
                    seen += counts[j]
        return pd.DataFrame(out, columns=[f.name for f in schema]).astype({c: "Int64" for c in codes})

    near = left.groupBy("rb", "db").cogroup(right.groupBy("drb", "ddb")).applyInPandas(nearest, schema)
    # At most k candidates per receiver and donor block remain.
    nulls_first = F.transform("donor", lambda x: F.coalesce(x, F.lit(-1).cast("long")))
    order = Window.partitionBy(*codes).orderBy("distance", nulls_first)
    before = F.coalesce(F.sum("donors").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = near.withColumn("take", F.greatest(F.lit(0), F.least(F.col("donors"), F.lit(k) - before)))
    mean = F.sum(F.col("value") * F.col("take")).cast("double") / F.sum("take")
    return taken.groupBy(*codes, "n").agg(F.bround(mean, 0).cast("long").alias("code"))


def pattern_blocks(patterns: DataFrame, target: str, dims: Sequence[str]) -> DataFrame:
    """The patterns with ``missing`` (which of ``dims`` are null) and their block, ``rb`` for those that lack ``target``, else ``db``.

    Patterns that lack the same columns are ordered along a curve that keeps near ones together (the bits of their codes interleaved), and
    this order is cut into blocks. Blocks of donors grow with their number so that there are at most about ``DONOR_BLOCKS``.
    """
    seen = patterns.agg(F.count_if(F.col(target).isNotNull()), *[F.max(c) for c in dims]).first()
    size = max(DONOR_BLOCK, -(-seen[0] // DONOR_BLOCKS))
    bits, curve = 10, F.lit(0).cast("long")
    spread = sorted(range(len(dims)), key=lambda i: -(seen[i + 1] or 0))[:6]  # 60 bits at most
    steps = {i: F.coalesce(F.floor(F.col(dims[i]) * F.lit((1 << bits) - 1) / F.lit(max(1, seen[i + 1] or 1))).cast("long"), F.lit(0).cast("long")) for i in spread}
    for bit in range(bits - 1, -1, -1):
        for i in spread:
            curve = F.shiftleft(curve, 1) + F.shiftright(steps[i], bit).bitwiseAND(F.lit(1).cast("long"))
    missing = sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(dims)), F.lit(0).cast("long"))
    rows = patterns.withColumn("missing", missing).withColumn("_lacks", F.col(target).isNull()).withColumn("_curve", curve)
    placed = number_within(rows, ["_lacks", "missing"], ["_curve", *dims, target], "_place")
    cut = F.floor((F.col("_place") - 1) / F.when(F.col("_lacks"), F.lit(RECEIVER_BLOCK)).otherwise(F.lit(size)))
    name = F.concat_ws(":", F.col("missing"), cut)
    return placed.select(*patterns.columns, "missing", F.when(F.col("_lacks"), name).alias("rb"), F.when(~F.col("_lacks"), name).alias("db"))


def near_blocks(blocks: DataFrame, dims: Sequence[str], columns: int, k: int) -> DataFrame:
    """(rb, db): the donor blocks that can hold one of the ``k`` nearest rows of a receiver of the block.

    A block's box spans its smallest and largest code per column. The farthest corners of two boxes bound the distance of their patterns from above;
    the boxes that so hold ``k`` rows set a limit, and a donor block whose nearest corner is beyond it is skipped. Which columns two blocks
    share follows from what they lack, so the distance is the same function within a pair.
    """
    box = [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))]
    names = [x for c in dims for x in (f"lo_{c}", f"hi_{c}")]
    donors = blocks.filter(F.col("db").isNotNull()).groupBy("db").agg(F.sum("n").alias("n"), *box).toPandas()  # DONOR_BLOCKS rows, and one per set of missing columns
    edges = donors[names].to_numpy(float).reshape(len(donors), -1, 2)
    low, high, held, labels = edges[:, :, 0], edges[:, :, 1], donors["n"].to_numpy(float), donors["db"].to_numpy(object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rb, own in zip(pdf["rb"], pdf[names].to_numpy(float).reshape(len(pdf), -1, 2)):
                shared = (~np.isnan(low - own[:, 0])).sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    scale = columns / shared
                    apart = np.sqrt(np.nansum(np.maximum(np.maximum(low - own[:, 1], own[:, 0] - high), 0.0) ** 2, axis=1) * scale)
                    across = np.sqrt(np.nansum(np.maximum(np.abs(high - own[:, 0]), np.abs(own[:, 1] - low)) ** 2, axis=1) * scale)
                apart[shared == 0] = across[shared == 0] = np.inf
                order = np.argsort(across, kind="stable")
                enough = np.searchsorted(np.cumsum(held[order]), k)
                limit = across[order[enough]] if enough < len(order) else np.inf
                met = np.flatnonzero((apart <= limit + 1e-9) & (shared > 0))
                yield pd.DataFrame({"rb": np.full(len(met), rb, object), "db": labels[met]})

    boxes = blocks.filter(F.col("rb").isNotNull()).groupBy("rb").agg(*box)
    return settle(boxes.mapInPandas(run, "rb string, db string"))


def fill_neighbours(df: DataFrame, column: str, columns: Sequence[str] | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """Fill a text column from the nearest rows by their text columns; rows without any neighbour get the mean code."""
    columns = list(columns or text_columns(df))
    coded, tables = _coded(df, columns)
    codes = [f"_c{i}" for i in range(len(columns))]
    fills = _nearest_codes(coded, column, columns, k).withColumnRenamed("code", "_fill")
    found = lookup(coded, fills, codes, ["_fill"], weight="n", null_safe=True)
    mean = tables[column].agg(F.bround(F.sum(F.col("code") * F.col("n")).cast("double") / F.sum("n"), 0).cast("long")).first()[0]
    if mean is None:  # no present value: nothing to fill from
        return df
    needed = found.withColumn("_fill", F.when(F.col(column).isNull(), F.coalesce("_fill", F.lit(mean))))
    back = tables[column].select(F.col("code").alias("_fill"), F.col("value").alias("_value"), "n")
    named = lookup(needed, back, ["_fill"], ["_value"], weight="n")
    return named.select(*[F.coalesce(F.col(column), F.col("_value")).alias(c) if c == column else F.col(c) for c in df.columns])
