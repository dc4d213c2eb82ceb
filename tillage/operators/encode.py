"""Turning categories and dates into numbers.

``category_table`` is the fitted half: one row per category with its count and code. The encoders look values
up in it; a table too large to broadcast is joined by shuffling with hot categories spread (``plans.lookup``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import ISO_DATE, is_date, is_number
from ..plans.lineage import local_rows, pinned
from ..plans.lookup import lookup
from ..plans.rows import hash_key, with_row_id

# Fixed value: more one-hot columns than this need a confirmation.
MAX_ONE_HOT = 30


def category_table(df: DataFrame, column: str, order_by: Sequence[str] | None = None, as_text: bool = False) -> DataFrame:
    """Columns ``value``, ``n``, ``code``: the present values, sorted (or in first-seen order), coded 0..k-1."""
    value = F.col(column).cast("string") if as_text else F.col(column)
    first = F.min(F.struct(*order_by)) if order_by else F.lit(0)
    cats = (
        df.select(value.alias("value"), *(order_by or []))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    )
    cats, few = pinned(cats)
    if not few:
        return with_row_id(cats, ["first", "value"] if order_by else ["value"], "code").select("value", "n", "code")
    rows = sorted(cats.collect(), key=lambda r: (tuple(r["first"]), r["value"]) if order_by else r["value"])
    kind = df.schema[column].dataType if not as_text else T.StringType()
    schema = T.StructType(
        [T.StructField("value", kind), T.StructField("n", T.LongType()), T.StructField("code", T.LongType())]
    )
    return local_rows(df.sparkSession, [(r["value"], r["n"], i) for i, r in enumerate(rows)], schema)


def check_encodable(df: DataFrame, column: str, method: str) -> None:
    """Errors for a column that the method does not fit. Looks at the type and at one present value only."""
    kind = df.schema[column].dataType
    if not df.filter(F.col(column).isNotNull()).select(column).take(1):
        raise ValueError(f"{column} has no values to encode")
    if is_number(kind):
        raise ValueError(f"{column} is already numeric")
    if is_date(kind) != (method == "dates") and not (method == "dates" and isinstance(kind, T.StringType)):
        raise ValueError("date columns take date parts, and only date columns do")
    if method == "dates" and isinstance(kind, T.StringType):
        if df.filter(F.col(column).isNotNull() & ~F.col(column).rlike(ISO_DATE)).take(1):
            raise ValueError(f"{column} is not a date column")


def _replace(df: DataFrame, column: str, new: Sequence[Column], at_end: bool = False) -> list:
    out = []
    for c in df.columns:
        if c != column:
            out.append(F.col(c))
        elif not at_end:
            out += new
    return out + (list(new) if at_end else [])


def one_hot(
    df: DataFrame,
    column: str,
    categories: DataFrame | None = None,
    null_column: bool = False,
    at_end: bool = False,
    order_by: Sequence[str] | None = None,
    max_columns: int = MAX_ONE_HOT,
) -> DataFrame:
    """One 0/1 column ``column_value`` per category, in place of the column or at the end."""
    table = category_table(df, column, order_by) if categories is None else categories
    values = [r["value"] for r in table.orderBy("code").limit(max_columns + 1).collect()]
    if len(values) > max_columns:
        raise ValueError(f"{column} has more than {max_columns} categories; raise max_columns to confirm")
    new = [
        F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values
    ]
    if null_column:
        new.append(F.col(column).isNull().cast("int").alias(f"{column}_null"))
    return df.select(*_replace(df, column, new, at_end))


def ordinal(df: DataFrame, column: str, categories: DataFrame | None = None, unseen: int = -1) -> DataFrame:
    """Sorted categories to 0..k-1. Null stays null; a value unknown at fit time becomes ``unseen``."""
    table = category_table(df, column) if categories is None else categories
    found = lookup(df, table.withColumnRenamed("value", column), [column], ["code"], weight="n")
    code = F.when(F.col(column).isNotNull(), F.coalesce("code", F.lit(unseen).cast("long"))).alias(column)
    return found.select(*_replace(df, column, [code]))


def ordinal_by(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Codes in the user's order. Every present value must be listed."""
    wanted = [v.strip() for v in order]
    missing = (
        df.filter(F.col(column).isNotNull() & ~F.col(column).cast("string").isin(wanted)).select(column).distinct().take(20)
    )
    if missing:
        raise ValueError(f"not in the order: {sorted(str(r[0]) for r in missing)}")
    codes = F.create_map(*[x for i, v in enumerate(wanted) for x in (F.lit(v), F.lit(i).cast("long"))])
    return df.select(*_replace(df, column, [F.try_element_at(codes, F.col(column).cast("string")).alias(column)]))


def label(df: DataFrame, column: str) -> DataFrame:
    """Distinct values as text, sorted, 0..k-1; null stays null."""
    table = category_table(df, column, as_text=True).withColumnRenamed("value", "_text")
    found = lookup(df.withColumn("_text", F.col(column).cast("string")), table, ["_text"], ["code"], weight="n")
    return found.select(*_replace(df, column, [F.col("code").alias(column)]))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """The number of rows with the same value; null stays null."""
    table = category_table(df, column).withColumnRenamed("value", column).select(column, F.col("n").alias("_freq"))
    found = lookup(df, table, [column], ["_freq"], weight="_freq")
    return found.select(*_replace(df, column, [F.col("_freq").alias(column)]))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """Sorted category codes with null as -1."""
    out = ordinal(df, column)
    return out.withColumn(column, F.coalesce(column, F.lit(-1).cast("long")))


def _smoothed(n: Column, mean: Column, var: Column, all_mean: Column, all_var: Column) -> Column:
    # Empirical Bayes weight of the category mean, as the public target-encoding documentation gives it.
    weight = F.try_divide(n * all_var, n * all_var + var)
    return F.coalesce(weight * mean + (1 - weight) * all_mean, all_mean)


def target_value(df: DataFrame, target: str) -> Column:
    """The target as a number. A text of two classes counts the second one in order as 1; more classes are an error."""
    if not isinstance(df.schema[target].dataType, T.StringType):
        return F.col(target).cast("double")
    classes = sorted(r[0] for r in df.select(target).dropna().distinct().limit(3).collect())
    if len(classes) != 2:
        raise ValueError(f"the text target {target} needs two classes")
    return F.when(F.col(target) == classes[0], 0.0).when(F.col(target) == classes[1], 1.0)


def target_table(df: DataFrame, column: str, target: str) -> DataFrame:
    """Columns ``value``, ``n``, ``encoding``: the smoothed mean of the target per category (null is a category)."""
    y = target_value(df, target)
    if df.filter(y.isNull()).take(1):
        raise ValueError(f"the target {target} has gaps")
    total = df.agg(F.avg(y).alias("m"), F.var_pop(y).alias("v")).first()
    stats = df.groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")
    )
    return stats.select(
        "value", "n", _smoothed(F.col("n"), F.col("m"), F.col("v"), F.lit(total["m"]), F.lit(total["v"])).alias("encoding")
    )


def target(df: DataFrame, column: str, target_column: str, table: DataFrame | None = None) -> DataFrame:
    """Fit once, encode every row. A value unknown at fit time gets the overall mean of the target."""
    mean = df.agg(F.avg(target_value(df, target_column))).first()[0] if table is None else None
    fitted = target_table(df, column, target_column) if table is None else table
    if mean is None:
        mean = fitted.agg(F.sum(F.col("encoding") * F.col("n")) / F.sum("n")).first()[0]
    found = lookup(df, fitted.withColumnRenamed("value", column), [column], ["encoding"], weight="n", null_safe=True)
    return found.select(*_replace(df, column, [F.coalesce("encoding", F.lit(mean)).alias(column)]))


def target_folds(df: DataFrame, column: str, target_column: str, key: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Cross-fitted target encoding: a row is encoded from the other folds only. The fold is a hash of its key."""
    y = target_value(df, target_column)
    fold = (F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("long") % folds).cast("int")
    data = df.withColumn("_fold", fold)
    sums = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q")]
    part = data.groupBy(F.col(column).alias("value"), "_fold").agg(*sums)
    by_fold = {r["_fold"]: r for r in data.groupBy("_fold").agg(*sums).collect()}  # one row per fold
    n, s, q = (sum(r[k] for r in by_fold.values()) for k in "nsq")
    rest = []
    for f, r in by_fold.items():
        m = n - r["n"]
        mean = (s - r["s"]) / m
        rest.append((f, mean, max(0.0, (q - r["q"]) / m - mean * mean)))
    folds_table = F.broadcast(local_rows(df.sparkSession, rest, "_fold int, all_mean double, all_var double"))
    whole = part.groupBy("value").agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"), F.sum("q").alias("cq"))
    # Only (category, fold) pairs that hold rows are needed.
    same = F.col("p.value").eqNullSafe(F.col("w.value"))
    joined = part.alias("p").join(whole.alias("w"), same).join(folds_table, "_fold")
    m = F.col("cn") - F.col("n")
    mean = F.try_divide(F.col("cs") - F.col("s"), m)
    var = F.greatest(F.lit(0.0), F.try_divide(F.col("cq") - F.col("q"), m) - mean * mean)
    table = joined.select(
        F.col("p.value").alias(column), "_fold", "n",
        F.when(m > 0, _smoothed(m, mean, var, F.col("all_mean"), F.col("all_var"))).otherwise(F.col("all_mean")).alias("encoding"),
    )
    found = lookup(data, table, [column, "_fold"], ["encoding"], weight="n", null_safe=True)
    return found.select(*_replace(df, column, [F.col("encoding").alias(column)]))


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """Replace a date (or ISO date text) column by year, month and day columns in its place."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        c = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    new = [F.year(c).alias(f"{column}_year"), F.month(c).alias(f"{column}_month"), F.dayofmonth(c).alias(f"{column}_day")]
    return df.select(*_replace(df, column, new))
