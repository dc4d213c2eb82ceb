"""Filling missing values: fit a one-row-per-column parameter table, then replace nulls.

Fitting and filling are separate, so parameters can be fitted on the training part of a split only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import is_number
from ..plans.lineage import local_rows
from ..plans.quantiles import quantiles
from ..plans.rows import fill_along, with_row_id
from .profile import column_modes

STATISTICS = ("mean", "median", "mode")


def methods_for(kind: T.DataType) -> list[str]:
    """The fill methods offered for a column type."""
    if is_number(kind):
        return ["mean", "median", "mode", "constant", "ffill", "bfill", "model"]
    return ["mode", "constant", "ffill", "bfill", "neighbours"]


def fit(
    df: DataFrame,
    methods: dict[str, str],
    constants: dict[str, object] | None = None,
    rounding: str = "auto",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Parameters: ``column``, ``method``, ``missing``, ``value`` (as text; null when nothing can be fitted).

    ``methods`` maps a column to mean, median, mode or constant. ``rounding="auto"`` rounds means and medians to
    whole numbers for whole-valued columns and to 2 digits otherwise; ``"none"`` keeps them. Mode ties go to the
    smallest value, or with ``order_by`` to the value seen first. Unknown columns are ignored.
    """
    constants = constants or {}
    methods = {c: m for c, m in methods.items() if c in df.columns}
    for c, m in methods.items():
        number = is_number(df.schema[c].dataType)
        if m not in (*STATISTICS, "constant"):
            raise ValueError(f"unknown fill method: {m}")
        if m in ("mean", "median") and not number:
            raise ValueError(f"{m} needs a numeric column, {c} is not")
        if m == "constant":
            value = constants.get(c, None if number else "Missing")
            if value is None or value == "":
                raise ValueError(f"a fill value is needed for {c}")
            if number:
                float(str(value))
    columns = list(methods)
    numbers = [c for c in columns if is_number(df.schema[c].dataType)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs.append(F.count(c).alias(f"p_{i}"))
        if c in numbers:
            aggs += [F.avg(c).alias(f"a_{i}"), F.bool_and(F.col(c).cast("double") == F.floor(F.col(c).cast("double"))).alias(f"w_{i}")]
    wide = df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(columns):
        value = None
        if methods[c] == "mean":
            value = wide[f"a_{i}"]
        elif methods[c] == "constant":
            value = str(constants.get(c, "Missing"))
        rows.append((c, methods[c], wide["n"] - wide[f"p_{i}"], bool(wide[f"w_{i}"]) if c in numbers else None,
                     float(value) if methods[c] == "mean" and value is not None else None,
                     value if methods[c] == "constant" else None))
    params = local_rows(
        df.sparkSession, rows, "column string, method string, missing bigint, whole boolean, number double, text string"
    )
    medians = [c for c, m in methods.items() if m == "median"]
    if medians:
        q = quantiles(df, medians, (0.5,), rows=wide["n"]).select("column", F.col("quantile").alias("_q"))
        params = params.join(q, "column", "left").withColumn("number", F.coalesce("number", "_q")).drop("_q")
    modes = [c for c, m in methods.items() if m == "mode"]
    if modes:
        m = column_modes(df, modes, order_by).select("column", F.col("mode").alias("_m"))
        params = params.join(m, "column", "left").withColumn("text", F.coalesce("text", "_m")).drop("_m")
    if rounding == "auto":
        params = params.withColumn(
            "number", F.when(F.col("whole"), F.bround("number", 0)).otherwise(F.bround("number", 2))
        )
    return params.select("column", "method", "missing", F.coalesce(F.col("number").cast("string"), "text").alias("value"))


def transform(df: DataFrame, params: DataFrame) -> DataFrame:
    """Replace nulls by the fitted values. The parameter table has one row per column, so it is read once."""
    values = {r["column"]: r["value"] for r in params.collect()}
    out = []
    for field in df.schema:
        c = F.col(field.name)
        value = values.get(field.name)
        if value is not None:
            fill = F.lit(value)
            if isinstance(field.dataType, T.IntegralType):
                fill = fill.cast("double").cast(field.dataType)
            elif not isinstance(field.dataType, T.StringType):
                fill = fill.cast(field.dataType)
            c = F.coalesce(c, fill)
        out.append(c.alias(field.name))
    return df.select(*out)


def fill(df: DataFrame, methods: dict[str, str], **options) -> DataFrame:
    """Fit on the table and fill it."""
    return transform(df, fit(df, methods, **options))


def preview(df: DataFrame, methods: dict[str, str], **options) -> DataFrame:
    """What a fill would do, before doing it: type, missing count, method and replacement value per column."""
    kinds = local_rows(
        df.sparkSession, [(c, df.schema[c].dataType.simpleString(), methods_for(df.schema[c].dataType)) for c in methods if c in df.columns],
        "column string, type string, offered array<string>",
    )
    return kinds.join(fit(df, methods, **options), "column")


def forward_fill(df: DataFrame, column: str, order_by: Sequence[str], row: str = "_row") -> DataFrame:
    """The last present value above, in the given order; leading gaps stay. Keeps the row number column."""
    numbered = df if row in df.columns else with_row_id(df, order_by, row)
    return fill_along(numbered, column, row, forward=True)


def backward_fill(df: DataFrame, column: str, order_by: Sequence[str], row: str = "_row") -> DataFrame:
    """The next present value below, in the given order; trailing gaps stay."""
    numbered = df if row in df.columns else with_row_id(df, order_by, row)
    return fill_along(numbered, column, row, forward=False)
