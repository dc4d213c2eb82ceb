"""What is in a table and how healthy it is. Every statistic of every column comes from as few scans as possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import ISO_DATE, is_date, is_number, number_of, numeric_columns
from ..plans.lineage import pinned
from ..plans.quantiles import quantiles
from ..plans.rows import with_row_id
from .dedup import extra_copies, mostly_repeated

# Weights and bands of the table health score, and the bounds of a stratification column.
HEALTH_MISSING_WEIGHT = 0.6
HEALTH_DUPLICATE_WEIGHT = 0.4
HEALTH_GOOD = 90
HEALTH_FAIR = 70
MAX_STRATA = 20


def _kind(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType
    return "numeric" if is_number(kind) else "date" if is_date(kind) else "text"


def _rows_of(wide: DataFrame, columns: Sequence[str], cells: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per column from a one-row wide aggregate."""
    entries = [F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in cells[c].items()]) for c in columns]
    return wide.select(F.explode(F.array(*entries)).alias("_r")).select("_r.*")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct non-null values per column: columns ``column``, ``distinct_values``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(cells).alias("_c"))
        .select("_c.column", "_c.value")
        .distinct()
        .groupBy("column")
        .agg(F.count("value").alias("distinct_values"))
    )


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, total, nulls; median/min/max of numbers, min/max of dates, distinct count of text."""
    columns = df.columns
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs.append(F.count(c).alias(f"present_{i}"))
        if _kind(df, c) != "text":
            aggs += [F.min(c).alias(f"min_{i}"), F.max(c).alias(f"max_{i}")]
    wide, _ = pinned(df.agg(*aggs))
    cells = {}
    for i, c in enumerate(columns):
        kind = _kind(df, c)
        number, date = kind == "numeric", kind == "date"
        cells[c] = {
            "type": F.lit(kind),
            "total": F.col("n"),
            "nulls": F.col("n") - F.col(f"present_{i}"),
            "min": (F.col(f"min_{i}") if number else F.lit(None)).cast("double"),
            "max": (F.col(f"max_{i}") if number else F.lit(None)).cast("double"),
            "first_date": F.date_format(f"min_{i}", "yyyy-MM-dd") if date else F.lit(None).cast("string"),
            "last_date": F.date_format(f"max_{i}", "yyyy-MM-dd") if date else F.lit(None).cast("string"),
        }
    out = _rows_of(wide, columns, cells)
    numbers = numeric_columns(df)
    texts = [c for c in columns if _kind(df, c) == "text"]
    if numbers:
        rows = wide.first()["n"]
        medians = quantiles(df, numbers, (0.5,), rows=rows).select("column", F.col("quantile").alias("median"))
        out = out.join(medians, "column", "left")
    else:
        out = out.withColumn("median", F.lit(None).cast("double"))
    if texts:
        out = out.join(distinct_counts(df, texts), "column", "left")
        # A text column without any present value has zero values.
        out = out.withColumn("distinct_values", F.when(F.col("type") == "text", F.coalesce("distinct_values", F.lit(0))))
    else:
        out = out.withColumn("distinct_values", F.lit(None).cast("long"))
    return out


def column_modes(df: DataFrame, columns: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """Most frequent present value (as text) per column with its count.

    A tie goes to the smallest value, or with ``order_by`` to the value seen first in that order.
    """
    order = list(order_by or [])
    first = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = (
        df.select(F.explode(cells).alias("_c"), first.alias("_first"))
        .filter(F.col("_c.value").isNotNull())
        .groupBy("_c.column", "_c.value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_first").alias("_first"))
    )
    # Numbers tie by value, not by their text.
    numbers = [c for c in columns if is_number(df.schema[c].dataType)]
    as_number = F.when(F.col("column").isin(numbers), F.expr("try_cast(value AS double)")) if numbers else F.lit(None).cast("double")
    rank = F.struct((-F.col("n")).alias("n"), F.col("_first"), as_number.alias("number"), F.col("value"))
    best = counts.groupBy("column").agg(F.min(rank).alias("_b"))
    return best.select("column", F.col("_b.value").alias("mode"), (-F.col("_b.n")).alias("mode_count"))


def column_overview(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """The overview table: type, missing, missing %, mean and range of numbers, range of dates, mode of text."""
    columns = df.columns
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        kind = _kind(df, c)
        aggs.append(F.count(c).alias(f"present_{i}"))
        if kind != "text":
            aggs += [F.min(c).alias(f"min_{i}"), F.max(c).alias(f"max_{i}")]
        if kind == "numeric":
            aggs.append(F.avg(c).alias(f"avg_{i}"))
    cells = {}
    for i, c in enumerate(columns):
        kind = _kind(df, c)
        missing = F.col("n") - F.col(f"present_{i}")
        no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
        cells[c] = {
            "type": F.lit(kind),
            "missing": missing,
            "missing_pct": F.round(F.try_divide(missing * 100, F.col("n")), 2),
            "mean": F.round(f"avg_{i}", 2) if kind == "numeric" else no_number,
            "min": F.col(f"min_{i}").cast("double") if kind == "numeric" else no_number,
            "max": F.col(f"max_{i}").cast("double") if kind == "numeric" else no_number,
            "first_date": F.date_format(f"min_{i}", "yyyy-MM-dd") if kind == "date" else no_text,
            "last_date": F.date_format(f"max_{i}", "yyyy-MM-dd") if kind == "date" else no_text,
        }
    out = _rows_of(df.agg(*aggs), columns, cells)
    texts = [c for c in columns if _kind(df, c) == "text"]
    if not texts:
        return out.withColumn("mode", F.lit(None).cast("string"))
    return out.join(column_modes(df, texts, order_by).select("column", "mode"), "column", "left")


def null_cells(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per null cell: the key columns and the column name. Values are never copied."""
    names = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in df.columns if c not in key]), lambda x: x.isNotNull()
    )
    return df.select(*key, F.explode(names).alias("column"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls, share of nulls and completeness per column, most nulls first."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"p_{i}") for i, c in enumerate(df.columns)])
    cells = {
        c: {
            "missing": F.col("n") - F.col(f"p_{i}"),
            "completeness_pct": F.round(F.try_divide(F.col(f"p_{i}") * 100, F.col("n")), 2),
        }
        for i, c in enumerate(df.columns)
    }
    return _rows_of(wide, df.columns, cells).orderBy(F.desc("missing"), "column")


def semantic_types(df: DataFrame) -> DataFrame:
    """Type of each text column judged by its present values: numeric, date or text. All-null is text."""
    aggs, cells = [], {}
    for i, c in enumerate(df.columns):
        text = F.nullif(F.col(c).cast("string"), F.lit(""))
        number = number_of(text).isNotNull()
        date = text.rlike(ISO_DATE) & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull()
        aggs += [
            F.count(text).alias(f"n_{i}"),
            F.bool_and(F.when(text.isNotNull(), number)).alias(f"num_{i}"),
            F.bool_and(F.when(text.isNotNull(), date)).alias(f"date_{i}"),
        ]
        kind = F.when(F.col(f"n_{i}") == 0, "text").when(F.col(f"num_{i}"), "numeric").when(F.col(f"date_{i}"), "date")
        cells[c] = {"semantic_type": kind.otherwise("text")}
    return _rows_of(df.agg(*aggs), df.columns, cells)


def _issue_totals(df: DataFrame) -> DataFrame:
    """One row: rows, cells, null cells, columns with gaps, duplicate rows. Only row hashes and possible copies are shuffled."""
    columns = df.columns
    if mostly_repeated(df, columns):  # one pass: whole rows are grouped, and nulls are counted by group
        rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        extra = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
    else:
        rows, extra = df.withColumn("_n", F.lit(1)), F.lit(extra_copies(df))
    gaps = [F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n"))), F.lit(0)).alias(f"g_{i}") for i, c in enumerate(columns)]
    counts = rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), *gaps, extra.cast("long").alias("duplicate_rows"))
    none = F.lit(0).cast("long")
    return counts.select(
        "rows", (F.col("rows") * len(columns)).alias("cells"),
        sum((F.col(f"g_{i}") for i in range(len(columns))), none).alias("missing_cells"),
        sum(((F.col(f"g_{i}") > 0).cast("long") for i in range(len(columns))), none).alias("columns_with_gaps"),
        "duplicate_rows",
    )


def health_score(missing_pct: Column, duplicate_pct: Column) -> Column:
    raw = 100 - (missing_pct * HEALTH_MISSING_WEIGHT + duplicate_pct * HEALTH_DUPLICATE_WEIGHT)
    return F.greatest(F.lit(0.0), F.floor(raw + 0.5).cast("double"))


def table_health(df: DataFrame) -> DataFrame:
    """Health score 0..100 of a table from its share of missing cells and of duplicate rows."""
    pct = _issue_totals(df).select(
        "rows", "cells", "missing_cells", "duplicate_rows",
        F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, F.col("cells")), F.lit(0.0)).alias("m"),
        F.coalesce(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("rows")), F.lit(0.0)).alias("d"),
    )
    score = health_score(F.col("m"), F.col("d"))
    band = F.when(F.col("health") >= HEALTH_GOOD, "good").when(F.col("health") >= HEALTH_FAIR, "fair").otherwise("poor")
    return pct.withColumn("health", score).select(
        "rows", "cells", "missing_cells", "duplicate_rows", "health", band.alias("band")
    )


def issue_summary(df: DataFrame) -> DataFrame:
    return _issue_totals(df).select("columns_with_gaps", "duplicate_rows")


def dataset_size(df: DataFrame) -> DataFrame:
    """Rows, columns and cells of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"), (F.col("rows") * len(df.columns)).alias("cells")
    )


def rows_with_gaps(df: DataFrame) -> DataFrame:
    """Rows with at least one null."""
    missing = F.lit(False)
    for c in df.columns:
        missing = missing | F.col(c).isNull()
    return df.filter(missing)


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows where any column contains the text, ignoring case; null counts as empty."""
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle)
    return df.filter(hit)


EARLY_ROWS = 10_000  # pages up to this row are taken from the top of the order


def page(df: DataFrame, number: int, order_by: Sequence[str], size: int = 20) -> DataFrame:
    """One page of the rows in the given order, with its 0-based position. The page number is clamped.

    Early pages need only the first rows of every task, later ones need the order of all rows. The result is the same.
    """
    total = df.count()
    number = min(max(1, number), max(1, -(-total // size)))
    if number * size <= EARLY_ROWS:
        first = df.orderBy(*order_by).limit(number * size)
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order_by)) - 1  # at most EARLY_ROWS rows
        return first.withColumn("position", place.cast("long")).filter(F.col("position") >= (number - 1) * size)
    numbered = with_row_id(df, order_by, "position")
    return numbered.filter(F.col("position").between((number - 1) * size, number * size - 1))


def stratify_columns(df: DataFrame) -> DataFrame:
    """Columns that can be kept balanced by a split: 2 to 20 distinct values (null is one) and fewer than rows.

    An approximate count removes the columns that are far beyond the bound; the others are counted exactly.
    """
    about = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c, 0.05).alias(f"d_{i}") for i, c in enumerate(df.columns)]
    ).first()
    near = [c for i, c in enumerate(df.columns) if about[f"d_{i}"] <= MAX_STRATA * 2]
    if not near:
        return df.sparkSession.createDataFrame([], "column string, distinct_values long")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in near])
    return (
        df.select(F.explode(cells).alias("_c"))
        .select("_c.*")
        .distinct()
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("distinct_values"))
        .filter((F.col("distinct_values") > 1) & (F.col("distinct_values") <= MAX_STRATA) & (F.col("distinct_values") < about["n"]))
    )
