"""The numbers behind each chart. Only one-row or one-row-per-group summaries reach the driver."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import ceil, log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_number, numeric_columns, two_digits
from ..plans.lineage import local_rows
from ..plans.lookup import lookup
from ..plans.moments import pair_moments
from ..plans.quantiles import quantiles

# Chart limits.
BINS = 20
BARS = 12
MAX_GROUPS = 8
MAX_BOXES = 12
KDE_POINTS = 200
KDE_REACH = 9.0  # bandwidths; the kernel beyond is below 3e-18 of its peak
FENCE = 1.5
# Up to this many columns every pair has its own aggregates; more are correlated by matrices.
FEW_COLUMNS = 12


def hue_of(column: str | None) -> Column:
    """The colour group of a row; missing is "All"."""
    return F.lit("All") if column is None else F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("All"))


def hue_groups(df: DataFrame, column: str | None, limit: int = MAX_GROUPS) -> list[str]:
    """The colour groups; more than ``limit`` is an error."""
    if column is None:
        return ["All"]
    groups = [r[0] for r in df.select(hue_of(column)).distinct().limit(limit + 1).collect()]
    if len(groups) > limit:
        raise ValueError(f"{column} has more than {limit} groups")
    return sorted(groups)


def group_counts(df: DataFrame, hue: str, limit: int = MAX_GROUPS) -> DataFrame:
    hue_groups(df, hue, limit)
    return df.groupBy(hue_of(hue).alias("hue")).agg(F.count(F.lit(1)).alias("n"))


def _span(df: DataFrame, x: str) -> tuple[int, float, float]:
    c = F.col(x).cast("double")
    r = df.agg(F.count(c), F.min(c), F.max(c)).first()
    return r[0], r[1], r[2]


def histogram(df: DataFrame, x: str, hue: str | None = None, bins: int = BINS) -> DataFrame:
    """Equal bins over the range of all groups; percent of all rows that have a value."""
    n, low, high = _span(df, x)
    if n == 0:
        return df.sparkSession.createDataFrame([], "hue string, bin int, left double, right double, n long, percent double")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    v = F.col(x).cast("double")
    place = F.least(F.lit(bins - 1), F.floor((v - F.lit(low)) / F.lit(width)).cast("int"))
    counts = df.filter(v.isNotNull()).groupBy(hue_of(hue).alias("hue"), place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "hue", "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("left"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("right"), "n", (F.col("n") * F.lit(100.0) / F.lit(n)).alias("percent"),
    )


def density(df: DataFrame, x: str, hue: str | None = None, points: int = KDE_POINTS) -> DataFrame:
    """Gaussian density on a fixed grid over the range of all values, per group and scaled by the group's share.

    A distinct value meets only the grid points within ``KDE_REACH`` bandwidths, so the expanded rows follow the bandwidth and not the grid; what is
    dropped is far below rounding. The partial sums leave a task as one row per grid point and group.
    """
    n, low, high = _span(df, x)
    if n == 0:
        return df.sparkSession.createDataFrame([], "hue string, point int, x double, density double")
    v = F.col(x).cast("double")
    base = df.filter(v.isNotNull()).select(hue_of(hue).alias("hue"), v.alias("v"))
    width = base.groupBy("hue").agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("v").alias("_s"))
    groups = lookup(base.groupBy("hue", "v").agg(F.count(F.lit(1)).alias("w")), width, ["hue"], ["_n", "_s"], weight="_n")
    bandwidth = F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_s")
    step = (high - low) / (points - 1)
    at = F.lit(low) + F.col("point") * F.lit(step)
    z = (at - F.col("v")) / F.col("h")
    kernel = F.exp(z * z * -0.5) / (F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
    wide = groups.withColumn("h", bandwidth).filter(F.col("h") > 0)
    met = reach(wide, low, step, points).withColumn("_d", F.col("w") * kernel).select("hue", "point", "_d")
    empty = wide.select("hue").distinct().select("hue", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), F.lit(0.0).alias("_d"))
    return (
        met.unionByName(empty)
        .groupBy("hue", "point")
        .agg(F.sum("_d").alias("_d"))
        .select("hue", "point", at.alias("x"), (F.col("_d") / F.lit(float(n))).alias("density"))
    )


def reach(values: DataFrame, low: float, step: float, points: int) -> DataFrame:
    """One row per value ``v`` of bandwidth ``h`` and grid point within its reach, as ``point``."""
    if step <= 0:
        return values.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    first = F.ceil((F.col("v") - KDE_REACH * F.col("h") - low) / step)
    last = F.floor((F.col("v") + KDE_REACH * F.col("h") - low) / step)
    first, last = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(points - 1)).cast("int")
    return values.filter(first <= last).withColumn("point", F.explode(F.sequence(first, last)))


def _number_label(v: Column) -> Column:
    """A number in full: without exponent, trailing zeros or a point at the end."""
    plain = F.regexp_replace(v.cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
    return F.when(F.abs(v) < 1e20, F.when(plain.isin("", "-0", "-"), "0").otherwise(plain)).otherwise(v.cast("string"))


def _short(v: Column) -> Column:
    """A number with at most two digits after the point, without trailing zeros."""
    return F.rtrim(F.rtrim(F.format_string("%.2f", v), F.lit("0")), F.lit("."))


def bar_bins(df: DataFrame, x: str, hue: str | None = None, limit: int = MAX_GROUPS) -> DataFrame:
    """Bars for few numbers or for text, else Sturges bins: columns ``hue``, ``label``, ``n``.

    Few numbers are grouped by the number itself and labelled in full. Sturges bins have the column ``bin`` as well, since two
    of them can have the same rounded label.
    """
    hue_groups(df, hue, limit)
    if not is_number(df.schema[x].dataType):
        present = df.filter(F.nullif(F.col(x).cast("string"), F.lit("")).isNotNull())
        return present.groupBy(hue_of(hue).alias("hue"), F.col(x).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    v = F.col(x).cast("double")
    present = df.filter(v.isNotNull())
    if len(present.select(v).distinct().limit(BARS + 1).collect()) <= BARS:
        return present.groupBy(hue_of(hue).alias("hue"), v.alias("_v")).agg(F.count(F.lit(1)).alias("n")).select("hue", _number_label(F.col("_v")).alias("label"), "n")
    n, low, high = _span(df, x)
    k = min(20, max(5, ceil(log2(n) + 1)))
    width = (high - low) / k or 1.0
    place = F.least(F.lit(k - 1), F.floor((v - F.lit(low)) / F.lit(width)).cast("int"))
    counts = present.groupBy(hue_of(hue).alias("hue"), place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    left, right = F.lit(low) + F.col("bin") * F.lit(width), F.lit(low) + (F.col("bin") + 1) * F.lit(width)
    return counts.select("hue", "bin", F.concat(_short(left), F.lit(" to "), _short(right)).alias("label"), "n")


def box_group(df: DataFrame, by: str | None, y: str, groups: str = "all") -> Column:
    """The box of a row. ``all``: every value of ``by`` is a box. ``web``: only a text column with 2 to 12 values groups, else one box."""
    if groups not in ("all", "web"):
        raise ValueError("groups is all or web")
    if by is None:
        return F.lit(y)
    if groups == "all":
        return F.col(by).cast("string")
    if is_number(df.schema[by].dataType):
        return F.lit(y)
    values = df.filter(F.col(by).isNotNull()).select(by).distinct().limit(MAX_BOXES + 1).count()
    return F.col(by).cast("string") if 2 <= values <= MAX_BOXES else F.lit(y)


def _fences(df: DataFrame, y: str, by: str | None, groups: str) -> tuple[DataFrame, DataFrame]:
    data = df.withColumn("box", box_group(df, by, y, groups)).filter(F.col("box").isNotNull() & F.col(y).isNotNull())
    q = quantiles(data, [y], (0.25, 0.5, 0.75), by=["box"])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    stats = q.groupBy("box").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("n").alias("_n"))
    spread = (F.col("q3") - F.col("q1")) * FENCE
    stats = stats.select("*", (F.col("q1") - spread).alias("low_fence"), (F.col("q3") + spread).alias("high_fence"))
    return data, lookup(data, stats, ["box"], ["q1", "median", "q3", "low_fence", "high_fence"], weight="_n")


def box_stats(df: DataFrame, y: str, by: str | None = None, groups: str = "all") -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and number of outliers per box."""
    _, data = _fences(df, y, by, groups)
    v = F.col(y).cast("double")
    inside = v.between(F.col("low_fence"), F.col("high_fence"))
    return data.groupBy("box").agg(
        F.count(F.lit(1)).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"),
        F.count_if(~inside).alias("outliers"),
    )


def outlier_rows(df: DataFrame, y: str, by: str | None = None, groups: str = "all") -> DataFrame:
    """The rows outside the fences of their box."""
    _, data = _fences(df, y, by, groups)
    v = F.col(y).cast("double")
    return data.filter(~v.between(F.col("low_fence"), F.col("high_fence"))).select(*df.columns, "box", "low_fence", "high_fence")


def scatter(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Points with both values present."""
    for c in (x, y):
        if not is_number(df.schema[c].dataType):
            raise ValueError(f"{c} is not numeric")
    return df.select(F.col(x).alias("x"), F.col(y).alias("y"), hue_of(hue).alias("hue")).dropna(subset=["x", "y"])


def line(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Mean of y per x and group, sorted by x."""
    present = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return (
        present.groupBy(F.col(x).alias("x"), hue_of(hue).alias("hue"))
        .agg(F.avg(F.col(y).cast("double")).alias("mean_y"))
        .orderBy("x", "hue")
    )


def line_with_gaps(df: DataFrame, x: str, y: str, hue: str | None = None, limit: int = MAX_GROUPS) -> DataFrame:
    """As ``line`` with 2 digits, and a null for every (x, group) without values."""
    groups = hue_groups(df, hue, limit)
    v = F.col(y).cast("double")
    means = [F.avg(F.when(F.col("_hue") == g, v)).alias(f"m_{i}") for i, g in enumerate(groups)]
    wide = df.filter(F.col(x).isNotNull()).withColumn("_hue", hue_of(hue)).groupBy(F.col(x).alias("x")).agg(*means)
    cells = F.array(*[F.struct(F.lit(g).alias("hue"), two_digits(F.col(f"m_{i}")).alias("mean_y")) for i, g in enumerate(groups)])
    return wide.select("x", F.explode(cells).alias("_c")).select("x", "_c.*").orderBy("x", "hue")


def correlation(df: DataFrame, columns: Sequence[str] | None = None, undefined: float | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over the rows where both are present; one scan.

    More than ``FEW_COLUMNS`` columns are summed as matrices in Arrow batches, so the plan does not grow with the pairs.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        raise ValueError("correlation needs two numeric columns")
    if len(columns) > FEW_COLUMNS:
        return _correlation_of_many(df, columns, undefined)
    aggs, cells = [], []
    for i, (a, b) in enumerate(combinations(columns, 2)):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        aggs += [
            F.covar_pop(x, y).alias(f"c_{i}"),
            F.stddev_pop(F.when(both, x)).alias(f"x_{i}"),
            F.stddev_pop(F.when(both, y)).alias(f"y_{i}"),
        ]
        r = F.try_divide(F.col(f"c_{i}"), F.col(f"x_{i}") * F.col(f"y_{i}"))
        if undefined is not None:
            r = F.coalesce(r, F.lit(float(undefined)))
        cells += [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")), F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), r.alias("r"))]
    for i, a in enumerate(columns):
        aggs.append(F.stddev_pop(F.col(a).cast("double")).alias(f"s_{i}"))
        own = F.when(F.col(f"s_{i}") > 0, F.lit(1.0)) if undefined is None else F.lit(1.0)
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(a).alias("b"), own.alias("r")))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def _correlation_of_many(df: DataFrame, columns: list[str], undefined: float | None) -> DataFrame:
    found = pair_moments(df, columns)
    r = np.full((len(columns), len(columns)), np.nan) if found is None else found.correlation()
    np.fill_diagonal(r, np.where(np.isnan(np.diag(r)) & (undefined is None), np.nan, 1.0))
    other = None if undefined is None else float(undefined)
    cells = [(a, b, other if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return local_rows(df.sparkSession, cells, "a string, b string, r double")


def split_shares(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and percent per split."""
    total = df.count()
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.col("n") * 100.0 / F.lit(total))
