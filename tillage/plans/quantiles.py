"""Exact quantiles of large columns.

The built-in exact percentile keeps all distinct values of a group in one task. Here a value sketch gives a
narrow bracket around each wanted rank, a second pass counts what lies below the bracket, and only the values
inside the bracket are ordered. Brackets that are still too full are narrowed again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import pinned
from .lookup import lookup
from .rows import unpivot_numbers

# Values of one group that may be ordered by a single task.
BAND_ROWS = 1_000_000
_ACCURACY = 10_000


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = (0.5,),
    by: Sequence[str] = (),
    rows: int | None = None,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles: columns ``by``, ``column``, ``prob``, ``n``, ``quantile``."""
    by = list(by)
    keys = [*by, "column"]
    # The column is a number in the shuffles and becomes its name at the end.
    cells = unpivot_numbers(df, columns, by)
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column") + 1)
    rows = df.count() if rows is None else rows
    if rows <= band_rows:
        counts = cells.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("w"))
        upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy(*keys)
        placed = counts.select(*keys, "value", "w", F.sum("w").over(upto).alias("end"), F.sum("w").over(every).alias("n"))
        wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
        placed = placed.select("*", wanted).withColumn("below", F.lit(0))
    else:
        placed = _banded(cells, keys, probs, band_rows)
    return _pick(placed, keys).withColumn("column", names)


def _pick(placed: DataFrame, keys: list[str]) -> DataFrame:
    """From values with their end position, take the two neighbours of each wanted position."""
    at = F.col("prob") * (F.col("n") - 1)
    end, start = F.col("end") + F.col("below"), F.col("end") + F.col("below") - F.col("w")
    low = F.when((start <= F.floor(at)) & (F.floor(at) < end), F.col("value"))
    high = F.when((start <= F.ceil(at)) & (F.ceil(at) < end), F.col("value"))
    picked = placed.groupBy(*keys, "prob").agg(F.max("n").alias("n"), F.max(low).alias("lo"), F.max(high).alias("hi"))
    frac = F.col("prob") * (F.col("n") - 1) - F.floor(F.col("prob") * (F.col("n") - 1))
    return picked.select(
        *keys, "prob", "n", (F.col("lo") + (F.col("hi") - F.col("lo")) * frac).alias("quantile")
    )


def _banded(cells: DataFrame, keys: list[str], probs: Sequence[float], band_rows: int) -> DataFrame:
    """Values inside a bracket per (key, prob), with positions counted from the start of the whole group."""
    margin = 3.0 / _ACCURACY
    state, _ = pinned(_first_bracket(cells, keys, probs, margin))
    for _ in range(12):
        open_ = state.filter((F.col("inside") > band_rows) & (F.col("lo") < F.col("hi")))
        if not open_.take(1):
            break
        band = _in_band(cells, open_, keys)
        at = F.col("prob") * (F.col("n") - 1)
        # Positions of the wanted ranks inside the band, as shares of the band.
        low = F.greatest(F.lit(0.0), (F.floor(at) - F.col("below")) / F.col("inside") - margin)
        high = F.least(F.lit(1.0), (F.ceil(at) + 1 - F.col("below")) / F.col("inside") + margin)
        sketch = band.groupBy(*keys, "prob").agg(
            F.first("n").alias("n"), F.first("lo").alias("lo0"), F.first("hi").alias("hi0"),
            F.first("below").alias("below"), F.first("inside").alias("inside"),
            F.percentile_approx("value", [i / 2000 for i in range(2001)], _ACCURACY).alias("grid"),
        )
        cut = sketch.select(
            *keys, "prob", "n", "lo0", "hi0", F.col("below").alias("below0"), F.col("inside").alias("inside0"),
            F.element_at("grid", (F.floor(low * 2000) + 1).cast("int")).alias("lo"),
            F.element_at("grid", (F.ceil(high * 2000) + 1).cast("int")).alias("hi"),
        )
        cut, _ = pinned(cut)
        counted = (
            _in_band(cells, cut.withColumnsRenamed({"lo": "lo1", "hi": "hi1", "lo0": "lo", "hi0": "hi"}), keys)
            .groupBy(*keys, "prob")
            .agg(
                *[F.first(c).alias(c) for c in ("n", "lo", "hi", "lo1", "hi1", "below0", "inside0")],
                F.count_if(F.col("value") < F.col("lo1")).alias("under"),
                F.count_if(F.col("value").between(F.col("lo1"), F.col("hi1"))).alias("within"),
            )
        )
        first, last = F.floor(at), F.ceil(at)
        sure = (F.col("below0") + F.col("under") <= first) & (last < F.col("below0") + F.col("under") + F.col("within"))
        # A bracket that missed its rank is not used: the old one stays and is ordered as it is.
        narrowed = counted.select(
            *keys, "prob", "n",
            F.when(sure, F.col("lo1")).otherwise(F.col("lo")).alias("lo"),
            F.when(sure, F.col("hi1")).otherwise(F.col("hi")).alias("hi"),
            F.when(sure, F.col("below0") + F.col("under")).otherwise(F.col("below0")).alias("below"),
            F.when(sure, F.col("within")).otherwise(F.col("inside0")).alias("inside"),
        )
        closed = state.filter(~((F.col("inside") > band_rows) & (F.col("lo") < F.col("hi"))))
        state, _ = pinned(closed.unionByName(narrowed))
    band = _in_band(cells, state, keys)
    counts = band.groupBy(*keys, "prob", "n", "below", "value").agg(F.count(F.lit(1)).alias("w"))
    upto = Window.partitionBy(*keys, "prob").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("end", F.sum("w").over(upto))


def _first_bracket(cells: DataFrame, keys: list[str], probs: Sequence[float], margin: float) -> DataFrame:
    """One sketch pass and one counting pass over all cells: a bracket per (key, prob) with the rows below and inside."""
    k = len(probs)
    wanted = [min(1.0, max(0.0, p + m)) for p in probs for m in (-margin, margin)]
    sketch, _ = pinned(
        cells.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
            F.percentile_approx("value", wanted, _ACCURACY).alias("_g"),
        ).select(*keys, "n", "min", "max", *[F.col("_g")[i].alias(f"g{i}") for i in range(2 * k)])
    )
    met = lookup(cells, sketch, keys, [c for c in sketch.columns if c not in keys], weight="n", null_safe=True)
    counted = met.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in sketch.columns if c not in keys],
        *[F.count_if(F.col("value") < F.col(f"g{2 * i}")).alias(f"u{i}") for i in range(k)],
        *[F.count_if(F.col("value").between(F.col(f"g{2 * i}"), F.col(f"g{2 * i + 1}"))).alias(f"w{i}") for i in range(k)],
    )
    brackets = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        sure = (F.col(f"u{i}") <= F.floor(at)) & (F.ceil(at) < F.col(f"u{i}") + F.col(f"w{i}"))
        pick = lambda a, b, s=sure: F.when(s, a).otherwise(b)
        brackets.append(F.struct(
            F.lit(float(p)).alias("prob"), F.col("n"), pick(F.col(f"g{2 * i}"), F.col("min")).alias("lo"),
            pick(F.col(f"g{2 * i + 1}"), F.col("max")).alias("hi"), pick(F.col(f"u{i}"), F.lit(0)).cast("long").alias("below"),
            pick(F.col(f"w{i}"), F.col("n")).cast("long").alias("inside"),
        ))
    return counted.select(*keys, F.explode(F.array(*brackets)).alias("_b")).select(*keys, "_b.*")


def _in_band(cells: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The cells inside the bracket of each (key, prob)."""
    packed = state.groupBy(*keys).agg(
        F.collect_list(F.struct(*[c for c in state.columns if c not in keys])).alias("bands"),  # one entry per prob
        F.max("n").alias("_w"),
    )
    met = lookup(cells, packed, keys, ["bands"], weight="_w", null_safe=True).filter(F.col("bands").isNotNull())
    hit = F.filter("bands", lambda b: F.col("value").between(b["lo"], b["hi"]))
    return met.select(*keys, "value", F.explode(hit).alias("_b")).select(*keys, "value", "_b.*")
