"""Renaming, reordering and dropping columns, and the audit of changed cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename(df: DataFrame, old: str, new: str, strict: bool = True) -> DataFrame:
    """Rename a column. Strict: the old name must exist and the new one be free; else an unknown name changes nothing."""
    if old not in df.columns:
        if strict:
            raise ValueError(f"no column {old}")
        return df
    if not new or not new.strip():
        if strict:
            raise ValueError("the new name is empty")
        return df
    if new != old and new in df.columns:
        raise ValueError(f"there is already a column {new}")
    return df.withColumnRenamed(old, new)


def swap(df: DataFrame, first: str, second: str) -> DataFrame:
    """Exchange the positions of two columns; an unknown name changes nothing."""
    if first not in df.columns or second not in df.columns:
        return df
    turn = {first: second, second: first}
    return df.select(*[turn.get(c, c) for c in df.columns])


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def cell_changes(before: DataFrame, after: DataFrame, key: Sequence[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """Cells that differ between two states of a table: key columns, ``column``, ``old``, ``new`` (as text).

    Rows are matched by key, so removed rows are left out; ``renamed`` maps old to new column names.
    Both tables meet in one join on the key, and only differing cells are written out.
    """
    renamed = renamed or {}
    key = list(key)
    pairs = [(c, renamed.get(c, c)) for c in before.columns if c not in key and renamed.get(c, c) in after.columns]
    left = before.select(*key, F.struct(*[F.col(o).cast("string").alias(n) for o, n in pairs]).alias("_old"))
    right = after.select(*key, F.struct(*[F.col(n).cast("string").alias(n) for _, n in pairs]).alias("_new"))
    cells = F.array(
        *[
            F.when(
                ~F.col("_old")[n].eqNullSafe(F.col("_new")[n]),
                F.struct(F.lit(n).alias("column"), F.col("_old")[n].alias("old"), F.col("_new")[n].alias("new")),
            )
            for _, n in pairs
        ]
    )
    met = left.join(right, key)
    return met.select(*key, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("_c")).select(*key, "_c.*")
