"""Column expressions on table cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that a CSV reader takes as a missing cell, as the pandas documentation lists them.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Fixed value: a text is a date when it starts like this and can be read as one.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}"


# A text is a number when it looks like one; the cast alone would also take "1d", "2f" and "Infinity".
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number_of(text: Column) -> Column:
    """The number that a text shows, else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_number(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def blank_to_null(df: DataFrame, empty_is_null: bool = True, na_tokens: list[str] | None = None) -> DataFrame:
    """NaN becomes null; empty text (and optionally the given NA texts) becomes null. Done once at load."""
    out = []
    for field in df.schema:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(field.dataType, T.StringType):
            if na_tokens:
                c = F.when(~c.isin(na_tokens), c)
            elif empty_is_null:
                c = F.nullif(c, F.lit(""))
        out.append(c.alias(field.name))
    return df.select(*out)


def whole(value: Column, is_whole: Column) -> Column:
    """Rounding of a fitted statistic: to a whole number when the column holds whole numbers, else to 2 digits."""
    return F.when(is_whole, F.bround(value, 0)).otherwise(F.bround(value, 2))


def two_digits(value: Column) -> Column:
    """Two digits, half up, after removing the noise of floating sums, so that x.xx5 does not depend on row order."""
    return F.round(F.round(value, 8), 2)
