"""Small helpers shared by the operators: selecting id and text, Arrow batches, words.

Every operator first selects its own columns under internal names, so extra columns of a table, whatever they are
called, never reach it. A null text counts as an empty one unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the contracts: runs of anything but the ASCII white space. bytes.split() cuts at the same six characters.
SPACE = r"[\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\r\x0b\x0c"


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """The id as ``_id`` and the text, null as empty, as ``_text``; any ``more`` columns behind them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("_id"), text.alias("_text"), *more)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; a dict of columns becomes a batch of the given schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in kind], schema=kind)
                yield out

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of all columns; the schema stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, df.schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def words_array(text: Column) -> Column:
    """The words of a text as an array of strings."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times: it becomes the variable of a one-element transform."""
    return F.transform(F.array(value), body)[0]


def pieces(text: str, size: int) -> Iterator[str]:
    return (text[i : i + size] for i in range(0, len(text), size))
