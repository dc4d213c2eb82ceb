"""Cutting lineage, and keeping small results small.

``settle`` writes an intermediate result as a Parquet table in the shared checkpoint folder and reads it
back. It is used where two passes must see identical rows (physical row numbers) and between rounds of
iterative operators, so that a lost executor never leads to recomputing an order-dependent step differently.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Result tables up to this many rows may pass through the driver (parameters, categories, totals).
SMALL_ROWS = 10_000
SMALL_BYTES = 16 << 20
# A stored table up to this many bytes, counted, may be broadcast.
BROADCAST_BYTES = 64 << 20

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="tillage-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def work_folder(spark: SparkSession) -> str:
    """The folder of this application below the shared one. It can be deleted when the application has ended."""
    return f"{shared_folder(spark)}/tillage-{spark.sparkContext.applicationId}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the default file system, so that driver, executors and Spark's own writers mean the same place."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write finished in here are deleted at once: what is written takes their place."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written rows."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_VARIABLE = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of the values of a row, fixed-width values counted as 24."""
    parts = [F.lit(24 * len(df.columns)).cast("long")]
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long"))
        elif isinstance(f.dataType, _VARIABLE):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)).cast("long"))
    return sum(parts[1:], parts[0])


def may_broadcast(stored: DataFrame, rows: int) -> bool:
    """Is a stored table small enough to broadcast? Its rows are known, its bytes are counted."""
    if rows * 24 * len(stored.columns) > BROADCAST_BYTES:
        return False
    return (stored.agg(F.sum(_row_bytes(stored))).first()[0] or 0) <= BROADCAST_BYTES


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A few driver rows as a local relation, whose size the optimizer knows."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not rows:
        return spark.createDataFrame([], schema)
    columns = [pa.array(list(c)) for c in zip(*rows)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` as a local relation when it has at most ``limit`` rows and few bytes, else None.

    One job decides: when the first rows hold too many bytes, their values are left out of the answer.
    """
    first = df.limit(limit + 1)
    if any(isinstance(f.dataType, _VARIABLE) for f in df.schema):
        total = F.sum(_row_bytes(first)).over(Window.partitionBy(F.lit(0)))  # at most limit + 1 rows
        fits = F.col("_total") <= SMALL_BYTES
        rows = first.withColumn("_total", total).select(*[F.when(fits, F.col(c)).alias(c) for c in df.columns], "_total").toArrow()
        if rows.num_rows and rows["_total"][0].as_py() > SMALL_BYTES:
            return None
        rows = rows.drop_columns("_total")
    else:
        rows = first.toArrow()
    return None if rows.num_rows > limit else df.sparkSession.createDataFrame(rows, df.schema)


def pinned(df: DataFrame, limit: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Compute ``df`` once. Returns (rows, is_small); a large result is written to the shared folder.

    The size check and the write share one computation through a disk cache, which is dropped again at once.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        local = small(held, limit)
        return (local, True) if local is not None else (settle(held), False)
    finally:
        held.unpersist()
