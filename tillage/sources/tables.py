"""Reading tables: CSV, JSON and .xlsx, chosen by extension."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import ISO_DATE, NA_TOKENS, blank_to_null, number_of, text_columns
from .blocks import csv_records, json_lines


def typed(df: DataFrame, dates: bool = False) -> DataFrame:
    """Give text columns the type that all their present values have: whole number, number, true/false or text.

    One aggregate over all columns decides. With ``dates``, columns of ISO dates become dates as well.
    """
    columns = text_columns(df)
    if not columns:
        return df
    aggs = []
    for i, c in enumerate(columns):
        q = f"`{c}`"
        aggs += [
            F.count(F.col(c)).alias(f"n_{i}"),
            F.bool_and(F.expr(f"{q} IS NULL OR ({q} RLIKE '^\\\\s*[+-]?[0-9]+\\\\s*$' AND try_cast({q} AS bigint) IS NOT NULL)")).alias(f"long_{i}"),
            F.bool_and(F.col(c).isNull() | number_of(F.col(c)).isNotNull()).alias(f"double_{i}"),
            F.bool_and(F.expr(f"{q} IS NULL OR lower({q}) IN ('true', 'false')")).alias(f"boolean_{i}"),
            F.bool_and(F.col(c).isNull() | (F.col(c).rlike(ISO_DATE + "$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull())).alias(f"date_{i}"),
        ]
    seen = df.agg(*aggs).first()
    kinds = {}
    for i, c in enumerate(columns):
        if seen[f"n_{i}"]:
            order = ["long", "double", "boolean", *(["date"] if dates else [])]
            kinds[c] = next((k for k in order if seen[f"{k}_{i}"]), "string")
    return df.select(*[F.col(c).cast({"long": "bigint"}.get(kinds[c], kinds[c])).alias(c) if c in kinds else F.col(c) for c in df.columns])


def _is_large(spark: SparkSession, path: str) -> bool:
    """Would Spark split one of the files? Only their lengths are looked at."""
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    block = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return (largest or 0) > block


def read_csv(
    spark: SparkSession, path: str, na_tokens: list[str] | None = None, multi_line: bool = True, dates: bool = False, split: bool | None = None
) -> DataFrame:
    """CSV with a header; NA texts and empty cells become null before types are decided.

    A quoted cell may hold line breaks. ``split`` reads each file in blocks by many tasks (see ``blocks``); by default that is done where a file is larger
    than ``spark.sql.files.maxPartitionBytes``, and smaller files are read by one task each. Where no cell holds a line break,
    ``multi_line=False`` saves the scan for record borders.
    """
    options = {"header": "true", "inferSchema": "false", "multiLine": str(multi_line).lower(), "escape": '"', "encoding": "UTF-8"}
    raw = spark.read.options(**options).csv(path)
    names = raw.columns
    if names and multi_line and (_is_large(spark, path) if split is None else split):
        records = csv_records(spark, path).filter((F.col("block") > 0) | (F.col("seq") > 0))  # without the header of each file
        # Records of files with CRLF keep their CR; inside quoted cells the pair counts as one line break.
        text = F.when(F.endswith("text", F.lit("\r")), F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
        fields = F.from_csv(text, ", ".join(f"c{i} string" for i in range(len(names))), {k: options[k] for k in ("escape", "multiLine")})
        raw = records.filter(text != "").select(fields.alias("_r")).select(*[F.col(f"_r.c{i}").alias(c) for i, c in enumerate(names)])
    first = names[0] if names else ""
    if first.startswith("﻿"):
        raw = raw.withColumnRenamed(first, first[1:])
    return typed(blank_to_null(raw, na_tokens=NA_TOKENS if na_tokens is None else na_tokens), dates)


def read_json(spark: SparkSession, path: str, split: bool | None = None) -> DataFrame:
    """A JSON array of objects, or one object as one row; keys of all objects are united.

    ``split`` reads each document in blocks by many tasks; by default where one is larger than ``spark.sql.files.maxPartitionBytes``.
    """
    if _is_large(spark, path) if split is None else split:
        return blank_to_null(spark.read.json(json_lines(spark, path)))
    return blank_to_null(spark.read.option("multiLine", True).json(path))


# ------------------------------------------------------------------ .xlsx

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show a date, and the day number 0 of the sheet calendar.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_DAY_ZERO = datetime(1899, 12, 30)


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as texts; dates as ISO text. The sheet is parsed as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot():
                shared.append("".join(t.text or "" for t in si.iter(_MAIN + "t")))
        dated = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.parse(book.open("xl/styles.xml")).getroot()
            custom = {int(f.get("numFmtId")) for f in styles.iter(_MAIN + "numFmt") if re.search("[yd]", f.get("formatCode", ""), re.I)}
            cells = styles.find(_MAIN + "cellXfs")
            for i, xf in enumerate(cells if cells is not None else []):
                if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | custom:
                    dated.add(i)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
        first = ElementTree.parse(book.open("xl/workbook.xml")).getroot().find(f"{_MAIN}sheets")[0]
        target = links[first.get(_REL + "id")]
        sheet = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
        for _, row in ElementTree.iterparse(book.open(sheet)):
            if row.tag != _MAIN + "row":
                continue
            cells: list[str | None] = []
            for i, c in enumerate(row):
                at = _column_number(c.get("r")) if c.get("r") else i
                cells += [None] * (at + 1 - len(cells))
                v, kind = c.find(_MAIN + "v"), c.get("t")
                text = v.text if v is not None else None
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(_MAIN + "t"))
                elif kind == "b" and text is not None:
                    text = "true" if text == "1" else "false"
                elif kind in (None, "n") and text is not None and int(c.get("s", 0)) in dated:
                    day = _DAY_ZERO + timedelta(seconds=round(float(text) * 86400))
                    text = day.strftime("%Y-%m-%d") if day.time().isoformat() == "00:00:00" else day.isoformat()
                cells[at] = text
            yield cells
            row.clear()


def _headings(cells: list[str | None]) -> list[str]:
    """Column names of a sheet: an empty heading becomes ``column_<n>``, a repeated one gets a number."""
    out: list[str] = []
    for i, c in enumerate(cells):
        name, n = c or f"column_{i}", 1
        while name in out:
            name, n = f"{c}_{n}", n + 1
        out.append(name)
    return out


def read_xlsx(spark: SparkSession, path: str, dates: bool = False) -> DataFrame:
    """The first sheet of one or more workbooks (a file or a glob), header in the first row; one task per file.

    Columns are united by name over all workbooks. A cell without a heading belongs to ``column_<n>``, n being its 0-based place.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows: list[tuple[str, int, list]] = []
                header: list[str] = []
                for i, cells in enumerate(sheet_rows(content)):
                    if i == 0:
                        header = _headings(cells)
                        cells = header
                    header += [f"column_{n}" for n in range(len(header), len(cells))]
                    rows.append((name, i, [{"name": n, "place": p, "text": c} for p, (n, c) in enumerate(zip(header, cells))]))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=["path", "row_no", "cells"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "row_no", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(parse, "path string, row_no long, cells array<struct<name:string,place:int,text:string>>")
    seen = rows.select("path", F.explode("cells").alias("c")).groupBy("c.name").agg(F.min(F.struct("path", "c.place")).alias("first"))
    names = [r["name"] for r in seen.orderBy("first", "name").collect()]  # one row per column
    if not names:
        raise ValueError(f"{path} has no rows")
    texts = F.map_from_arrays(F.col("cells.name"), F.col("cells.text"))
    body = rows.filter(F.col("row_no") > 0).select(texts.alias("_m")).select(*[F.try_element_at("_m", F.lit(n)).alias(n) for n in names])
    return typed(blank_to_null(body).dropna(how="all"), dates)


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a table by its extension. A missing path, an unknown type and an empty table are errors."""
    ext = posixpath.splitext(path.rstrip("/"))[1].lower()
    readers = {".csv": read_csv, ".json": read_json, ".xlsx": read_xlsx}
    if ext not in readers:
        raise ValueError(f"cannot read {ext or 'a file without extension'}: use {', '.join(readers)}")
    df = readers[ext](spark, path, **options)
    if not df.take(1):
        raise ValueError(f"{path} has no rows")
    return df
