"""Writing results. No sink writes into a source folder or below it, or over existing files."""

from __future__ import annotations

import json
import os
import posixpath
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..operators.profile import null_cells, null_counts
from ..plans.lineage import qualified, shuffles_dropped

PARTS = "_parts"  # below the target while a write lasts; Spark's readers pass it over
RANGE_BYTES = 64 << 20  # what one task copies of a file that came in parts: whole pages, so that no two tasks write into the same one
COPY_BYTES = 8 << 20


def _clean(path: str) -> str:
    return posixpath.normpath(re.sub(r"^file:/*(?=/)", "", path.rstrip("/")))


def _filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a plain path or a URI, and the path inside it."""
    if not re.match(r"^[a-z0-9]+:/", path):
        return arrow_fs.LocalFileSystem(), os.path.abspath(path)
    return arrow_fs.FileSystem.from_uri(quote(path, safe=":/%@"))


def check_target(target: str, sources: Sequence[str]) -> None:
    """Refuse a target that is a source folder or lies below one."""
    wanted = posixpath.join(_clean(target), "")
    held = [s for s in sources if posixpath.commonprefix([wanted, posixpath.join(_clean(s), "")]) == posixpath.join(_clean(s), "")]
    if held:
        raise ValueError(f"{target} lies in {held[0]}, which is read: choose a folder of its own")


def write_csv(df: DataFrame, target: str, sources: Sequence[str] = (), bom: bool = False) -> None:
    """CSV with a header. ``bom`` marks the files as UTF-8 for spreadsheet programs."""
    check_target(target, sources)
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(target)


def write_splits(df: DataFrame, target: str, sources: Sequence[str] = (), split: str = "split") -> None:
    """The parts of a split as CSV, one sub-folder each, in one pass over the data."""
    check_target(target, sources)
    df.write.mode("errorifexists").partitionBy(split).option("header", True).option("escape", '"').csv(target)


def write_null_report(df: DataFrame, key: Sequence[str], target: str, sources: Sequence[str] = ()) -> None:
    """Null counts per column and the location of every null cell."""
    check_target(target, sources)
    write_csv(null_counts(df), f"{target}/counts")
    write_csv(null_cells(df, key), f"{target}/cells")


# ------------------------------------------------------------------ files written by the executors


@dataclass
class _Written(WriterCommitMessage):
    saved: int
    failed: int
    parts: list[tuple[str, int, str, int]] = field(default_factory=list)  # (file, task, place, bytes), two at most


class _FileWriter(DataSourceWriter):
    """Each task writes its own files; a failing file is counted and does not stop the others.

    A file is first written under a name of its own and then moved, so a repeated task leaves complete files.
    """

    def __init__(self, target: str, lines: bool) -> None:
        self.target, self.lines = target, lines

    def _open(self) -> tuple[arrow_fs.FileSystem, str]:
        return _filesystem(self.target)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, root = self._open()
        context = TaskContext.get()
        mark = f".{context.taskAttemptId()}" if context else ".0"
        if self.lines:
            return self._write_lines(fs, root, context.partitionId() if context else 0, mark, iterator)
        return self._write_files(fs, root, mark, iterator)

    @staticmethod
    def _finish(fs, part: str, final: str) -> None:
        fs.move(part, final)

    def _write_files(self, fs, root: str, mark: str, rows: Iterator[Row]) -> _Written:
        saved = failed = 0
        for row in rows:
            final = f"{root}/{row['target']}"
            try:
                if row["content"] is None and row["source"] is None:
                    raise ValueError("no content")
                fs.create_dir(posixpath.dirname(final), recursive=True)
                if row["content"] is None:  # an unchanged file is copied byte for byte
                    source_fs, source = _filesystem(row["source"])
                    arrow_fs.copy_files(source, final + mark, source_filesystem=source_fs, destination_filesystem=fs)
                else:
                    with fs.open_output_stream(final + mark) as out:
                        out.write(bytes(row["content"]))
                self._finish(fs, final + mark, final)
                saved += 1
            except (OSError, ValueError):
                failed += 1
        return _Written(saved, failed)

    def _write_lines(self, fs, root: str, task: int, mark: str, rows: Iterator[Row]) -> _Written:
        """The first and the last file of a task may have lines in other tasks too: they stay below ``PARTS`` for ``_join_parts``."""
        done, current, out, place, size = _Written(0, 0), None, None, "", 0

        def close(edge: bool) -> None:
            out.close()
            if edge:
                done.parts.append((current, task, place, size))
                return
            fs.create_dir(posixpath.dirname(f"{root}/{current}"), recursive=True)
            self._finish(fs, f"{root}/{place}", f"{root}/{current}")
            done.saved += 1

        for row in rows:  # sorted by file and line number
            if row["file"] != current:
                if out is None:
                    fs.create_dir(f"{root}/{PARTS}", recursive=True)
                else:
                    close(edge=not done.parts)
                current, place, size = row["file"], f"{PARTS}/{task}-{len(done.parts)}{mark}", 0
                out = fs.open_output_stream(f"{root}/{place}")
            if row["line"] is not None:
                size += out.write((row["line"] + "\n").encode())
        if out is not None:
            close(edge=True)
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = self._open()
        fs.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        _write_report(fs, root, {"saved": sum(m.saved for m in done), "failed": sum(m.failed for m in done), "parts": [p for m in done for p in m.parts]})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """The folder is new with this write, so a failed write takes all of it away."""
        fs, root = self._open()
        if fs.get_file_info(root).type == arrow_fs.FileType.Directory:
            fs.delete_dir(root)


class FileSink(DataSource):
    """Sink ``tillage_files``: rows (target, content, source) become files, or with ``lines`` rows (file, line_no, line) text files."""

    @classmethod
    def name(cls) -> str:
        return "tillage_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"], self.options.get("lines", "false") == "true")


def _write_report(fs: arrow_fs.FileSystem, root: str, report: dict) -> None:
    with fs.open_output_stream(f"{root}/_report.json") as out:
        out.write(json.dumps(report).encode())


def _writes_anywhere(fs: arrow_fs.FileSystem) -> bool:
    """Can several tasks write into one file? Local and mounted folders allow it, stores that only append do not."""
    return isinstance(fs, arrow_fs.LocalFileSystem)


def _ranges(pieces: Sequence[tuple[str, int]], length: int) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
    """The concatenation of (place, bytes) cut into ranges: (start, [(place, offset in it, bytes)])."""
    start, filled, held = 0, 0, []
    for place, size in pieces:
        at = 0
        while at < size:
            n = min(size - at, length - filled)
            held.append((place, at, n))
            at, filled = at + n, filled + n
            if filled == length:
                yield start, held
                start, filled, held = start + length, 0, []
    if held:
        yield start, held


def _copy_range(target: str, place: str, start: int | None, held: Sequence[tuple[str, int, int]]) -> None:
    """Fill a file from ``start`` on with ranges of other files; without a start the file is new."""
    fs, root = _filesystem(target)
    with fs.open_output_stream(f"{root}/{place}") if start is None else open(f"{root}/{place}", "r+b") as out:
        if start is not None:
            out.seek(start)
        for source, at, left in held:
            with fs.open_input_file(f"{root}/{source}") as part:
                part.seek(at)
                while left:
                    data = part.read(min(left, COPY_BYTES))
                    if not data:
                        raise OSError(f"{source} is shorter than written")
                    out.write(data)
                    left -= len(data)


def _join_parts(spark: SparkSession, target: str, parts: Sequence[tuple[str, int, str, int]]) -> int:
    """Bring files that were written in parts (file, task, place, bytes) to their places; returns their number.

    Files of several parts are put together by many tasks, each copying ranges of ``RANGE_BYTES`` at most. Only where a file cannot be
    written at any place (``_writes_anywhere``) one task streams all of it from its parts.
    """
    fs, root = _filesystem(target)
    pieces: dict[str, list[tuple[str, int]]] = {}
    for file, _, place, size in sorted(parts, key=lambda p: (p[0], p[1])):  # two parts per task at most
        pieces.setdefault(file, []).append((place, size))
    whole, copies = {}, []
    for n, (file, found) in enumerate(pieces.items()):
        whole[file] = found[0][0] if len(found) == 1 else f"{PARTS}/whole-{n}"
        if len(found) == 1:
            continue
        if _writes_anywhere(fs):
            with open(f"{root}/{whole[file]}", "wb") as out:
                out.truncate(sum(size for _, size in found))
            copies += [(whole[file], start, held) for start, held in _ranges(found, RANGE_BYTES)]
        else:
            copies.append((whole[file], None, [(place, 0, size) for place, size in found]))
    if copies:
        spark.sparkContext.parallelize(copies, min(len(copies), 10_000)).foreach(lambda c: _copy_range(target, *c))
    for file, place in whole.items():
        fs.create_dir(posixpath.dirname(f"{root}/{file}"), recursive=True)
        fs.move(f"{root}/{place}", f"{root}/{file}")
    fs.delete_dir(f"{root}/{PARTS}")
    return len(whole)


def _save(df: DataFrame, target: str, sources: Sequence[str], lines: bool) -> tuple[int, int]:
    check_target(target, sources)
    spark = df.sparkSession
    target = qualified(spark, target)
    fs, root = _filesystem(target)
    if fs.get_file_info(root).type != arrow_fs.FileType.NotFound:
        raise ValueError(f"{target} exists: choose a new folder")
    spark.dataSource.register(FileSink)
    with shuffles_dropped(spark):
        df.write.format("tillage_files").option("lines", str(lines).lower()).mode("append").save(target)
    with fs.open_input_stream(f"{root}/_report.json") as done:
        report = json.loads(done.read())
    parts = report.pop("parts")
    try:
        report["saved"] += _join_parts(spark, target, parts) if parts else 0
        _write_report(fs, root, report)
    except BaseException:
        fs.delete_dir(root)
        raise
    return report["saved"], report["failed"]


def save_files(df: DataFrame, target: str, sources: Sequence[str] = ()) -> tuple[int, int]:
    """Write rows (target, content, source) as files below a new folder; returns (saved, failed).

    A row without content copies the file ``source``: unchanged images never travel through a shuffle. Two rows with one target are an error.
    """
    twice = df.groupBy("target").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).take(5)
    if twice:
        raise ValueError(f"several rows for one file: {sorted(r['target'] for r in twice)}")
    content = F.col("content") if "content" in df.columns else F.lit(None).cast("binary")
    source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    return _save(df.select("target", content.alias("content"), source.alias("source")), target, sources, False)


def _placed(df: DataFrame) -> DataFrame:
    """The lines in order, dealt out by ranges of them: a file of many lines goes to many tasks, also where many share a number."""
    order = ["file", "line_no", F.xxhash64("line")]
    return df.select("file", "line_no", "line").repartitionByRange(*order).sortWithinPartitions(*order)


def save_lines(df: DataFrame, target: str, sources: Sequence[str] = ()) -> tuple[int, int]:
    """Write rows (file, line_no, line) as text files below a new folder. A null line makes an empty file.

    Tasks stream ranges of the sorted lines, and a file that lies in several tasks is put together by many tasks as well (``_join_parts``).
    """
    return _save(_placed(df), target, sources, True)


def save_lines_in_parts(df: DataFrame, target: str, sources: Sequence[str] = ()) -> tuple[int, int]:
    """As ``save_lines``, but a document becomes ``file.part-00000``, ``file.part-00001`` ...

    The parts in name order are the document, and no bytes are copied to put it together.
    """
    part = F.format_string("%s.part-%05d", F.col("file"), F.spark_partition_id())
    return _save(_placed(df).withColumn("file", part), target, sources, True)


def image_export(df: DataFrame, encoded: str = "encoded", path: str = "path", force: bool = False) -> DataFrame:
    """Rows for ``save_files``: changed images (or all, with ``force``) are written from their encoded pixels, others copied."""
    edited = F.lit(True) if force else F.col("changed")
    return df.select("target", F.when(edited, F.col(encoded)).alias("content"), F.when(~edited, F.col(path)).alias("source"))
