"""Reading one large CSV or JSON document with many tasks.

Whether a line break ends a record depends on whether a quoted cell is open there, which only the text before can tell. So every block of a
file is first scanned under both assumptions, outside and inside a quoted text, and gives a map from the state in which it is entered
to the state in which it is left (for JSON with the change of the bracket depth). A prefix scan over these maps, one small row per
block, tells each block its true entry state. A second pass cuts every block into records from there; a record that crosses block borders is
put together from its pieces, of which each block has at most two.

Spark's text source splits the files: at line feeds for CSV, and at closing braces for JSON, so that a document of one single line is split as well.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import may_broadcast, settle, work_folder

WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3  # a record inside a block; the end, the beginning and the middle of one that crosses borders
OUT_ROWS = 4_000

_QUOTED = re.compile(r'"(?:[^"]|"")*"(?!")')
_CLOSING = re.compile(r'(?:[^"]|"")*"(?!")')
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)


def csv_state(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Is a quoted cell open after this line? A quote opens a cell only as its first character; a doubled one stands for itself."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        end = _CLOSING.match(line)
        if end is None:
            return True
        at = line.find(delimiter, end.end()) + 1
        if not at:
            return False
    while True:
        if line.startswith('"', at):
            cell = _QUOTED.match(line, at)
            if cell is None:
                return True
            at = line.find(delimiter, cell.end()) + 1
        else:
            at = line.find(delimiter, at) + 1
        if not at:
            return False


def json_state(text: str, inside: bool) -> tuple[bool, int]:
    """Is a string open after this text, and by how much has the bracket depth changed?"""
    if inside:
        end = _STRING_END.match(text)
        if end is None:
            return True, 0
        text = text[end.end() :]
    if '"' in text:
        text = _STRING.sub("", text)
        open_at = text.find('"')
        if open_at >= 0:
            return True, _depth(text[:open_at])
    return False, _depth(text)


def _depth(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """The pieces of all files in their order inside each block: (value, file, block)."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_block(df: DataFrame, start: Callable, schema: str) -> DataFrame:
    """Run over the pieces of each block in order. ``start(first row)`` gives (step, finish), generators of output tuples."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step, finish, out = None, None, None, []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)
            out.clear()
            return made

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if row[1:3] != key:
                    if finish is not None:
                        out.extend(finish())
                    key = row[1:3]
                    step, finish = start(row)
                out.extend(step(row[0]))
                if len(out) >= OUT_ROWS:
                    yield flush()
        if finish is not None:
            out.extend(finish())
        if out:
            yield flush()

    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds = [arrow[c.split()[1]] for c in schema.split(", ")]
    return df.mapInArrow(run, schema)


def _entries(maps: DataFrame) -> DataFrame:
    """(file, block, inside, depth, root): the prefix scan over the maps of the blocks of each file.

    ``to0`` and ``to1`` are the states a block leaves when entered outside and inside. A block whose two are equal sets the
    state; one that exchanges them flips it.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.sum(F.when((F.col("to0") == 1) & (F.col("to1") == 0), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    known = maps.withColumn("_flips", flips)
    fixed = F.last(F.when(F.col("to0") == F.col("to1"), F.struct(F.col("to0").alias("s"), F.col("_flips").alias("f"))), ignorenulls=True).over(before)
    known = known.withColumn("_fixed", fixed).withColumn("_seen", F.coalesce(F.last("_flips").over(before), F.lit(0)))
    inside = (F.coalesce("_fixed.s", F.lit(0)) + F.col("_seen") - F.coalesce("_fixed.f", F.lit(0))) % 2
    known = known.withColumn("inside", inside == 1)
    moved = F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))
    depth = F.coalesce(F.sum("_moved").over(before), F.lit(0))
    root = F.first("root").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return known.withColumn("_moved", moved).select("file", "block", "inside", depth.alias("depth"), root.alias("root"))


def _cut(pieces: DataFrame, maps: DataFrame, start: Callable, joiner: str, keep_open: bool) -> DataFrame:
    """All records: (file, block, seq, text), ``seq`` counting inside the block where a record begins."""
    entries = settle(_entries(maps))
    if not may_broadcast(entries, entries.count()):  # one row per block: about 60 TB of text at the usual block size
        raise ValueError("too many blocks: raise spark.sql.files.maxPartitionBytes or read with multi_line=False")
    entered = pieces.join(F.broadcast(entries), ["file", "block"]).select("value", "file", "block", "inside", "depth", "root")
    parts = settle(_by_block(entered, start, "file string, block bigint, seq bigint, part int, text string"))
    # Every head and middle belongs to the tail before it. Two rows per block at most pass this window.
    order = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.last(F.when(F.col("part") == TAIL, F.struct("block", "seq")), ignorenulls=True).over(order)
    crossing = parts.filter(F.col("part") != WHOLE).withColumn("_begins", begins)
    texts = F.sort_array(F.collect_list(F.struct("block", "text")))
    joined = crossing.groupBy("file", "_begins").agg(texts.alias("_texts"), F.max((F.col("part") == HEAD).cast("int")).alias("_closed"))
    if not keep_open:
        joined = joined.filter(F.col("_closed") == 1)
    text = F.array_join(F.transform("_texts", lambda t: t["text"]), joiner)
    crossed = joined.select("file", F.col("_begins.block").alias("block"), F.col("_begins.seq").alias("seq"), text.alias("text"))
    return parts.filter(F.col("part") == WHOLE).select("file", "block", "seq", "text").unionByName(crossed)


def csv_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """The records of CSV files as texts, line breaks in quoted cells included: (file, block, seq, text). Headers are records like others."""

    def maps(first: tuple):
        to = [False, True]

        def step(line: str):
            if '"' in line:
                to[:] = [csv_state(line, s, delimiter) for s in to]
            return ()

        return step, lambda: [(*first[1:3], int(to[0]), int(to[1]), 0, 0, None)]

    def records(first: tuple):
        file, block, inside = first[1], first[2], first[3]
        state = {"inside": inside, "entered": inside, "seq": 0, "lines": []}

        def step(line: str):
            was = state["inside"]
            state["inside"] = csv_state(line, was, delimiter)
            if not state["lines"] and not state["inside"]:  # a record of one line, or the last line of one that began before the block
                made = (file, block, state["seq"], HEAD if state["entered"] else WHOLE, line)
            else:
                state["lines"].append(line)
                if state["inside"]:
                    return ()
                made = (file, block, state["seq"], HEAD if state["entered"] else WHOLE, "\n".join(state["lines"]))
                state["lines"] = []
            state["entered"], state["seq"] = False, state["seq"] + 1
            return (made,)

        def finish():
            if state["lines"]:
                return [(file, block, state["seq"], MIDDLE if state["entered"] else TAIL, "\n".join(state["lines"]))]
            return []

        return step, finish

    pieces = _pieces(spark, path, "\n")
    found = _by_block(pieces, maps, "file string, block bigint, to0 int, to1 int, depth0 int, depth1 int, root string")
    return _cut(pieces, found, records, "\n", keep_open=True)


def json_lines(spark: SparkSession, path: str) -> str:
    """Rewrite JSON documents, each an array of objects or one object, as JSON lines in the work folder; returns that folder."""

    def maps(first: tuple):
        to, moved, root = [False, True], [0, 0], [None]

        def step(text: str):
            text += "}"
            if root[0] is None:
                root[0] = text.lstrip("﻿ \t\r\n")[:1] or None
            for i in (0, 1):
                to[i], change = json_state(text, to[i])
                moved[i] += change
            return ()

        return step, lambda: [(*first[1:3], int(to[0]), int(to[1]), moved[0], moved[1], root[0])]

    def elements(first: tuple):
        file, block, inside, depth, root = first[1:6]
        base = 1 if root == "[" else 0
        state = {"inside": inside, "depth": depth, "entered": block > 0 and (inside or depth > base), "seq": 0, "texts": []}

        def step(text: str):
            text += "}"
            state["texts"].append(text)
            state["inside"], change = json_state(text, state["inside"])
            state["depth"] += change
            if state["inside"] or state["depth"] != base:
                return ()
            made = (file, block, state["seq"], HEAD if state["entered"] else WHOLE, _plain("".join(state["texts"])))
            state["entered"], state["seq"], state["texts"] = False, state["seq"] + 1, []
            return (made,)

        def finish():
            if state["texts"]:
                return [(file, block, state["seq"], MIDDLE if state["entered"] else TAIL, _plain("".join(state["texts"])))]
            return []

        return step, finish

    pieces = _pieces(spark, path, "}")
    found = _by_block(pieces, maps, "file string, block bigint, to0 int, to1 int, depth0 int, depth1 int, root string")
    rows = _cut(pieces, found, elements, "", keep_open=False)
    folder = f"{work_folder(spark)}/json-{uuid.uuid4().hex}"
    rows.select(F.regexp_replace("text", r"^[\x{FEFF}\s]*[\[,]?\s*(?=\{)", "").alias("value")).write.text(folder)
    return folder


def _plain(text: str) -> str:
    """On one line: line breaks stand between the parts of a document only, never inside its strings."""
    return text.replace("\r", " ").replace("\n", " ")
