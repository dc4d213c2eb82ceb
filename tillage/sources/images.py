"""Listing and decoding image files, and reading archives, label mappings and label files."""

from __future__ import annotations

import ast
import bz2
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import ext_of, name_of
from ..operators.rasters import apply_raster
from ..plans.lineage import qualified, settle
from ..plans.lookup import lookup

# The extensions that count as images, and the length of an error text.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tif", ".tiff", ".webp")
NO_CODEC = (".webp",)  # valid pictures that the image reader cannot decode
ERROR_LENGTH = 150


def _plain_path(c: str) -> Column:
    """One spelling for the file names of the binary and the image reader: no scheme, no escapes."""
    return F.regexp_replace(F.col(c), "^[a-z0-9]+:/+(?=/)|^file:", "")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files below a folder: path, name, ext, size. The contents are only read when ``content`` is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(
        _plain_path("path").alias("path"), name_of(F.col("path")).alias("name"), ext_of(name_of(F.col("path"))).alias("ext"),
        F.col("length").alias("size"), "content",
    ).filter(F.col("ext").isin(list(IMAGE_EXTENSIONS)))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images: path, name, ext, size, corrupted, error and the raster columns.

    A file that cannot be decoded stays as a row with ``corrupted`` and an error. A format without a codec is no damage: its rows
    have the error "unsupported" and no pixels, and are not ``corrupted``. Path and size come from the file
    metadata of the same scan, so nothing is joined or shuffled; the file bytes are read by ``list_images`` only.
    """
    scan = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder)
    files = scan.select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("_p"),
        F.col("_metadata.file_size").alias("size"), "image",
    ).withColumn("path", _plain_path("_p")).withColumn("name", name_of(F.col("path"))).withColumn("ext", ext_of(F.col("name")))
    good = F.col("image.width") > 0
    known = ~F.col("ext").isin(list(NO_CODEC))
    error = F.substring(F.concat(F.when(known, "undecodable: ").otherwise("unsupported: "), F.col("ext")), 1, ERROR_LENGTH)
    rows = files.filter(F.col("ext").isin(list(IMAGE_EXTENSIONS))).select(
        "path", "name", "ext", "size", (~good & known).alias("corrupted"), F.when(~good, error).alias("error"),
        F.when(good, F.col("image.height")).alias("height"), F.when(good, F.col("image.width")).alias("width"),
        F.when(good, F.col("image.nChannels")).alias("n_channels"), F.when(good, F.col("image.data")).alias("data"),
    )

    def to_rgb_order(a):  # the image reader gives blue first, with alpha last
        return a[..., [2, 1, 0, *range(3, a.shape[-1])]]

    return apply_raster(rows, to_rgb_order, skip=F.col("n_channels") == 1, stacked=True).withColumn("changed", F.lit(False))


# Fixed values of the ZIP format: the length of a local header, and where in it the lengths of the name and of the extra field stand.
_LOCAL_HEADER, _LOCAL_LENGTHS = 30, (26, "<HH")
RANGE = 64 << 20  # archive bytes of one range; less where that would leave cores idle
LEAST_RANGE = 1 << 20
OUT_BYTES = 8 << 20

_DIRECTORY = "archive string, path string, place long, offset long, packed long, length long, crc long, method int"


def _open_archive(uri: str) -> pa.NativeFile:
    """A file by the path that Spark's listing gives, read at any place."""
    store, path = fs.FileSystem.from_uri(quote(uri, safe=":/"))
    return store.open_input_file(path)


def _is_listed(info: zipfile.ZipInfo) -> bool:
    parts = info.filename.split("/")
    hidden = any(p == "__MACOSX" or p.startswith(".") for p in parts)
    return not info.is_dir() and not hidden and ("." + parts[-1].rsplit(".", 1)[-1].lower()) in IMAGE_EXTENSIONS


def archive_directory(archives: DataFrame) -> DataFrame:
    """The image members of the archives named in ``archive``, from the directory at the end of each file; nothing is unpacked."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _DIRECTORY.split(", ")]
        for pdf in batches:
            for archive in pdf["archive"]:
                with _open_archive(archive) as file, zipfile.ZipFile(file) as z:
                    rows = (
                        (archive, m.filename, i, m.header_offset, m.compress_size, m.file_size, m.CRC, -1 if m.flag_bits & 1 else m.compress_type)
                        for i, m in enumerate(z.infolist()) if _is_listed(m)
                    )
                    while part := list(islice(rows, 10_000)):
                        yield pd.DataFrame(part, columns=names)

    return archives.select("archive").mapInPandas(entries, _DIRECTORY)


def _member(file: pa.NativeFile, place: int, offset: int, packed: int, crc: int, method: int) -> bytes:
    """The content of one member; only its own bytes are read. Rare methods, and encrypted members, are left to ``zipfile``."""
    unpack = {zipfile.ZIP_STORED: bytes, zipfile.ZIP_DEFLATED: lambda b: zlib.decompress(b, -zlib.MAX_WBITS), zipfile.ZIP_BZIP2: bz2.decompress}.get(method)
    if unpack is None:
        file.seek(0)
        with zipfile.ZipFile(file) as z:
            return z.read(z.infolist()[place])
    at, kind = _LOCAL_LENGTHS
    start = offset + _LOCAL_HEADER + sum(struct.unpack_from(kind, file.read_at(_LOCAL_HEADER, offset), at))
    content = unpack(file.read_at(packed, start))
    if zlib.crc32(content) != crc:
        raise zipfile.BadZipFile("a member does not match its checksum")
    return content


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members in the order of archive and offset; an archive stays open while its members follow each other."""
    name, file, out, held = None, None, [], 0
    try:
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != name:
                    if file is not None:
                        file.close()
                    name, file = row["archive"], _open_archive(row["archive"])
                out.append((name, row["path"], _member(file, *(row[k] for k in ("place", "offset", "packed", "crc", "method")))))
                held += row["length"]
                if held >= OUT_BYTES:
                    yield _content_batch(out)
                    out, held = [], 0
        if out:
            yield _content_batch(out)
    finally:
        if file is not None:
            file.close()


def _content_batch(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "path", "content"])


def _whole_archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for archive, content in zip(pdf["archive"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in filter(_is_listed, z.infolist()):
                    yield pd.DataFrame({"archive": [archive], "path": [info.filename], "content": [z.read(info)]})


def read_archives(spark: SparkSession, path: str, most: int = RANGE) -> DataFrame:
    """Images inside ZIP archives: archive, path, name, ext, size, content. Folders and hidden entries are skipped.

    The directory of every archive is read first; its members are then dealt out by ranges of about ``most`` bytes, so that one archive is
    unpacked by many tasks, may be of any size and is never in memory as a whole. A file system that only Spark can open gives whole archives,
    one task and at most 2 GB each.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)
    archives = files.select(F.col("path").alias("archive"), "content")
    try:
        fs.FileSystem.from_uri(quote(qualified(spark, path), safe=":/"))
    except (pa.ArrowInvalid, OSError):
        out = archives.mapInPandas(_whole_archives, "archive string, path string, content binary")
    else:
        members = settle(archive_directory(archives))
        total, count = members.agg(F.coalesce(F.sum("packed"), F.lit(0)), F.count(F.lit(1))).first()
        step = max(1, min(most, max(LEAST_RANGE, total // (2 * spark.sparkContext.defaultParallelism))))
        tasks = max(1, -(-total // step), min(count, spark.sparkContext.defaultParallelism))
        dealt = members.repartition(tasks, "archive", F.floor(F.col("offset") / step)).sortWithinPartitions("archive", "offset")
        out = dealt.mapInArrow(_unpack, "archive string, path string, content binary")
    return out.select(
        "archive", "path", name_of(F.col("path")).alias("name"), ext_of(name_of(F.col("path"))).alias("ext"),
        F.length("content").cast("long").alias("size"), "content",
    )


# What a mapping document is made of: a table's name and opening brace, a label's number, a quoted text, a comment.
_MAPPING_TOKEN = re.compile(r"""(?P<table>[A-Za-z_]\w*)\s*=\s*(?P<open>\{)?|(?P<label>\d+)\s*:|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|\#[^\n]*""", re.S)
NAMES, FILES = "label_names", "label_to_images"


def mapping_entries(text: str) -> Iterator[tuple[str, int, str | None]]:
    """(table, label, text) of a mapping document: an entry without text for every label, one with for each name or file.

    The document is read token by token and never executed; a table that is not written out as braces is an error.
    """
    table, label = None, None
    for token in _MAPPING_TOKEN.finditer(text):
        if token["table"]:
            table, label = token["table"], None
            if table in (NAMES, FILES) and not token["open"]:
                raise ValueError(f"{table} is not a table of labels")
        elif token["label"] and table in (NAMES, FILES):
            label = int(token["label"])
            yield table, label, None
        elif token["text"] and label is not None:
            yield table, label, ast.literal_eval(token["text"])


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Rows (label_id, name, file) of label mapping files; a label without files has one row, a label without a name is called by its number."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text in zip(pdf["doc"], pdf["value"]):
                yield pd.DataFrame(((doc, *e) for e in mapping_entries(text)), columns=["doc", "part", "label_id", "text"])

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), "value")
    entries = texts.mapInPandas(parse, "doc string, part string, label_id long, text string")
    listed = (F.col("part") == FILES) & F.col("text").isNotNull()
    labels = entries.groupBy("doc", "label_id").agg(F.max(F.when(F.col("part") == NAMES, F.col("text"))).alias("_name"), F.count_if(listed).alias("_files"))
    labels = labels.withColumn("_name", F.coalesce("_name", F.col("label_id").cast("string")))
    files = entries.filter(listed).select("doc", "label_id", F.col("text").alias("file"))
    named = lookup(files, labels, ["doc", "label_id"], ["_name"], weight="_files")
    alone = labels.filter(F.col("_files") == 0).withColumn("file", F.lit(None).cast("string"))
    return named.unionByName(alone.select(*named.columns)).select("label_id", F.col("_name").alias("name"), "file")


def read_box_files(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of YOLO label files: stem, class_id, xc, yc, w, h (shares of the image); blank lines are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path).select(
        F.regexp_replace(name_of(F.col("_metadata.file_path")), r"\.txt$", "").alias("stem"), F.split(F.trim("value"), r"\s+").alias("v")
    )
    number = lambda i: F.col("v")[i].try_cast("double")
    return lines.filter(F.col("v")[0] != "").select(
        "stem", F.col("v")[0].try_cast("int").alias("class_id"), *[number(i + 1).alias(c) for i, c in enumerate(("xc", "yc", "w", "h"))]
    )
