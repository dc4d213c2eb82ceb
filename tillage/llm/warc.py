"""WARC archives (operator 4): written in parallel, indexed while written, read back by coalesced byte ranges.

Every task writes the rows of its partition as one archive, each record a gzip member of its own, and returns one index row per record: file,
offset, length, url, digest. The index is stored as Parquet before anything is read, so it names the archives of the attempts that
succeeded; an archive that a lost attempt left behind is named by no index row. To read, the wanted index rows of each
file are sorted by offset, neighbours are joined to ranges with small gaps, and tasks fetch whole ranges.

Of records with equal payloads one is a response and the others revisit it.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillage.plans.lineage import settle, work_folder

SMALLEST = 1000  # payloads below this many bytes are never revisited
GAP = 1 << 14  # bytes between two wanted records that are read along
RANGE = 8 << 20  # a new range begins after this many bytes
DATE = "1970-01-01T00:00:00Z"  # of every record, so that reruns write the same bytes

INDEX = "_id {0}, file string, offset bigint, length bigint, url string, digest string, kind string"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path that names its scheme."""
    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the default file system, so that driver and executors mean the same place."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def record(uri: str, kind: str, url: str, digest: str, payload: bytes, refers: str | None, length: int) -> bytes:
    """One record as a gzip member. A revisit keeps the payload's digest and length but not the payload."""
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{uri}>", f"WARC-Target-URI: {_line(url)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}", "Content-Type: application/octet-stream", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:record:{refers}>")
    head = "\r\n".join(lines).encode("utf-8", "surrogatepass")
    return gzip.compress(head + b"\r\n\r\n" + body + b"\r\n\r\n", compresslevel=4, mtime=0)


def _line(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one unpacked record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def keepers(pages: DataFrame, id_col: str, payload_col: str, smallest: int) -> DataFrame:
    """Per payload that occurs in several records: (digest, keeper), the largest id holding it. Counted before the shuffle."""
    data = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("_id"), F.sha1(data).alias("_digest"), F.length(data).alias("_n")).filter(F.col("_n") >= smallest)
    groups = rows.groupBy("_digest").agg(F.max("_id").alias("_keeper"), F.count(F.lit(1)).alias("_copies"))
    return groups.filter(F.col("_copies") > 1).select("_digest", "_keeper")


def write(pages: DataFrame, folder: str, smallest: int = SMALLEST, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record per row and return the stored index (_id, file, offset, length, url, digest, kind).

    A null payload is empty, a null url empty. The keeper of equal payloads is the largest id; a null id is smaller than any other; rows that tie
    for the largest id are all responses. An empty table writes no archive.
    """
    spark = pages.sparkSession
    data = F.coalesce(F.col(payload_col), F.lit(""))
    # Only payloads that occur more than once are in the table of keepers, and the join may split a payload with many copies (AQE).
    rows = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), data.alias("_data"), F.sha1(F.encode(data, "UTF-8")).alias("_sha"))
    keep = keepers(pages, id_col, payload_col, smallest)
    # A keeper is null only where all ids are: then all rows tie for the largest.
    typed = rows.join(keep, rows["_sha"] == keep["_digest"], "left").select(
        "_id", "_url", "_data", "_sha", F.when(F.col("_keeper").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_keeper")), F.col("_keeper").cast("string")).alias("_refers")
    )
    target = qualified(spark, folder)
    kind_ = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = out = None
        offset, name = 0, f"{target}/{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    store, path = open_store(name)
                    out = store.open_output_stream(path, compression=None)
                index: dict[str, list] = {k: [] for k in ("offset", "length", "kind")}
                for id_, url, text, sha, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = text.encode("utf-8", "surrogatepass")
                    kind = "response" if refers is None else "revisit"
                    block = record(str(id_), kind, url, sha, payload, refers, len(payload))
                    out.write(block)
                    index["offset"].append(offset)
                    index["length"].append(len(block))
                    index["kind"].append(kind)
                    offset += len(block)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([name] * n), pa.array(index["offset"], pa.int64()), pa.array(index["length"], pa.int64()), batch.column(1), batch.column(3), pa.array(index["kind"], pa.string())],
                    names=["_id", "file", "offset", "length", "url", "digest", "kind"],
                )
        finally:
            if out is not None:
                out.close()

    _make_folder(spark, target)
    return settle(typed.mapInArrow(run, INDEX.format(kind_)))


def _make_folder(spark: SparkSession, target: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


def ranges(index: DataFrame, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """Wanted records joined to byte ranges: (file, start, end, records). One archive's records pass a window, the archive being one task's output."""
    order = Window.partitionBy("file").orderBy("offset")
    far = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order) > gap
    rows = index.withColumn("_far", F.coalesce(far.cast("int"), F.lit(0))).withColumn("_run", F.sum("_far").over(order))
    rows = rows.withColumn("_part", F.floor(F.col("offset") / most))
    spot = F.struct("offset", "length", "_id")
    return rows.groupBy("file", "_run", "_part").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(spot)).alias("records"))


def read(index: DataFrame, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """The records that the index rows name: (_id, url, kind, digest, length, refers, payload). Any subset of an index can be given.

    Every payload present is checked against its digest; a mismatch raises.
    """
    kind_ = dict(index.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, end, spots in zip(*(batch.column(n).to_pylist() for n in ("file", "start", "end", "records"))):
                store, path = open_store(file)
                with store.open_input_file(path) as source:
                    block = source.read_at(end - start, start)
                out: dict[str, list] = {k: [] for k in ("_id", "url", "kind", "digest", "length", "refers", "payload")}
                for spot in spots:
                    at = spot["offset"] - start
                    fields, payload = parse(zlib.decompress(block[at : at + spot["length"]], 31))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
                    refers = fields.get("WARC-Refers-To")
                    for k, v in zip(out, (spot["_id"], fields["WARC-Target-URI"], fields["WARC-Type"], digest, int(fields["X-Payload-Length"]), refers and refers[12:-1], payload)):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["_id"], batch.schema.field("records").type.value_type.field("_id").type), pa.array(out["url"], pa.string()), pa.array(out["kind"], pa.string()), pa.array(out["digest"], pa.string()), pa.array(out["length"], pa.int64()), pa.array(out["refers"], pa.string()), pa.array(out["payload"], pa.binary())],
                    names=list(out),
                )

    schema = f"_id {kind_}, url string, kind string, digest string, length bigint, refers string, payload binary"
    # As many tasks as ranges of the usual size; without a number they would be joined by the few bytes of the index rows.
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // most))
    return ranges(index, gap, most).select("file", "start", "end", "records").repartition(tasks, "file", "start").mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", smallest: int = SMALLEST) -> DataFrame:
    """Write all rows, read all records back: (id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    index = write(pages, f"{work_folder(spark)}/warc-{uuid.uuid4().hex}", smallest, id_col, url_col, payload_col)
    return read(index).select(
        F.col("_id").alias(id_col), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.col("refers").cast(dict(pages.dtypes)[id_col]).alias("refers_to"),
    )


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') h, strlen(coalesce(html, '')) n FROM pages),
k AS (SELECT sha1(h) d, max(page_id) keeper, count(*) c FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
CASE WHEN c > 1 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN c > 1 AND keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON sha1(h) = d"""
