"""Queries that write the given tables as files below the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tillage.operators import exports, imagecopies, labels, rasters, split
from tillage.plans.lineage import work_folder
from tillage.plans.recipe import Recipe
from tillage.sources import images as image_files
from tillage.sources import sinks
from tillage.sources.tables import load_table, read_csv, read_json

from .images import WITH_PICTURES, pictures
from .labels import BOXES, COCO, WITH_BOXES, box_images, good_boxes, split_images
from .registry import query, table
from .tables import WITH_LINE, WITH_ORDERS, line_small, orders_gaps, split_sql


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{uuid.uuid4().hex}-{name}"


@query("s01_csv_round_trip", WITH_ORDERS + """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM g""")
def s01(spark, folder):
    """A table with gaps as CSV: types and nulls come back."""
    there = new_folder(spark, "orders.csv")
    sinks.write_csv(orders_gaps(spark, folder).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), there, [folder])
    return load_table(spark, there)


@query("s02_json_read", """SELECT event_id, event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events""")
def s02(spark, folder):
    """Objects with missing keys, a thousand per document, the folder of documents read as one table with united keys."""
    there = new_folder(spark, "events")
    e = table(spark, folder, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    file = F.concat(F.lit("part-"), F.floor(F.col("event_id") / 1000).cast("string"), F.lit(".json"))
    body = e.select(file.alias("file"), "event_id", F.to_json(F.struct(*e.columns)).alias("line"))
    ends = body.groupBy("file").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    comma = F.when(F.col("event_id") > F.floor(F.col("event_id") / 1000) * 1000, ",").otherwise("")  # the ids are dense
    lines = body.select("file", F.col("event_id").alias("line_no"), F.concat(comma, "line").alias("line"))
    lines = lines.unionByName(ends.select("file", (F.col("first") - 1).alias("line_no"), F.lit("[").alias("line")))
    lines = lines.unionByName(ends.select("file", (F.col("last") + 1).alias("line_no"), F.lit("]").alias("line")))
    sinks.save_lines(lines, there)
    return read_json(spark, there).select("event_id", "event_type", "value")


@query("s12_split_files", split_sql("(SELECT c_custkey, c_mktsegment FROM customer)", "c_custkey", "1", "c_custkey, c_mktsegment", (0.7, 0.15, 0.15)))
def s12(spark, folder):
    there = new_folder(spark, "splits")
    parts = split.split(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"], split.TABLE_RATIOS)
    sinks.write_splits(parts, there, [folder])
    return spark.read.option("header", True).schema("c_custkey long, c_mktsegment string, split string").csv(there)


@query("s14_csv_with_mark", "SELECT c_custkey, c_name FROM customer")
def s14(spark, folder):
    there = new_folder(spark, "rows.csv")
    sinks.write_csv(table(spark, folder, "customer").select("c_custkey", "c_name"), there, [folder], bom=True)
    return read_csv(spark, there)


@query("s15_null_report", WITH_ORDERS + """SELECT 'o_totalprice' AS "column", count(*) - count(o_totalprice) AS cells FROM g UNION ALL SELECT 'o_orderdate', count(*) - count(o_orderdate) FROM g
  UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority) FROM g""")
def s15(spark, folder):
    there = new_folder(spark, "nulls")
    sinks.write_null_report(orders_gaps(spark, folder), ["o_orderkey"], there, [folder])
    return spark.read.option("header", True).csv(f"{there}/cells").groupBy("column").agg(F.count(F.lit(1)).alias("cells"))


@query("s16_image_round_trip", WITH_PICTURES + """SELECT 'p/' || id || CASE WHEN id % 2 = 0 THEN '.png' ELSE '.bmp' END AS target, corrupted, CASE WHEN NOT corrupted THEN pixels END AS pixels FROM files
  LEFT JOIN (SELECT id AS i, string_agg(printf('%02x%02x%02x', r, gg, b), '' ORDER BY p) AS pixels FROM px GROUP BY id) ON i = id WHERE NOT corrupted""")
def s16(spark, folder):
    """Pictures encoded as BMP and PNG, written as files by the executors, listed and decoded again."""
    there = new_folder(spark, "pictures")
    ext = F.when(F.col("id") % 2 == 0, ".png").otherwise(".bmp")
    df = rasters.to_rgb(pictures(spark, folder)).filter(~F.col("corrupted")).withColumn("ext", ext)
    out = rasters.encode(df).select(F.concat(F.lit("p/"), F.col("id").cast("string"), "ext").alias("target"), "content")
    sinks.save_files(out, there, [folder])
    back = image_files.read_images(spark, there)
    return back.select(F.concat(F.lit("p/"), "name").alias("target"), "corrupted", F.lower(F.hex("data")).alias("pixels"))


@query("s07_listed_copies", WITH_PICTURES + """, f2 AS (SELECT m.path, m.content FROM (SELECT files.path, content FROM files JOIN m0 ON m0.id = files.id) m)
  SELECT path, CASE WHEN path <> min(path) OVER (PARTITION BY content) THEN min(path) OVER (PARTITION BY content) END AS dup_of FROM f2""")
def s07(spark, folder):
    """Written PNG files listed from a folder; copies found by file content alone."""
    there = new_folder(spark, "copies")
    four = rasters.apply_raster(pictures(spark, folder).filter(~F.col("corrupted")), _with_alpha, stacked=True)
    out = rasters.encode(four.withColumn("ext", F.lit(".png"))).select(F.concat("path", F.lit(".png")).alias("target"), "content")
    sinks.save_files(out, there, [folder])
    shown = F.regexp_extract("path", r"(set/.*)\.png$", 1)
    files = image_files.list_images(spark, there).select(shown.alias("path"), "content")
    return imagecopies.exact_copies(files).select("path", "dup_of")


def _with_alpha(a):
    import numpy as np

    rgb = a if a.shape[-1] >= 3 else np.repeat(a, 3, axis=-1)
    return rgb if rgb.shape[-1] == 4 else np.concatenate([rgb, np.full((*rgb.shape[:-1], 1), 255, np.uint8)], axis=-1)


@query("x11_box_files", WITH_BOXES + """SELECT stem, class_id::INT AS class_id, round((x1 + x2) / 2 / 200, 6) AS xc, round((y2 - y1) / 100, 6) AS h FROM b JOIN im ON im.path = b.path""")
def x11(spark, folder):
    """Label files of all pictures, written and read back; empty files are background."""
    there = new_folder(spark, "yolo")
    sinks.save_lines(labels.yolo_lines(box_images(spark, folder), good_boxes(spark, folder)), there)
    return image_files.read_box_files(spark, f"{there}/labels").select("stem", "class_id", "xc", "h")


@query("x10_mapping_file", """SELECT quality::BIGINT AS label_id, CASE quality WHEN 0 THEN 'poor' ELSE 'it''s good' END AS name, doc_id || '.txt' AS file FROM labels""")
def x10(spark, folder):
    """The mapping document of all labelled files, written and parsed as data."""
    there = new_folder(spark, "mapping")
    classes = spark.createDataFrame([(0, "poor"), (1, "it's good")], "id long, name string")
    lab = table(spark, folder, "labels").select(F.col("quality").cast("int").alias("label_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"))
    sinks.save_lines(exports.mapping_lines(classes, labels.mapping_rows(lab)), there)
    return image_files.read_mapping(spark, f"{there}/label_mapping.py")


@query("x09_coco_documents", WITH_BOXES + COCO + """SELECT split, row_number() OVER (PARTITION BY split ORDER BY ci.id, box_no) AS id, ci.id AS image_id, class_id + 1 AS category_id,
   round((x2 - x1) * (y2 - y1), 2) AS area FROM b JOIN ci ON ci.path = b.path""")
def x09(spark, folder):
    """One COCO document per split, written as lines and read back as JSON."""
    there = new_folder(spark, "coco")
    rows = labels.coco_images(split_images(spark, folder))
    notes = labels.coco_annotations(rows, good_boxes(spark, folder))
    classes = labels.class_table(good_boxes(spark, folder).select(F.concat(F.lit("class "), F.col("class_id").cast("string")).alias("name"), "class_id").distinct(), "name", ["class_id"])
    sinks.save_lines(exports.coco_lines(rows, notes, classes), there)
    schema = "annotations array<struct<id long, image_id long, category_id long, area double>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(f"{there}/annotations/*.json")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"instances_(\w+)\.json", 1)
    return docs.select(name.alias("split"), F.explode("annotations").alias("a")).select("split", "a.*")


@query("x15_split_exports", split_sql("im", "stem", "1", "stem").replace("SELECT stem", f"WITH {BOXES} SELECT stem", 1))
def x15(spark, folder):
    """Each split of a detection set exported on its own: label files in one folder per split."""
    there = new_folder(spark, "parts")
    parts = split_images(spark, folder).select("stem", "split")
    lines = parts.select(F.concat_ws("/", "split", F.concat("stem", F.lit(".txt"))).alias("file"), F.lit(1).cast("long").alias("line_no"), F.col("stem").alias("line"))
    sinks.save_lines(lines, there)
    back = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(there)
    return back.select(F.col("value").alias("stem"), F.element_at(F.split("_metadata.file_path", "/"), -2).alias("split"))


@query("c08_resumed_session", WITH_LINE + "SELECT DISTINCT l_returnflag, l_quantity AS quantity, l_discount FROM s")
def c08(spark, folder):
    there = new_folder(spark, "session")
    steps = Recipe(line_small(spark, folder)).then("drop_columns", columns=["l_linestatus"]).then("drop_duplicates")
    steps.then("rename", old="l_quantity", new="quantity").save(there)
    return Recipe.resume(spark, there).result()


@query("s13_change_log", """SELECT 'tillage' AS tool, 'lineitem' AS file, count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)) AS rows_now,
   2::INT AS steps FROM lineitem""")
def s13(spark, folder):
    there = new_folder(spark, "log")
    steps = Recipe(line_small(spark, folder)).then("drop_duplicates").then("rename", old="l_quantity", new="quantity")
    steps.write_log(there, file="lineitem")
    return spark.read.json(there).select("tool", "file", "rows_before", "rows_now", F.size("steps").alias("steps"))
