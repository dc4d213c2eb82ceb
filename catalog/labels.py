"""Label, layout, split and export queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillage.operators import exports, labels, split

from .images import DOC_PATH, doc_files
from .registry import query, table
from .tables import split_sql

DOCS = f"d AS (SELECT doc_id, lang, source, {DOC_PATH} AS path, doc_id || '.txt' AS file, doc_id::VARCHAR AS stem, doc_id % 29 = 0 AS corrupted FROM documents)"
WITH_DOCS = f"WITH {DOCS} "


def docs(spark, folder):
    return doc_files(spark, folder).select(
        "doc_id", "lang", "source", "path", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.col("doc_id").cast("string").alias("stem"), (F.col("doc_id") % 29 == 0).alias("corrupted"),
    )


def boxes(spark, folder):
    """Boxes on pictures of 200x100: the first floats of an embedding are the corners of up to three boxes."""
    e = table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("e")
    ).withColumn("box_no", F.explode(F.sequence(F.lit(1), F.lit(3)))).filter(F.col("box_no") <= F.col("vec_id") % 4)
    at = lambda i, size: (F.col("e")[(F.col("box_no") - 1) * 4 + i] + 0.4) * size
    return e.select(
        F.concat(F.lit("images/"), F.col("vec_id").cast("string"), F.lit(".bmp")).alias("path"), "box_no",
        F.col("label").cast("long").alias("class_id"), at(0, 250).alias("x1"), at(1, 125).alias("y1"), at(2, 250).alias("x2"), at(3, 125).alias("y2"),
        F.lit(200).alias("width"), F.lit(100).alias("height"),
    )


def box_images(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("images/"), F.col("vec_id").cast("string"), F.lit(".bmp")).alias("path"), F.col("vec_id").cast("string").alias("stem"),
        F.lit(200).alias("width"), F.lit(100).alias("height"),
    )


BOXES = """raw AS (SELECT 'images/' || vec_id || '.bmp' AS path, n::INT AS box_no, label::BIGINT AS class_id,
   (embedding[(n - 1) * 4 + 1]::DOUBLE + 0.4::DOUBLE) * 250 AS a1, (embedding[(n - 1) * 4 + 2]::DOUBLE + 0.4::DOUBLE) * 125 AS b1,
   (embedding[(n - 1) * 4 + 3]::DOUBLE + 0.4::DOUBLE) * 250 AS a2, (embedding[(n - 1) * 4 + 4]::DOUBLE + 0.4::DOUBLE) * 125 AS b2
   FROM embeddings, range(1, 4) t(n) WHERE n <= vec_id % 4),
  c AS (SELECT path, box_no, class_id, least(200, greatest(0, least(a1, a2))) AS x1, least(100, greatest(0, least(b1, b2))) AS y1,
   least(200, greatest(0, greatest(a1, a2))) AS x2, least(100, greatest(0, greatest(b1, b2))) AS y2 FROM raw),
  b AS (SELECT * FROM c WHERE x2 - x1 >= 4 AND y2 - y1 >= 4),
  im AS (SELECT 'images/' || vec_id || '.bmp' AS path, vec_id::VARCHAR AS stem FROM embeddings)"""
WITH_BOXES = f"WITH {BOXES} "
SPLIT_IMAGES = ", s AS (" + split_sql("im", "stem", "1", "path, stem") + ") "


def good_boxes(spark, folder):
    return labels.normalise_boxes(boxes(spark, folder))


def split_images(spark, folder):
    return split.split(box_images(spark, folder), ["stem"])


# ---------------------------------------------------------------- splits of labelled sets

FOLDER_SPLIT = ", s AS (" + split_sql("(SELECT doc_id, path, source AS label, file FROM d)", "path", "label", "path, label, file") + ") "


@query("l04_folder_split", WITH_DOCS + FOLDER_SPLIT + "SELECT path, label, split, split || '/' || label || '/' || file AS target FROM s")
def l04(spark, folder):
    return labels.split_folders(docs(spark, folder).select("path"))


def _mapping(spark, folder):
    """Labels for documents, among them files that do not exist."""
    lab = table(spark, folder, "labels").select("quality", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"))
    listing = docs(spark, folder).filter("doc_id % 7 <> 3").select("file")
    return lab.select(F.col("quality").alias("label"), "file"), listing


MAPPING = "map AS (SELECT quality AS label, doc_id || '.txt' AS file FROM labels), have AS (SELECT doc_id || '.txt' AS file FROM documents WHERE doc_id % 7 <> 3)"


@query("l05_mapping_split", f"WITH {MAPPING} " + split_sql("(SELECT label, map.file FROM map WHERE file IN (SELECT file FROM have))", "file", "label", "label, file"))
def l05(spark, folder):
    return labels.split_mapping(*_mapping(spark, folder))


@query("l05_missing_files", f"WITH {MAPPING} SELECT label, count(*) AS missing FROM map WHERE file NOT IN (SELECT file FROM have) GROUP BY 1")
def l05_missing(spark, folder):
    return labels.missing_files(*_mapping(spark, folder))


@query("l06_detection_split", WITH_BOXES + SPLIT_IMAGES + """SELECT stem, split, (SELECT count(*) FROM b WHERE b.path = s.path) AS boxes FROM s""")
def l06(spark, folder):
    b = good_boxes(spark, folder).withColumn("stem", labels.stem_of(labels.name_of(F.col("path"))))
    return labels.split_detection(box_images(spark, folder), b).select("stem", "split", "boxes")


@query("l07_counts_per_split", WITH_BOXES + SPLIT_IMAGES + """, n AS (SELECT split, (SELECT count(*) FROM b WHERE b.path = s.path) AS boxes FROM s)
  SELECT split, count(*) AS images, sum(boxes)::BIGINT AS boxes FROM n GROUP BY 1""")
def l07(spark, folder):
    b = good_boxes(spark, folder).withColumn("stem", labels.stem_of(labels.name_of(F.col("path"))))
    return split.split_counts(labels.split_detection(box_images(spark, folder), b), boxes="boxes")


@query("l07_counts_by_label", WITH_DOCS + FOLDER_SPLIT + """SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid,
   count(*) FILTER (split = 'test') AS test FROM s GROUP BY 1""")
def l07_labels(spark, folder):
    return labels.counts_by_label(labels.split_folders(docs(spark, folder).select("path")))


@query("l08_detect_layout", """WITH p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'images/' ELSE 'labels/' END || doc_id AS path FROM documents)
  SELECT CASE WHEN bool_or(path = 'label_mapping.py') THEN 2 WHEN bool_or(path LIKE 'images/%') AND bool_or(path LIKE 'labels/%') THEN 3 ELSE 1 END AS layout FROM p""")
def l08(spark, folder):
    paths = F.concat(F.when(F.col("doc_id") % 2 == 0, "images/").otherwise("labels/"), F.col("doc_id").cast("string"))
    return labels.detect_layout(table(spark, folder, "documents").select(paths.alias("path")))


@query("l09_labels_from_folders", """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE source || '/' || lang END AS rel FROM documents),
   n AS (SELECT doc_id, split_part(rel, '/', 1) AS label FROM p WHERE rel <> '') SELECT doc_id, label, dense_rank() OVER (ORDER BY label) - 1 AS label_id FROM n""")
def l09(spark, folder):
    d = table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat_ws("/", "source", "lang")).alias("rel")
    )
    return labels.labels_from_folders(d)[0].select("doc_id", "label", "label_id")


# ---------------------------------------------------------------- classes and label joins


@query("x01_check_classes", """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN ' ' WHEN p_partkey % 5 = 0 THEN p_type || '?' ELSE ' ' || p_name || ' ' END AS name FROM part),
   c AS (SELECT *, trim(name) AS clean, count(*) OVER (PARTITION BY lower(trim(name))) AS k FROM n)
  SELECT p_partkey, clean, CASE WHEN clean = '' THEN 'empty' WHEN regexp_matches(clean, '[\\\\/:*?"<>|]') THEN 'forbidden character' WHEN k > 1 THEN 'not unique' END AS problem FROM c""")
def x01(spark, folder):
    p = table(spark, folder, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 7 == 0, " ").when(F.col("p_partkey") % 5 == 0, F.concat("p_type", F.lit("?")))
        .otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name")
    )
    return labels.check_classes(p).select("p_partkey", "clean", "problem")


@query("x01_class_table", "SELECT row_number() OVER (ORDER BY source) - 1 AS id, source AS name FROM (SELECT DISTINCT source FROM documents)")
def x01_table(spark, folder):
    return labels.class_table(table(spark, folder, "documents").select("source").distinct(), "source", ["source"])


@query("x03_label_images", WITH_DOCS + "SELECT path, quality FROM d JOIN labels ON labels.doc_id = d.doc_id WHERE NOT corrupted")
def x03(spark, folder):
    return labels.label_images(docs(spark, folder), table(spark, folder, "labels"), "doc_id", "quality").select("path", "quality")


@query("x03_label_report", WITH_DOCS + """SELECT count(*) FILTER (NOT corrupted AND quality IS NOT NULL) AS labelled, count(*) FILTER (NOT corrupted AND quality IS NULL) AS unlabelled,
   count(*) FILTER (corrupted) AS unreadable FROM d LEFT JOIN labels ON labels.doc_id = d.doc_id""")
def x03_report(spark, folder):
    return labels.label_report(docs(spark, folder), table(spark, folder, "labels"), "doc_id", "quality")


# ---------------------------------------------------------------- exports


@query("x04_folder_export", WITH_DOCS + FOLDER_SPLIT + "SELECT path, split || '/' || label || '/' || file AS target FROM s")
def x04(spark, folder):
    df = labels.split_folders(docs(spark, folder).select("path")).drop("target").withColumn("file", labels.name_of(F.col("path")))
    return exports.folder_targets(df).select("path", "target")


@query("x05_mapping_rows", """SELECT quality::INT AS label_id, row_number() OVER (PARTITION BY quality ORDER BY doc_id || '.txt') AS position, doc_id || '.txt' AS file FROM labels""")
def x05(spark, folder):
    lab = table(spark, folder, "labels")
    return labels.mapping_rows(lab.select(F.col("quality").cast("int").alias("label_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file")))


@query("x06_yolo_lines", WITH_BOXES + """SELECT 'labels/' || stem || '.txt' AS file, box_no AS line_no, CASE WHEN box_no IS NOT NULL THEN
   printf('%d %.6f %.6f %.6f %.6f', class_id, (x1 + x2) / 2 / 200, (y1 + y2) / 2 / 100, (x2 - x1) / 200, (y2 - y1) / 100) END AS line FROM im LEFT JOIN b ON b.path = im.path""")
def x06(spark, folder):
    return labels.yolo_lines(box_images(spark, folder), good_boxes(spark, folder))


COCO = SPLIT_IMAGES + """, ci AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY path) AS id, path FROM s) """


@query("x09_coco_images", WITH_BOXES + COCO + "SELECT split, id, path, substr(path, 8) AS file_name, 200 AS width, 100 AS height FROM ci")
def x09(spark, folder):
    return labels.coco_images(split_images(spark, folder))


@query("x09_coco_annotations", WITH_BOXES + COCO + """SELECT split, row_number() OVER (PARTITION BY split ORDER BY ci.id, box_no) AS id, ci.id AS image_id, class_id + 1 AS category_id,
   round(x1, 2) AS x, round(y1, 2) AS y, round(x2 - x1, 2) AS w, round(y2 - y1, 2) AS h, round((x2 - x1) * (y2 - y1), 2) AS area, 0 AS iscrowd FROM b JOIN ci ON ci.path = b.path""")
def x09_annotations(spark, folder):
    a = labels.coco_annotations(labels.coco_images(split_images(spark, folder)), good_boxes(spark, folder))
    return a.select("split", "id", "image_id", "category_id", *[F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")], "area", "iscrowd")


@query("x12_normalise_boxes", WITH_BOXES + "SELECT path, box_no, class_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM b")
def x12(spark, folder):
    return good_boxes(spark, folder).select("path", "box_no", "class_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("x14_stale_labels", WITH_BOXES + """SELECT path, box_no FROM b WHERE CAST(split_part(split_part(path, '/', 2), '.', 1) AS BIGINT) % 5 IN (0, 1)""")
def x14(spark, folder):
    changed = F.col("stem").cast("long") % 5
    now = box_images(spark, folder).filter(changed != 0).withColumn("width", F.when(changed == 1, 100).otherwise(F.col("width")))
    return labels.stale_labels(good_boxes(spark, folder), now).select("path", "box_no")
