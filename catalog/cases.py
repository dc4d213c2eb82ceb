"""Further cases of the operators: values, groups, splits and names that the first queries do not meet."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from tillage.operators import chartdata, encode, exports, labels, profile, rasters, split
from tillage.sources import images as image_files
from tillage.sources import sinks
from tillage.sources.tables import load_table, read_json

from .files import new_folder
from .images import WITH_PICTURES, pictures
from .labels import MAPPING, SPLIT_IMAGES, WITH_BOXES, _mapping, box_images, good_boxes, split_images
from .registry import query, table
from .tables import split_sql

# ---------------------------------------------------------------- reading


@query("s01_csv_line_breaks", "SELECT doc_id, text, lang FROM documents")
def s01_breaks(spark, folder):
    """Texts with quotes and line breaks written as CSV and read again, each file in blocks by several tasks."""
    there = new_folder(spark, "texts.csv")
    sinks.write_csv(table(spark, folder, "documents").select("doc_id", "text", "lang"), there, [folder])
    return load_table(spark, there, split=True)


@query("s02_json_blocks", "SELECT doc_id, text, lang FROM documents")
def s02_blocks(spark, folder):
    """One array per language whose texts hold quotes, braces and line breaks, each document read in blocks by several tasks."""
    there = new_folder(spark, "texts")
    d = table(spark, folder, "documents").select("doc_id", "text", "lang")
    body = d.select(F.concat("lang", F.lit(".json")).alias("file"), F.col("doc_id").alias("line_no"), F.concat(F.to_json(F.struct(*d.columns)), F.lit(",")).alias("line"))
    ends = body.groupBy("file").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))
    heads = ends.select("file", (F.col("first") - 1).alias("line_no"), F.lit("[").alias("line"))
    closed = body.join(F.broadcast(ends.select("file", "last")), "file")  # one row per language
    closed = closed.select("file", "line_no", F.when(F.col("line_no") == F.col("last"), F.regexp_replace("line", ",$", "]")).otherwise(F.col("line")).alias("line"))
    sinks.save_lines(closed.unionByName(heads), there)
    return read_json(spark, there, split=True).select("doc_id", "text", "lang")


SHEET_ROWS = 2000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _workbook(header: list[str], rows: list[tuple]) -> bytes:
    """A workbook of text cells and numbers with one sheet."""
    def cell(v) -> str:
        return f"<c><v>{v!r}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(header), *rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="1" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


@query("s03_workbooks", "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey // 2000 % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def s03(spark, folder):
    """A table as many workbooks whose columns differ in order and number, read as one table by column name."""
    there = new_folder(spark, "books")
    rows = table(spark, folder, "customer").withColumn("book", F.floor(F.col("c_custkey") / SHEET_ROWS))

    def books(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["book"].iloc[0])
        header = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"] if n % 2 == 0 else ["c_acctbal", "c_custkey", "c_name"]
        content = _workbook(header, [tuple(x) for x in pdf[header].astype(object).itertuples(index=False)])
        return pd.DataFrame({"target": [f"{n}.xlsx"], "content": [content]})

    sinks.save_files(rows.groupBy("book").applyInPandas(books, "target string, content binary"), there, [folder])
    return load_table(spark, f"{there}/*.xlsx").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("s08_archives", """SELECT conv_id // 50 AS archive, 't' || turn || '/' || conv_id || '.png' AS path, strlen(text)::BIGINT AS size, md5(text) AS digest FROM conversations""")
def s08(spark, folder):
    """Files packed into archives of bounded size, with entries to skip among them, and unpacked again."""
    there = new_folder(spark, "archives")
    rows = table(spark, folder, "conversations").withColumn("archive", F.floor(F.col("conv_id") / 50).cast("long"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("__MACOSX/x.png", "no")
            z.writestr(".hidden.png", "no")
            for r in pdf.itertuples():
                z.writestr(f"t{r.turn}/{r.conv_id}.png", r.text)
        return pd.DataFrame({"target": [f"{pdf['archive'].iloc[0]}.zip"], "content": [out.getvalue()]})

    sinks.save_files(rows.groupBy("archive").applyInPandas(pack, "target string, content binary"), there, [folder])
    back = image_files.read_archives(spark, there)
    return back.select(F.regexp_extract("archive", r"(\d+)\.zip$", 1).cast("long").alias("archive"), "path", "size", F.md5("content").alias("digest"))


@query("s18_tiff_round_trip", WITH_PICTURES + """SELECT id, string_agg(printf('%02x%02x%02x', r, gg, b), '' ORDER BY p) AS pixels FROM px GROUP BY id""")
def s18(spark, folder):
    """Pictures encoded as TIFF, written, and decoded again."""
    there = new_folder(spark, "tiff")
    df = rasters.to_rgb(pictures(spark, folder)).filter(~F.col("corrupted")).withColumn("ext", F.lit(".tiff"))
    sinks.save_files(rasters.encode(df).select(F.concat(F.col("id").cast("string"), "ext").alias("target"), "content"), there, [folder])
    back = image_files.read_images(spark, there)
    return back.select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("id"), F.lower(F.hex("data")).alias("pixels"))


# ---------------------------------------------------------------- types and charts


@query("p05_number_texts", """WITH t AS (SELECT l_orderkey || CASE l_linenumber % 2 WHEN 0 THEN 'd' ELSE 'f' END AS grade, (l_quantity / 4)::VARCHAR AS plain, CASE WHEN l_tax > 0.04 THEN l_orderkey || 'e2' ELSE '-.5' END AS power FROM lineitem),
  c AS (SELECT 'grade' AS "column", grade AS v FROM t UNION ALL SELECT 'plain', plain FROM t UNION ALL SELECT 'power', power FROM t)
  SELECT "column", CASE WHEN bool_and(regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) THEN 'numeric' ELSE 'text' END AS semantic_type FROM c GROUP BY 1""")
def p05_texts(spark, folder):
    """Texts that a lenient cast would take for numbers, next to real ones."""
    df = table(spark, folder, "lineitem").select(
        F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "d").otherwise("f")).alias("grade"),
        (F.col("l_quantity") / 4).cast("string").alias("plain"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.col("l_orderkey").cast("string"), F.lit("e2"))).otherwise("-.5").alias("power"),
    )
    return profile.semantic_types(df).select("column", "semantic_type")


def _boxes_sql(box: str, value: str, source: str) -> str:
    return f"""WITH d AS (SELECT {box} AS box, {value} AS v FROM {source}), q AS (SELECT box, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM d GROUP BY 1)
  SELECT d.box, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  count(*) FILTER (v NOT BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE) AS outliers FROM d JOIN q ON q.box = d.box GROUP BY 1"""


def _boxes(df, y, by):
    return chartdata.box_stats(df, y, by).select("box", "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "outliers")


@query("v05_many_boxes", _boxes_sql("strftime(o_orderdate, '%Y-%m')", "o_totalprice", "orders"))
def v05_many(spark, folder):
    """Far more text groups than twelve."""
    return _boxes(table(spark, folder, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), "o_totalprice", "month")


@query("v05_numeric_boxes", _boxes_sql("l_linenumber::VARCHAR", "l_extendedprice", "lineitem"))
def v05_numeric(spark, folder):
    return _boxes(table(spark, folder, "lineitem"), "l_extendedprice", "l_linenumber")


@query("v05_web_boxes", _boxes_sql("'o_totalprice'", "o_totalprice", "orders"))
def v05_web(spark, folder):
    """The other rule: too many groups are one box."""
    df = table(spark, folder, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    b = chartdata.box_stats(df, "o_totalprice", "month", groups="web")
    return b.select("box", "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "outliers")


@query("v03_bars_decimals", """SELECT l_linestatus AS hue, CASE WHEN v = 0 THEN '0' ELSE rtrim(printf('%.15f', v), '0') END AS label, count(*) AS n FROM (SELECT l_linestatus, round(l_discount / 100, 4) AS v FROM lineitem) GROUP BY ALL""")
def v03_decimals(spark, folder):
    """Few numbers that two digits cannot tell apart."""
    return chartdata.bar_bins(table(spark, folder, "lineitem").withColumn("v", F.round(F.col("l_discount") / 100, 4)), "v", "l_linestatus")


@query("e06_two_classes", """WITH g AS (SELECT o_orderkey, o_orderpriority AS p, (o_orderstatus <> 'F')::INT::DOUBLE AS y FROM orders),
  a AS (SELECT avg(y) AS m, var_pop(y) AS v FROM g), s AS (SELECT p, count(*) AS n, avg(y) AS cm, var_pop(y) AS cv FROM g GROUP BY p)
  SELECT o_orderkey, round(n * v / (n * v + cv) * cm + (1 - n * v / (n * v + cv)) * m, 8) AS o_orderpriority FROM g, a, s WHERE s.p = g.p""")
def e06_classes(spark, folder):
    """Target encoding by a text target of two classes."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"))
    return encode.target(o, "o_orderpriority", "state").select("o_orderkey", F.round("o_orderpriority", 8).alias("o_orderpriority"))


# ---------------------------------------------------------------- splits, names, exports

_KEY = "concat(CASE WHEN a IS NULL THEN 'null' ELSE length(a::VARCHAR) || '=' || a END, ':', CASE WHEN b IS NULL THEN 'null' ELSE length(b::VARCHAR) || '=' || b END)"


@query("l02_composite_keys", split_sql("(SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 2 END AS a, CASE WHEN c_custkey % 2 = 1 THEN c_custkey // 2 END AS b FROM customer)", _KEY, "1", "a, b", (0.5, 0.25, 0.25)))
def l02_keys(spark, folder):
    """Keys of two parts of which one is null: (x, null) and (null, x) are different keys."""
    k = F.col("c_custkey")
    df = table(spark, folder, "customer").select(F.when(k % 2 == 0, F.floor(k / 2)).alias("a"), F.when(k % 2 == 1, F.floor(k / 2)).alias("b"))
    return split.split(df, ["a", "b"], (50, 25, 25))


@query("x02_taken_names", """WITH RECURSIVE o AS (SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'A_1' WHEN 2 THEN 'a_1_1' WHEN 3 THEN 'a_' || (doc_id % 7) ELSE 'A' END AS stem,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
  step AS (SELECT lang, 0::BIGINT AS i, []::VARCHAR[] AS used, NULL::BIGINT AS doc_id, NULL::VARCHAR AS target FROM (SELECT DISTINCT lang FROM o)
    UNION ALL SELECT lang, i, list_append(used, lower(free)), doc_id, free || '.txt' FROM (
      SELECT s.lang, o.i, s.used, o.doc_id, list_filter(list_prepend(o.stem, [o.stem || '_' || n FOR n IN range(1, o.i + 1)]), lambda x: NOT list_contains(s.used, lower(x)))[1] AS free
      FROM step s JOIN o ON o.lang = s.lang AND o.i = s.i + 1))
  SELECT doc_id, lang, target FROM step WHERE doc_id IS NOT NULL""")
def x02_taken(spark, folder):
    """Wishes for names that other rows are numbered into."""
    stem = F.expr("CASE doc_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'A_1' WHEN 2 THEN 'a_1_1' WHEN 3 THEN concat('a_', doc_id % 7) ELSE 'A' END")
    wishes = table(spark, folder, "documents").select("doc_id", "lang", stem.alias("stem"), F.lit(".txt").alias("ext"))
    return labels.unique_names(wishes, "lang", "stem", "ext", ["doc_id"]).select("doc_id", "lang", "target")


@query("x09_coco_unsplit", WITH_BOXES + """, ci AS (SELECT row_number() OVER (ORDER BY path) AS id, path FROM im)
  SELECT 'all' AS split, row_number() OVER (ORDER BY ci.id, box_no) AS id, ci.id AS image_id, class_id + 1 AS category_id, round((x2 - x1) * (y2 - y1), 2) AS area FROM b JOIN ci ON ci.path = b.path""")
def x09_unsplit(spark, folder):
    """The COCO document of a set that was never split, written in parts; the annotation lines are read where they lie."""
    there = new_folder(spark, "coco-all")
    rows = labels.coco_images(box_images(spark, folder).withColumn("split", F.lit("all")))
    notes = labels.coco_annotations(rows, good_boxes(spark, folder))
    classes = labels.class_table(good_boxes(spark, folder).select(F.concat(F.lit("class "), F.col("class_id").cast("string")).alias("name"), "class_id").distinct(), "name", ["class_id"])
    sinks.save_lines_in_parts(exports.coco_lines(rows, notes, classes), there)
    lines = spark.read.text(f"{there}/annotations").select(F.regexp_extract(F.col("_metadata.file_name"), r"instances_(\w+)\.json", 1).alias("split"), F.rtrim(F.col("value"), F.lit(",")).alias("v"))
    note = F.from_json("v", "id long, image_id long, category_id long, area double")
    return lines.filter(F.col("v").contains('"image_id"')).select("split", note.alias("a")).select("split", "a.*")


@query("x05_mapping_large_ids", "SELECT item_id * 1000000007 + 5000000 AS label_id, count(*) AS files FROM benchmark, range(3) GROUP BY 1")
def x05_large(spark, folder):
    """A label mapping whose ids are far beyond a million, written as a document; its lines must stay in order to be parsed."""
    there = new_folder(spark, "large-ids")
    ids = table(spark, folder, "benchmark").select((F.col("item_id") * 1000000007 + 5000000).alias("id"))
    rows = ids.select(F.col("id").alias("label_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("position")).withColumn("file", F.concat_ws("-", "label_id", "position"))
    sinks.save_lines(exports.mapping_lines(ids.withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string"))), rows), there)
    return image_files.read_mapping(spark, f"{there}/label_mapping.py").groupBy("label_id").agg(F.count("file").alias("files"))


_TREE = f"""WITH {MAPPING}, sp AS ({split_sql("(SELECT label, map.file FROM map WHERE file IN (SELECT file FROM have))", "file", "label", "label, file")}) """


@query("l05_classification_tree", _TREE + "SELECT label, split || '/images/' || file AS target FROM sp")
def l05_tree(spark, folder):
    """Where every image of a split classification set goes."""
    return exports.tree_targets(labels.split_mapping(*_mapping(spark, folder)), "classification").select("label", "target")


@query("x05_mapping_per_split", _TREE + "SELECT split, label::BIGINT AS label_id, 'class ' || label AS name, file FROM sp")
def x05_splits(spark, folder):
    """One mapping and one class list per split, written and read back."""
    there = new_folder(spark, "mapping-splits")
    parts = labels.split_mapping(*_mapping(spark, folder)).select(F.concat_ws("|", "split", "label").alias("key"), "split", "label", "file")
    rows = labels.mapping_rows(parts, "key", "file").select(
        F.substring_index("key", "|", 1).alias("split"), F.substring_index("key", "|", -1).cast("long").alias("label_id"), "position", "file"
    )
    classes = parts.select(F.col("label").cast("long").alias("id"), F.concat(F.lit("class "), F.col("label").cast("string")).alias("name")).distinct()
    lines = exports.mapping_lines(classes, rows, split="split").unionByName(exports.class_lines(classes, True, folders=split.SPLITS))
    sinks.save_lines(lines, there)
    found = [image_files.read_mapping(spark, f"{there}/{s}/label_mapping.py").withColumn("split", F.lit(s)) for s in split.SPLITS]
    listed = spark.read.text([f"{there}/{s}/classes.txt" for s in split.SPLITS]).select(F.substring_index("value", " ", 1).cast("long").alias("label_id")).distinct()
    return found[0].unionByName(found[1]).unionByName(found[2]).filter("file IS NOT NULL").join(listed, "label_id", "left_semi")


@query("l06_detection_tree", WITH_BOXES + SPLIT_IMAGES + "SELECT path, 'images/' || split || '/' || stem || '.bmp' AS target FROM s")
def l06_tree(spark, folder):
    """Where every image of a split detection set goes."""
    named = split_images(spark, folder).withColumn("file", labels.name_of(F.col("path")))
    return exports.tree_targets(named, "detection").select("path", "target")


@query("x06_yolo_tree", WITH_BOXES + SPLIT_IMAGES + """SELECT 'labels/' || split || '/' || stem || '.txt' AS file, box_no AS line_no, CASE WHEN box_no IS NOT NULL THEN class_id::VARCHAR END AS class
  FROM s LEFT JOIN b ON b.path = s.path UNION ALL SELECT 'data.yaml', i, NULL FROM range(5) t(i) UNION ALL SELECT 'classes.txt', class_id, NULL FROM (SELECT DISTINCT class_id FROM b)""")
def x06_tree(spark, folder):
    """All text files of the tree of a split detection set: labels per split, the class list and data.yaml at its root."""
    boxes = good_boxes(spark, folder)
    lines = labels.yolo_lines(split_images(spark, folder), boxes, split="split")
    classes = boxes.select(F.col("class_id").alias("id"), F.concat(F.lit("class "), F.col("class_id").cast("string")).alias("name")).distinct()
    yaml = exports.fixed_lines(spark, "data.yaml", exports.data_yaml(["a class"], (70, 20, 10))[:5])
    both = lines.select("file", F.col("line_no").cast("long").alias("line_no"), F.substring_index("line", " ", 1).alias("class"))
    rest = exports.class_lines(classes, False).unionByName(yaml).select("file", "line_no", F.lit(None).cast("string").alias("class"))
    return both.unionByName(rest)


# ---------------------------------------------------------------- model-based filling: what is determined


@query("m07_fill_model_bounds", """WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p FROM orders)
  SELECT o_orderkey, p IS NULL AS was_missing, p AS kept, TRUE AS within FROM g""")
def m07_bounds(spark, folder):
    """Present values stay, every gap is filled, and no fill leaves the range of the values it was learned from."""
    from tillage.operators import model_impute

    from .tables import orders_gaps

    df = orders_gaps(spark, folder).select("o_orderkey", "o_custkey", "o_totalprice")
    low, high = df.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    filled = model_impute.fill_model(df, "o_totalprice").withColumnRenamed("o_totalprice", "filled").drop("o_custkey")
    both = df.select("o_orderkey", "o_totalprice").join(filled, "o_orderkey")
    return both.select(
        "o_orderkey", F.col("o_totalprice").isNull().alias("was_missing"), F.when(F.col("o_totalprice").isNotNull(), F.col("filled")).alias("kept"),
        (F.col("filled").isNotNull() & F.col("filled").between(low, high)).alias("within"),
    )
