"""Documents of a dataset export as rows of ordered lines.

A document (a label mapping, a COCO file, a YOLO data file) is a table (file, line_no, line). Nothing is gathered:
the line writer of ``sources.sinks`` sorts the lines by file and number and streams them out.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import local_rows
from ..plans.lookup import lookup

# Line numbers are decimals of 38 digits: section, then id (any 64-bit number), then place.
SECTION, IDENT = 10**36, 10**16


def _place(section: int, ident: Column | None = None, place: Column | None = None) -> Column:
    """A line number that no id or place can carry into the next section."""
    wide = "decimal(38,0)"
    out = F.lit(str(section * SECTION)).cast(wide)
    if ident is not None:
        out = (out + (ident.cast("decimal(19,0)") * F.lit(str(IDENT)).cast("decimal(17,0)")).cast(wide)).cast(wide)
    return out if place is None else (out + place.cast(wide)).cast(wide)


def folder_targets(df: DataFrame, label: str = "label", file: str = "file", split: str | None = "split") -> DataFrame:
    """Target path of a folder export: (split /) label / file."""
    parts = ([split] if split and split in df.columns else []) + [label, file]
    return df.withColumn("target", F.concat_ws("/", *parts))


def tree_targets(df: DataFrame, kind: str, file: str = "file", split: str | None = "split") -> DataFrame:
    """Target path of an image in the tree of a split set: ``images/<split>/<file>`` for detection, ``<split>/images/<file>`` for classification.

    Without the split column the image goes to ``images/<file>``.
    """
    if kind not in ("detection", "classification"):
        raise ValueError("kind is detection or classification")
    part = [F.col(split)] if split and split in df.columns else []
    order = [F.lit("images"), *part] if kind == "detection" else [*part, F.lit("images")]
    return df.withColumn("target", F.concat_ws("/", *order, F.col(file)))


def fixed_lines(spark: SparkSession, file: str, texts: Sequence[str], start: int = 0) -> DataFrame:
    """A few given lines (``data.yaml``, headings) as rows of a document."""
    return local_rows(spark, [(file, start + i, t) for i, t in enumerate(texts)], "file string, line_no bigint, line string")


def class_lines(classes: DataFrame, with_ids: bool, file: str = "classes.txt", folders: Sequence[str] = ("",)) -> DataFrame:
    """``classes.txt``: one name per line, or ``id name``; one file in each of ``folders`` (the splits in use of a classification set)."""
    text = F.concat_ws(" ", F.col("id").cast("string"), "name") if with_ids else F.col("name")
    files = F.explode(F.array(*[F.lit(f"{f}/{file}" if f else file) for f in folders]))
    return classes.withColumn("_file", files).select(F.col("_file").alias("file"), F.col("id").cast("long").alias("line_no"), text.alias("line"))


def _quoted(c: str) -> Column:
    escaped = F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def mapping_lines(classes: DataFrame, rows: DataFrame, file: str = "label_mapping.py", split: str | None = None) -> DataFrame:
    """The label mapping document (two literal dicts) from the class table and ``labels.mapping_rows``.

    With ``split``, a column of the rows, there is one document ``<split>/<file>`` per split. Files are one per line, so a label with very
    many files needs no long line and no gathering.
    """
    spark = rows.sparkSession
    path = F.concat_ws("/", F.col(split), F.lit(file)) if split else F.lit(file)
    docs = F.broadcast(rows.select(path.alias("_doc")).distinct() if split else local_rows(spark, [(file,)], "_doc string"))  # a row per split
    rows = rows.withColumn("_doc", path)
    classes = classes.crossJoin(docs)
    put = lambda df, at, text: df.select(F.col("_doc").alias("file"), at.alias("line_no"), text.alias("line"))

    def fixed(section: int, texts: list[str]) -> DataFrame:
        lines = fixed_lines(spark, file, texts).select(F.col("line").alias("_l"), "line_no").crossJoin(docs)
        return put(lines, _place(section, place=F.col("line_no")), F.col("_l"))

    ident = F.col("id").cast("string")
    # One block of line numbers per label: opening line, files, closing line.
    parts = [
        fixed(0, ["# Label mapping", "", "label_names = {"]),
        put(classes, _place(1, F.col("id")), F.concat(F.lit("    "), ident, F.lit(": "), _quoted("name"), F.lit(","))),
        fixed(2, ["}", "", "label_to_images = {"]),
        put(classes, _place(4, F.col("id")), F.concat(F.lit("    "), ident, F.lit(": ["))),
        put(rows.withColumnRenamed("label_id", "id").withColumn("_f", F.col("file")), _place(4, F.col("id"), F.col("position")),
            F.concat(F.lit("        "), _quoted("_f"), F.lit(","))),
        put(classes, _place(4, F.col("id"), F.lit(IDENT - 1)), F.lit("    ],")),
        fixed(6, ["}"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def data_yaml(names: Sequence[str], ratios: Sequence[float] | None, style: str = "path") -> list[str]:
    """Lines of ``data.yaml`` for a detection set; empty without class names.

    ``path`` style: a path line, val and test only when used, no class count. ``count`` style: class count, no path,
    val falls back to the training images. The names are a user's class list.
    """
    if not names:
        return []
    used = [r > 0 for r in ratios] if ratios else []
    lines = []
    if style == "path":
        lines += ["path: .", "train: images/train"]
        lines += ["val: images/valid"] if used and used[1] else []
        lines += ["test: images/test"] if used and used[2] else []
    elif ratios:
        lines += ["train: images/train", "val: images/valid" if used[1] else "val: images/train"]
        lines += ["test: images/test"] if used[2] else []
    else:
        lines += ["train: images", "val: images"]
    if style == "count":
        lines.append(f"nc: {len(names)}")
    return [*lines, "names:", *[f"  {i}: {json.dumps(n)}" for i, n in enumerate(names)]]


def coco_lines(images: DataFrame, annotations: DataFrame, classes: DataFrame, info: str = "dataset", splits: Sequence[str] = ()) -> DataFrame:
    """One COCO document per split, ``annotations/instances_<split>.json``, as ordered lines.

    Every split that has images gets a document, whatever its name (an unsplit set may be called "all"), and so does every one of ``splits``,
    the ones in use, even without images. Categories are lines of the document as well, one per class.
    """
    file = F.concat(F.lit("annotations/instances_"), F.col("split"), F.lit(".json"))
    counts = images.groupBy("split").agg(F.count(F.lit(1)).alias("images"))  # one row per split
    counts = counts.join(annotations.groupBy("split").agg(F.count(F.lit(1)).alias("annotations")), "split", "left")
    if splits:
        counts = counts.join(local_rows(images.sparkSession, [(s,) for s in splits], "split string"), "split", "full")
    counts = counts.select("split", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("annotations", F.lit(0)).alias("annotations"))

    def fixed(section: int, text: str) -> DataFrame:
        return counts.select(file.alias("file"), _place(section).alias("line_no"), F.lit(text).alias("line"))

    def listed(df: DataFrame, section: int, of: str, body: Column) -> DataFrame:
        met = lookup(df, counts.withColumnRenamed(of, "_of").select("split", "_of"), ["split"], ["_of"])
        comma = F.when(F.col("id") < F.col("_of"), ",").otherwise("")
        return met.select(file.alias("file"), _place(section, F.col("id")).alias("line_no"), F.concat(F.to_json(body), comma).alias("line"))

    last = classes.agg(F.max("id")).first()[0]
    kind = F.to_json(F.struct((F.col("id") + 1).alias("id"), "name", F.lit("none").alias("supercategory")))
    per_split = classes.select("id", "name").crossJoin(F.broadcast(counts.select("split")))  # the few splits are sent
    categories = per_split.select(file.alias("file"), _place(5, F.col("id")).alias("line_no"), F.concat(kind, F.when(F.col("id") < F.lit(last), ",").otherwise("")).alias("line"))
    return (
        fixed(0, json.dumps({"info": {"description": info}})[:-1] + ', "images": [')
        .unionByName(listed(images, 1, "images", F.struct("id", "file_name", "width", "height")))
        .unionByName(fixed(2, '], "annotations": ['))
        .unionByName(listed(annotations, 3, "annotations", F.struct("id", "image_id", "category_id", "bbox", "area", "iscrowd")))
        .unionByName(fixed(4, '], "categories": ['))
        .unionByName(categories)
        .unionByName(fixed(6, "]}"))
    )
