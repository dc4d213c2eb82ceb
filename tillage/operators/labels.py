"""Labels, boxes and dataset layouts: tables of classes, image labels and boxes instead of nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import pinned, settle
from ..plans.lookup import lookup
from ..plans.rows import number_within, with_row_id
from . import split as splits
from .naming import unique_names

# Characters that a class name must not contain, and the names of the layouts.
FORBIDDEN_IN_NAMES = r'[\\/:*?"<>|]'
LAYOUTS = {1: "folders", 2: "classification", 3: "detection"}
MAPPING_FILE = "label_mapping.py"
MIN_BOX_SIDE = 4.0


# ------------------------------------------------------------------ paths


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def ext_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folders_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def dataset_root(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``root`` (the longest common folder) and ``rel`` (each file's folder below it).

    The common prefix of all folder lists is that of the smallest and the largest list: one small aggregate.
    """
    dirs = folders_of(F.col(path))
    ends = df.agg(F.min(dirs).alias("lo"), F.max(dirs).alias("hi")).first()
    lo, hi = ends["lo"] or [], ends["hi"] or []
    depth = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
    rel = F.array_join(F.slice(dirs, F.lit(depth + 1), F.greatest(F.size(dirs) - depth, F.lit(0))), "/")
    return df.withColumn("root", F.lit("/".join(lo[:depth]))).withColumn("rel", rel)


# ------------------------------------------------------------------ classes and labels


def check_classes(df: DataFrame, name: str = "name") -> DataFrame:
    """Add the trimmed name as ``clean`` and what is wrong with it as ``problem`` (null when usable)."""
    cleaned = df.withColumn("clean", F.trim(name)).withColumn("_low", F.lower("clean"))
    twice = cleaned.groupBy("_low").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).withColumn("_twice", F.lit(True))
    found = lookup(cleaned, twice, ["_low"], ["_twice"], weight="_n")
    problem = (
        F.when(F.coalesce(F.col("clean"), F.lit("")) == "", "empty")
        .when(F.col("clean").rlike(FORBIDDEN_IN_NAMES), "forbidden character")
        .when(F.col("_twice"), "not unique")
    )
    return found.withColumn("problem", problem).drop("_low", "_twice")


def class_table(df: DataFrame, name: str, order_by: Sequence[str]) -> DataFrame:
    """Class ids 0..k-1 in the given order: ``id``, ``name``. Unusable names are an error."""
    checked = check_classes(df, name)
    bad = checked.filter(F.col("problem").isNotNull()).take(5)
    if bad:
        raise ValueError(f"unusable class names: {[(r[name], r['problem']) for r in bad]}")
    return with_row_id(checked, order_by, "id").select("id", F.col("clean").alias("name"))


def label_images(images: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Images with a label; unlabelled and unreadable ones are left out (see ``label_report``)."""
    return images.filter(~F.col("corrupted")).join(labels.select(key, label).filter(F.col(label).isNotNull()), key)


def label_report(images: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row: labelled, unlabelled and unreadable images."""
    met = images.join(labels.select(key, label), key, "left")
    good = ~F.col("corrupted")
    return met.agg(
        F.count_if(good & F.col(label).isNotNull()).alias("labelled"),
        F.count_if(good & F.col(label).isNull()).alias("unlabelled"),
        F.count_if(~good).alias("unreadable"),
    )


def labels_from_folders(df: DataFrame, rel: str = "rel") -> tuple[DataFrame, DataFrame]:
    """Labels from the first folder below the root: (labelled files, classes). Files outside folders are left out."""
    named = df.withColumn("label", F.split_part(F.col(rel), F.lit("/"), F.lit(1))).filter(F.col("label") != "")
    counts = named.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts, _ = pinned(counts)
    if counts.limit(2).count() < 2:
        raise ValueError("at least two sub-folders are needed")
    classes = with_row_id(counts, ["label"], "label_id").select("label", "label_id", "n")
    return lookup(named, classes, ["label"], ["label_id"], weight="n"), classes


def detect_layout(df: DataFrame, path: str = "path") -> DataFrame:
    """Layout of a listing (paths below the set): a mapping file gives 2, images and labels folders 3, else 1."""
    p = F.col(path)
    flags = df.agg(
        F.coalesce(F.bool_or(p == MAPPING_FILE), F.lit(False)).alias("m"),
        F.coalesce(F.bool_or(p.startswith("images/")), F.lit(False)).alias("i"),
        F.coalesce(F.bool_or(p.startswith("labels/")), F.lit(False)).alias("l"),
    )
    layout = F.when(F.col("m"), 2).when(F.col("i") & F.col("l"), 3).otherwise(1)
    return flags.select(layout.alias("layout"))


# ------------------------------------------------------------------ splits of labelled sets


def split_folders(df: DataFrame, ratios: Sequence[float] = splits.IMAGE_RATIOS, seed: int = 42, path: str = "path") -> DataFrame:
    """Folder set: the parent folder is the label, each label is split alone; adds label, split and target path."""
    named = df.withColumn("label", F.element_at(F.split(path, "/"), -2))
    out = splits.split(named, [path], ratios, seed, by="label")
    return out.withColumn("target", F.concat_ws("/", "split", "label", name_of(F.col(path))))


def split_mapping(mapping: DataFrame, listing: DataFrame, ratios: Sequence[float] = splits.IMAGE_RATIOS, seed: int = 42) -> DataFrame:
    """Classification set: mapping rows (label, file) whose file exists, each label split alone."""
    present = mapping.join(listing.select("file"), "file", "left_semi")
    return splits.split(present, ["file"], ratios, seed, by="label")


def missing_files(mapping: DataFrame, listing: DataFrame) -> DataFrame:
    """Mapping rows whose file does not exist, counted per label."""
    return mapping.join(listing.select("file"), "file", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("missing"))


def split_detection(images: DataFrame, boxes: DataFrame, ratios: Sequence[float] = splits.IMAGE_RATIOS, seed: int = 42, stem: str = "stem") -> DataFrame:
    """Detection set: images split together; ``boxes`` (per stem) move with them, none means background."""
    counts = boxes.groupBy(stem).agg(F.count(F.lit(1)).alias("boxes"))
    out = splits.split(images, [stem], ratios, seed)
    return out.join(counts, stem, "left").withColumn("boxes", F.coalesce("boxes", F.lit(0).cast("long")))


def counts_by_label(df: DataFrame, ratios: Sequence[float] = splits.IMAGE_RATIOS, label: str = "label") -> DataFrame:
    """One row per label with its number of images in each used split."""
    used = [s for s, r in zip(splits.SPLITS, ratios) if r > 0]
    return df.groupBy(label).agg(*[F.count_if(F.col("split") == s).alias(s) for s in used])


# ------------------------------------------------------------------ boxes


def normalise_boxes(boxes: DataFrame, min_side: float = MIN_BOX_SIDE, scale: float = 1.0) -> DataFrame:
    """Order the corners, clip them to the image and keep boxes of at least ``min_side / scale`` real pixels a side."""
    side = F.lit(min_side / scale)

    def inside(v: Column, top: str) -> Column:
        return F.least(F.col(top).cast("double"), F.greatest(F.lit(0.0), v))

    x1, x2 = inside(F.least("x1", "x2"), "width"), inside(F.greatest("x1", "x2"), "width")
    y1, y2 = inside(F.least("y1", "y2"), "height"), inside(F.greatest("y1", "y2"), "height")
    fixed = {"x1": x1, "y1": y1, "x2": x2, "y2": y2}
    out = boxes.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in boxes.columns])
    return out.filter((F.col("x2") - F.col("x1") >= side) & (F.col("y2") - F.col("y1") >= side))


def stale_labels(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Labels drawn on an image that is gone or has another size now."""
    return labels.join(images.select("path", "width", "height"), ["path", "width", "height"], "left_anti")


def yolo_lines(images: DataFrame, boxes: DataFrame, split: str | None = None) -> DataFrame:
    """Lines of the YOLO label files: ``file``, ``line_no`` (from 1), ``line``; an image without boxes has one null line.

    ``boxes`` has path, box_no, class_id and the corners; ``images`` path, stem, width and height. With ``split``, a column of the
    images, the files are ``labels/<split>/<stem>.txt``, else ``labels/<stem>.txt``.
    """
    place = F.concat_ws("/", F.lit("labels"), *([F.col(split)] if split else []), F.concat("stem", F.lit(".txt")))
    met = images.select("path", "stem", "width", "height", place.alias("_file")).join(boxes.select("path", "box_no", "class_id", "x1", "y1", "x2", "y2"), "path", "left")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    numbers = [
        (F.col("x1") + F.col("x2")) / 2 / w, (F.col("y1") + F.col("y2")) / 2 / h,
        (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h,
    ]
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", *numbers)
    return met.select(
        F.col("_file").alias("file"), F.col("box_no").alias("line_no"),
        F.when(F.col("box_no").isNotNull(), line).alias("line"),
    )


def coco_images(images: DataFrame) -> DataFrame:
    """COCO image rows: ids from 1 in each split, in path order."""
    return number_within(images.select("split", "path", "width", "height"), ["split"], ["path"], "id").select(
        "split", "id", "path", name_of(F.col("path")).alias("file_name"), "width", "height"
    )


def coco_annotations(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """COCO annotation rows: running ids per split in image and box order, category ids from 1, bbox as x, y, w, h."""
    met = boxes.join(images.select("split", F.col("id").alias("image_id"), "path"), "path")
    numbered = number_within(met, ["split"], ["image_id", "box_no"], "id")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    two = lambda v: F.round(v, 2)
    return numbered.select(
        "split", "id", "image_id", (F.col("class_id") + 1).alias("category_id"),
        F.array(two(F.col("x1")), two(F.col("y1")), two(w), two(h)).alias("bbox"), two(w * h).alias("area"), F.lit(0).alias("iscrowd"),
    )


def mapping_rows(labelled: DataFrame, label_id: str = "label_id", file: str = "file") -> DataFrame:
    """Rows of a label mapping: label id, position (from 1, in file order) and file."""
    return number_within(labelled.select(label_id, file), [label_id], [file], "position")
