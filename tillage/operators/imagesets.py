"""Diagnostics of image sets: state, colour mode, geometry, health and the reports built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import pinned
from ..plans.quantiles import quantiles
from ..plans.rows import with_row_id

# State limits, health penalties and labels.
BLANK_CONTRAST = 1.0
BLUR_LIMIT = 100.0
STATES = ("Sharp", "Blurry", "Very Blurry", "Blank")
MODES = ("RGB", "Grayscale", "RGBA")
PENALTIES = {"corrupted": 1.0, "duplicates": 0.6, "blurry": 0.25, "very_blurry": 0.5, "blank": 0.5, "mixed_colors": 10.0}
HEALTH_LABELS = ((90, "Excellent"), (75, "Good"), (50, "Fair"))
TOP_RESOLUTIONS = 5


def state(contrast: Column, blur: Column) -> Column:
    return (
        F.when(contrast < BLANK_CONTRAST, STATES[3])
        .when(blur < F.lit(BLUR_LIMIT) / 3, STATES[2])
        .when(blur < BLUR_LIMIT, STATES[1])
        .when(blur.isNotNull(), STATES[0])
    )


def color_mode(by: str = "channels") -> Column:
    """Colour mode from the number of channels, or from the pixel values."""
    if by == "pixels":
        mode = F.when(F.col("has_alpha"), "RGBA").when(F.col("all_grey"), "Grayscale").otherwise("RGB")
    else:
        mode = F.when(F.col("n_channels") == 1, "Grayscale").when(F.col("n_channels") == 4, "RGBA").otherwise("RGB")
    return F.when(~F.col("corrupted"), mode)


def describe(df: DataFrame, by: str = "channels") -> DataFrame:
    """Add state, colour mode and geometry to measured images."""
    w, h = F.col("width"), F.col("height")
    return df.select(
        "*",
        F.when(~F.col("corrupted"), state(F.col("contrast"), F.col("blur_score"))).alias("state"),
        color_mode(by).alias("color_mode"),
        F.when(~F.col("corrupted"), F.concat_ws("x", w.cast("string"), h.cast("string"))).alias("resolution"),
        F.round(w.cast("double") * h / 1e6, 3).alias("megapixels"),
        F.round(w.cast("double") / h, 2).alias("aspect_ratio"),
        F.round(F.col("size").cast("double") / 1024, 2).alias("file_size_kb"),
    )


def image_rows(df: DataFrame) -> DataFrame:
    """One row per image with every metric (for the table export). ``index`` counts from 1 in the order of the path."""
    kind = F.upper(F.substr("ext", F.lit(2)))
    numbered = with_row_id(df.withColumn("format", F.when(kind == "JPG", "JPEG").when(kind == "TIF", "TIFF").otherwise(kind)), ["path"], "_number")
    return numbered.select(
        (F.col("_number") + 1).alias("index"), "path", "name", "ext", "format", "file_size_kb", "corrupted", "error", "width", "height", "resolution", "megapixels", "aspect_ratio",
        "color_mode", F.round("brightness", 1).alias("brightness"), F.round("blur_score", 1).alias("blur_score"), "state",
        "dup_of", "near_of",
    )


def one_line(df: DataFrame) -> DataFrame:
    """Before / after text of an image: size, colour mode and brightness."""
    text = F.format_string("%s, %s, brightness %.0f", F.col("resolution"), F.col("color_mode"), F.bround(F.round("brightness", 9), 0))
    return df.withColumn("summary", F.when(~F.col("corrupted"), text))


def tallies(df: DataFrame) -> DataFrame:
    """One row with every count the reports need; needs dup_of and near_of as they hold now."""
    good = ~F.col("corrupted")
    out = [
        F.count(F.lit(1)).alias("files"),
        F.count_if(good).alias("readable"),
        F.count_if(~good).alias("corrupted"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if(good & F.col("dup_of").isNotNull()).alias("duplicates"),
        F.count_if(good & F.col("near_of").isNotNull() & F.col("dup_of").isNull()).alias("similar"),
    ]
    out += [F.count_if(good & (F.col("color_mode") == m)).alias(m.lower()) for m in MODES]
    out += [F.count_if(good & (F.col("state") == s)).alias(s.lower().replace(" ", "_")) for s in STATES]
    return df.agg(*out)


def set_summary(df: DataFrame) -> DataFrame:
    """Files, readable, corrupted, share of corrupted and total size in MB."""
    return df.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~F.col("corrupted")).alias("readable"),
        F.count_if(F.col("corrupted")).alias("corrupted"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"),
    ).select(
        "files", "readable", "corrupted",
        F.round(F.coalesce(F.try_divide(F.col("corrupted") * 100.0, F.col("files")), F.lit(0.0)), 2).alias("corrupted_pct"),
        F.round(F.col("b") / 1048576, 2).alias("total_mb"),
    )


def color_blur_tallies(df: DataFrame) -> DataFrame:
    """Tally of colour modes and states, and the number of unique readable images."""
    t = tallies(df)
    return t.select("rgb", "grayscale", "rgba", "sharp", "blurry", "very_blurry", "blank", (F.col("readable") - F.col("duplicates")).alias("unique_images"))


def penalties(t: DataFrame) -> DataFrame:
    """Adds one ``pen_*`` column per health penalty to the tallies."""
    share = lambda part, of: F.coalesce(F.try_divide(F.col(part) * 100.0, F.col(of)), F.lit(0.0))
    largest = F.greatest(*[F.col(m.lower()) for m in MODES])
    mixed = F.coalesce(1 - F.try_divide(largest.cast("double"), F.col("readable")), F.lit(0.0))
    pens = {
        "corrupted": share("corrupted", "files") * PENALTIES["corrupted"],
        "duplicates": share("duplicates", "readable") * PENALTIES["duplicates"],
        "blurry": share("blurry", "readable") * PENALTIES["blurry"],
        "very_blurry": share("very_blurry", "readable") * PENALTIES["very_blurry"],
        "blank": share("blank", "readable") * PENALTIES["blank"],
        "mixed_colors": mixed * PENALTIES["mixed_colors"],
    }
    return t.select("*", *[p.alias(f"pen_{k}") for k, p in pens.items()])


def set_health(df: DataFrame) -> DataFrame:
    """Health score 0..100 of an image set with its label and penalties."""
    p = penalties(tallies(df))
    total = sum((F.col(f"pen_{k}") for k in PENALTIES), F.lit(0.0))
    score = F.when(F.col("files") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 100 - total))
    label = F.when(F.col("files") == 0, "No images")
    for limit, text in HEALTH_LABELS:
        label = label.when(F.col("raw") >= limit, text)
    return p.withColumn("raw", score).select(
        F.round("raw", 1).alias("health"), label.otherwise("Poor").alias("label"), *[f"pen_{k}" for k in PENALTIES]
    )


def biggest_issue(df: DataFrame) -> DataFrame:
    """The penalty that costs most, if any costs something."""
    p = penalties(tallies(df))
    entries = F.array(*[F.struct(F.lit(k).alias("issue"), F.col(f"pen_{k}").alias("penalty")) for k in PENALTIES])
    worst = p.select(F.explode(entries).alias("_e")).select("_e.*").filter(F.col("penalty") > 0)
    return worst.agg(F.max_by("issue", "penalty").alias("issue"), F.max("penalty").alias("penalty"))


DETAILS = ("width", "height", "megapixels", "file_size_kb", "brightness", "blur_score")


def detail_stats(df: DataFrame) -> DataFrame:
    """Min, max, mean and median of every detail over readable images, 2 digits; 0 for an empty set."""
    good = df.filter(~F.col("corrupted")).select(
        F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"),
        (F.col("width").cast("double") * F.col("height") / 1e6).alias("megapixels"),
        (F.col("size").cast("double") / 1024).alias("file_size_kb"), "brightness", "blur_score",
    )
    aggs = [f(c).alias(f"{n}_{c}") for c in DETAILS for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    wide, _ = pinned(good.agg(F.count(F.lit(1)).alias("n"), *aggs))
    two = lambda c: F.coalesce(F.round(c, 2), F.lit(0.0))
    cells = F.array(*[
        F.struct(F.lit(c).alias("detail"), *[two(F.col(f"{n}_{c}")).alias(n) for n in ("min", "max", "mean")]) for c in DETAILS
    ])
    rows = wide.select(F.explode(cells).alias("_d")).select("_d.*")
    med = quantiles(good, list(DETAILS), (0.5,), rows=wide.first()["n"]).select(F.col("column").alias("detail"), F.col("quantile").alias("_q"))
    return rows.join(med, "detail", "left").withColumn("median", two(F.col("_q"))).drop("_q")


def tally(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Readable images per value (unknown when empty), most first; ``top`` keeps the first of that report."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
    out = df.filter(~F.col("corrupted")).groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return out.limit(top) if top else out


def issue_counts(df: DataFrame) -> DataFrame:
    """Counts behind the issue list and the badges."""
    t = tallies(df)
    return t.select("corrupted", "duplicates", "similar", (F.col("blurry") + F.col("very_blurry")).alias("blurry"), "blank")


def with_issue(df: DataFrame, issue: str) -> DataFrame:
    """The images of one issue: corrupted, duplicates, similar, blurry or blank."""
    conditions = {
        "corrupted": F.col("corrupted"),
        "duplicates": F.col("dup_of").isNotNull(),
        "similar": F.col("near_of").isNotNull(),
        "blurry": F.col("state").isin("Blurry", "Very Blurry"),
        "blank": F.col("state") == "Blank",
    }
    return df.filter(conditions[issue])


def search_path(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.lower("path").contains(text.lower()))


def decoded_size(df: DataFrame) -> DataFrame:
    """Bytes of all decoded pixels and the number of edited images."""
    edited = F.col("changed") if "changed" in df.columns else F.lit(False)
    size = F.col("height").cast("long") * F.col("width") * F.col("n_channels")
    return df.agg(F.coalesce(F.sum(F.when(~F.col("corrupted"), size)), F.lit(0)).alias("decoded_bytes"), F.count_if(edited).alias("edited"))


def remove(df: DataFrame, corrupted: bool = False, copies: str | DataFrame = "none", similar: bool = False) -> DataFrame:
    """Remove corrupted images, copies (all, none, or a table of chosen paths) and similar ones."""
    out = df
    if corrupted:
        out = out.filter(~F.col("corrupted"))
    if isinstance(copies, DataFrame):
        out = out.join(copies.select("path"), "path", "left_anti")
    elif copies == "all":
        out = out.filter(F.col("dup_of").isNull())
    if similar:
        out = out.filter(F.col("near_of").isNull())
    return out


def remove_states(df: DataFrame, states: list[str]) -> DataFrame:
    """Delete images in the given states; unreadable ones (no state) stay."""
    return df.filter(~F.coalesce(F.col("state").isin(states), F.lit(False)))


# File types that mean the same format.
SAME_FORMAT = {".jpeg": ".jpg", ".tif": ".tiff"}
FORMATS = (".jpg", ".png", ".bmp", ".webp", ".tiff")


def format_plan(df: DataFrame, new_ext: str) -> DataFrame:
    """Add ``new_ext`` and ``converted``. Unreadable images and those already in the format are left alone.

    An edited GIF that is not converted is saved as PNG.
    """
    if new_ext not in FORMATS:
        raise ValueError(f"unknown format {new_ext}")
    same = F.col("ext")
    for a, b in SAME_FORMAT.items():
        same = F.when(F.col("ext") == a, b).otherwise(same)
    edited = F.col("changed") if "changed" in df.columns else F.lit(False)
    converted = ~F.col("corrupted") & (same != F.lit(new_ext))
    target = F.when(converted, F.lit(new_ext)).when(edited & (F.col("ext") == ".gif"), ".png").otherwise(F.col("ext"))
    return df.withColumn("new_ext", target).withColumn("converted", converted)
