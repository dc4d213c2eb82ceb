"""Running pixel kernels on image rows: columns ``height, width, n_channels, data`` (RGB(A) or grey, row by row).

Pixels travel to Python in Arrow batches, only for the rows that need it. Inside a batch images of equal shape
are computed together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pixels

RASTER = ("height", "width", "n_channels", "data")
_RASTER_TYPE = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in RASTER[:3]] + [T.StructField("data", T.BinaryType())]
)
_METRIC_TYPE = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("brightness", "contrast", "blur_score")]
    + [T.StructField(c, T.BooleanType()) for c in ("has_alpha", "all_grey")]
    + [T.StructField("dhash", T.LongType())]
)


def _stacks(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions and pixel stack of every shape in a batch; rows without pixels are left out."""
    shapes = pd.DataFrame({"h": h, "w": w, "c": c})[data.notna().to_numpy()]
    for (hh, ww, cc), at in shapes.groupby(["h", "w", "c"]).indices.items():
        rows = shapes.index.to_numpy()[at]
        raw = np.frombuffer(b"".join(data[i] for i in rows), np.uint8)
        yield rows, raw.reshape(len(rows), int(hh), int(ww), int(cc))


@F.pandas_udf(_METRIC_TYPE)
def _measure(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.DataFrame:
    n = len(data)
    out = pd.DataFrame({
        "brightness": np.zeros(n), "contrast": np.zeros(n), "blur_score": np.zeros(n),
        "has_alpha": np.zeros(n, bool), "all_grey": np.zeros(n, bool), "dhash": np.zeros(n, np.int64),
    })
    for rows, a in _stacks(h, w, c, data):
        grey = pixels.mean_grey(a)
        out.loc[rows, "brightness"] = grey.mean(axis=(1, 2))
        out.loc[rows, "contrast"] = grey.std(axis=(1, 2))
        out.loc[rows, "blur_score"] = pixels.blur_score(grey)
        out.loc[rows, "has_alpha"] = (a[..., 3] < 255).any(axis=(1, 2)) if a.shape[-1] == 4 else False
        out.loc[rows, "all_grey"] = (a[..., :3] == a[..., :1]).all(axis=(1, 2, 3))
        out.loc[rows, "dhash"] = pixels.difference_hash(a)
    return out


def measure(df: DataFrame) -> DataFrame:
    """Add brightness, contrast, blur score, pixel colour flags and picture hash; null for unreadable images."""
    m = _measure(*[F.col(c) for c in RASTER])
    names = ["brightness", "contrast", "blur_score", "has_alpha", "all_grey", "dhash"]
    return df.withColumn("_m", m).select(
        *df.columns, *[F.when(F.col("data").isNotNull(), F.col(f"_m.{c}")).alias(c) for c in names]
    )


def apply_raster(
    df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], skip: Column | None = None, stacked: bool = False
) -> DataFrame:
    """Replace the pixels of every readable image by ``fn(pixels)``; sets ``changed``.

    ``fn`` takes one image (height, width, channels), or with ``stacked`` a stack of equal-shaped images. Rows
    matching ``skip``, and unreadable ones, do not send their pixels to Python. A result equal in shape and
    content to its input is not a change.
    """

    @F.pandas_udf(_RASTER_TYPE)
    def run(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.DataFrame:
        hs, ws, cs, ds = [None] * len(h), [None] * len(h), [None] * len(h), [None] * len(h)
        for rows, a in _stacks(h, w, c, data):
            results = fn(a) if stacked else [fn(x) for x in a]
            for i, src, new in zip(rows, a, results):
                new = np.asarray(new)
                new = new if new.ndim == 3 else new[..., None]
                if new.shape != src.shape or not np.array_equal(new, src):
                    hs[i], ws[i], cs[i] = new.shape
                    ds[i] = np.ascontiguousarray(new, np.uint8).tobytes()
        return pd.DataFrame({
            "height": pd.array(hs, "Int32"), "width": pd.array(ws, "Int32"), "n_channels": pd.array(cs, "Int32"), "data": ds,
        })

    sent = F.col("data") if skip is None else F.when(~F.coalesce(skip, F.lit(False)), F.col("data"))
    done = df.withColumn("_r", run(F.col("height"), F.col("width"), F.col("n_channels"), sent))
    was = F.col("changed") if "changed" in df.columns else F.lit(False)
    new = {c: F.coalesce(F.col(f"_r.{c}"), F.col(c)).alias(c) for c in RASTER}
    new["changed"] = (was | F.col("_r.data").isNotNull()).alias("changed")
    columns = df.columns if "changed" in df.columns else [*df.columns, "changed"]
    return done.select(*[new.get(c, F.col(c)) for c in columns])


def to_rgb(df: DataFrame) -> DataFrame:
    return apply_raster(df, pixels.to_rgb, F.col("n_channels") == 3, stacked=True)


def to_grey(df: DataFrame) -> DataFrame:
    return apply_raster(df, pixels.to_grey, F.col("n_channels") == 1, stacked=True)


def to_bgr(df: DataFrame) -> DataFrame:
    return apply_raster(df, pixels.to_bgr, stacked=True)


def brighten(df: DataFrame, factor: float, rounding: str = "truncate") -> DataFrame:
    """Multiply the brightness; a factor of 1 changes nothing."""
    return apply_raster(df, lambda a: pixels.brighten(a, factor, rounding), F.lit(factor == 1), stacked=True)


def sharpen(df: DataFrame, state: str = "state") -> DataFrame:
    """Sharpen the blurry images; their state becomes "Sharpened", so they are not sharpened twice."""
    wanted = F.col(state).isin("Blurry", "Very Blurry")
    out = apply_raster(df, pixels.sharpen, ~wanted, stacked=True)
    return out.withColumn(state, F.when(wanted & F.col("data").isNotNull(), "Sharpened").otherwise(F.col(state)))


def resize_plan(
    df: DataFrame, how: str, a: float | None = None, b: float | None = None, rounding: str = "half_even"
) -> DataFrame:
    """New size of every image, without touching pixels: ``new_width``, ``new_height``, ``resized``.

    ``how`` is percent, width, height, exact or megapixels; a missing number changes nothing.
    """
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    if a is None or a <= 0 or (how == "exact" and (b is None or b <= 0)):
        sizes = (w, h)
    elif how == "percent":
        sizes = (w * F.lit(a / 100), h * F.lit(a / 100)) if rounding == "half_up" else (w * a / 100, h * a / 100)
    elif how == "width":
        sizes = (F.lit(float(a)), h * a / w)
    elif how == "height":
        sizes = (w * a / h, F.lit(float(a)))
    elif how == "exact":
        sizes = (F.lit(float(a)), F.lit(float(b)))
    elif how == "megapixels":
        scale = F.sqrt(F.lit(a * 1e6) / (w * h))
        sizes = (w * scale, h * scale)
    else:
        raise ValueError(f"unknown resize: {how}")
    whole = (lambda v: F.floor(v + 0.5)) if rounding == "half_up" else (lambda v: F.bround(v, 0))
    new_w, new_h = (F.greatest(F.lit(1), whole(v).cast("int")) for v in sizes)
    return df.withColumn("new_width", new_w).withColumn("new_height", new_h).withColumn(
        "resized", (F.col("new_width") != F.col("width")) | (F.col("new_height") != F.col("height"))
    )


def resize(df: DataFrame, how: str, a: float | None = None, b: float | None = None, rounding: str = "half_even") -> DataFrame:
    """Resample the images whose size changes."""
    planned = resize_plan(df, how, a, b, rounding)

    @F.pandas_udf("binary")
    def run(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series, nw: pd.Series, nh: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(h), dtype=object)
        sizes = pd.DataFrame({"w": nw, "h": nh})
        for rows, a_ in _stacks(h, w, c, data):
            for (ww, hh), at in sizes.loc[rows].groupby(["w", "h"]).indices.items():
                for i, img in zip(rows[at], pixels.resize(a_[at], int(ww), int(hh))):
                    out[i] = img.tobytes()
        return out

    sent = F.when(F.col("resized"), F.col("data"))
    done = planned.withColumn("_d", run("height", "width", "n_channels", sent, "new_width", "new_height"))
    was = F.col("changed") if "changed" in df.columns else F.lit(False)
    now = F.col("_d").isNotNull()
    new = {
        "data": F.coalesce("_d", "data").alias("data"),
        "width": F.when(now, F.col("new_width")).otherwise(F.col("width")).alias("width"),
        "height": F.when(now, F.col("new_height")).otherwise(F.col("height")).alias("height"),
        "changed": (was | now).alias("changed"),
    }
    columns = df.columns if "changed" in df.columns else [*df.columns, "changed"]
    return done.select(*[new.get(c, F.col(c)) for c in columns])


def encode(df: DataFrame, ext: str = "ext") -> DataFrame:
    """Add ``content``: the pixels as a file of the type in column ``ext`` (.bmp, .png, .tif, .tiff); null for other types."""

    @F.pandas_udf("binary")
    def run(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series, kind: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(h), dtype=object)
        for rows, a in _stacks(h, w, c, data):
            for i, img in zip(rows, a):
                encoder = pixels.ENCODERS.get(kind[i])
                out[i] = encoder(img) if encoder else None
        return out

    return df.withColumn("content", run("height", "width", "n_channels", "data", ext))
