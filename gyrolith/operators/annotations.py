"""Truth masks from annotated pictures: pixel rows (image, y, x, b, g, r) with 8-bit channels, dense grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrolith.functions.blocks import codes, over_images
from gyrolith.operators import components, raster
from gyrolith.sources.tables import written


def grey_of(b: Column, g: Column, r: Column) -> Column:
    """Luma of 8-bit channels, rounded half up."""
    return F.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).cast("int")


def mask_like(pixels: DataFrame) -> DataFrame:
    """(image, is_mask): pictures of at most two grey levels, or with some below 10 and some above 245."""
    grey = pixels.select("image", grey_of(F.col("b"), F.col("g"), F.col("r")).alias("v"))
    # A minimum and a maximum tell whether a third level lies between them.
    ends = grey.groupBy("image").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    between = grey.join(ends, "image").groupBy("image", "low", "high").agg(F.max((F.col("v") > F.col("low")) & (F.col("v") < F.col("high"))).alias("more"))
    return between.select("image", (~F.col("more") | ((F.col("low") < 10) & (F.col("high") > 245))).alias("is_mask"))


def edges_of(grey: np.ndarray, low: int = 50, high: int = 150) -> np.ndarray:
    """Edges of one picture: ridges of the Sobel gradient above `low` that are connected with one above `high`."""
    p = np.pad(grey.astype(np.int64), 1, mode="edge")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    size = np.abs(gx) + np.abs(gy)
    m = np.pad(size, 1)
    at = lambda dy, dx: m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
    flat = np.abs(gy) < np.tan(np.pi / 8) * np.abs(gx)
    steep = np.abs(gy) > np.tan(3 * np.pi / 8) * np.abs(gx)
    rising = (gx < 0) != (gy < 0)
    ridge = np.where(flat, (size > at(0, -1)) & (size >= at(0, 1)), np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)),
        np.where(rising, (size > at(-1, 1)) & (size > at(1, -1)), (size > at(-1, -1)) & (size > at(1, 1)))))
    y, x = np.nonzero(ridge & (size > low))
    out = np.zeros(grey.shape, bool)
    if len(y):
        label = components.numbered(y, x)
        keep = np.isin(label, label[size[y, x] > high])
        out[y[keep], x[keep]] = True
    return out


def edge_mask(grey: DataFrame, low: int = 50, high: int = 150) -> DataFrame:
    """(image, y, x, on) of dense pixel rows (image, y, x, v) with whole grey values."""
    kind = grey.schema["image"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(of=codes(pdf["image"])).sort_values(["of", "y", "x"], kind="stable")
        on = [edges_of(one["v"].to_numpy().reshape(int(one["y"].max()) + 1, -1), low, high).ravel() for _, one in pdf.groupby("of", sort=True)]
        return pd.DataFrame({"image": pdf["image"], "y": pdf["y"], "x": pdf["x"], "on": np.concatenate(on)})

    return over_images(grey.select("image", "y", "x", "v"), run, f"image {kind}, y int, x int, on boolean")


def annotation_mask(pixels: DataFrame, saturation: int = 30, least: float = 0.01) -> DataFrame:
    """(image, y, x, on): grey levels above 127 of pictures that are masks; of others, coloured or red pixels.

    Where these are less than a hundredth of a picture, its edges are taken instead.
    """
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    _, s, _ = raster.hsv(b, g, r)
    coloured = (s > saturation) | raster.red(b, g, r, second=(170, 180))
    grey = grey_of(b, g, r)
    rows = pixels.join(mask_like(pixels), "image")
    rows = written(rows.select("image", "y", "x", grey.alias("v"), "is_mask", F.when(F.col("is_mask"), grey > 127).otherwise(coloured).alias("on")))
    few = rows.where("NOT is_mask").groupBy("image").agg((F.count_if("on") < least * F.count("*")).alias("few")).where("few").select("image")
    few = written(few)
    drawn = edge_mask(rows.join(few, "image", "left_semi"))
    return rows.join(few, "image", "left_anti").select("image", "y", "x", "on").unionByName(drawn)


def annotated_regions(pixels: DataFrame, sizes: DataFrame, size: int = 5) -> DataFrame:
    """(image, y, x) of regions drawn with a red outline: outlines closed by an ellipse, with everything they enclose.

    Closing only adds pixels and filling is monotone, so regions of outlines that were closed already are among them.
    """
    red = raster.red(F.col("b"), F.col("g"), F.col("r"))
    grid = raster.closed_by(pixels.select("image", "y", "x", F.when(red, 1).otherwise(0).alias("v")), size)
    return components.filled(written(grid.where("v = 1").select("image", "y", "x")), sizes)
