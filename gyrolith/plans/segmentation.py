"""Bright inclusions in an organ, image by image but for all images at once.

Images are dense pixel rows (image, y, x, v, inside), with `inside` the organ's mask. Files of pixels are small for their rows, so joins
with pixels, components or regions are merges by hint: by the size of its file either side could be taken for one to broadcast. Two detectors, one by brightness and one
by clusters of regions, are united, cleaned and filtered by border, area and shape.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.operators import centre_torque, components, features, raster
from gyrolith.sources.tables import written


@dataclass(frozen=True)
class Settings:
    least_pixels: int = 100
    below: int = 30
    kernel: int = 15
    regions: int = 150
    least_regions: int = 10
    area: tuple[int, int] = (10, 2000)
    opening: int = 2
    closing: int = 3
    circularity: tuple[float, float] = (0.15, 1.0)
    solidity: float = 0.4
    clusters: centre_torque.Settings = field(default_factory=lambda: centre_torque.Settings(most_k=5))


def region_mask(pixels: DataFrame, settings: Settings) -> DataFrame:
    """(image, y, x) of regions whose cluster stands out; pixels have top and contrast. Images with too few regions give none."""
    regions = written(raster.grid_regions(pixels, F.col("inside"), settings.regions))
    table = features.region_features(regions)
    enough = table.groupBy("image").agg(F.count("*").alias("k")).where(F.col("k") >= settings.least_regions).select("image")
    table = written(table.join(enough.hint("merge"), "image"))
    points = table.select("image", "label", F.array("mean_v", "max_v", "mean_top", "mean_contrast", "area").alias("f"))
    clusters = written(centre_torque.fit_images(features.valid_rows(points.withColumnRenamed("f", "v"), keep_nan=True).withColumnRenamed("v", "f"), settings.clusters))
    chosen = features.outlier_clusters(table.join(clusters.hint("merge"), ["image", "label"]))
    labels = clusters.join(chosen.hint("merge"), ["image", "cluster"], "left_semi").select("image", "label")
    mask = regions.join(labels.hint("merge"), ["image", "label"], "left_semi").select("image", "y", "x")
    return components.by_area(written(components.components(mask)), *settings.area).select("image", "y", "x")


def intense_spots(pixels: DataFrame, least: float = 220.0, area: tuple[int, int] = (5, 3000)) -> DataFrame:
    """(image, y, x) of components, by area, of the mask's pixels at or above a value, opened by a square of three."""
    spots = F.when(F.col("inside") & (F.col("v") >= least), 1).otherwise(0)
    grid = raster.opened(pixels.select("image", "y", "x", spots.alias("v")), 1)
    return components.by_area(written(components.components(grid.where("v = 1"))), *area).select("image", "y", "x")


def cleaned(pixels: DataFrame, found: DataFrame, sizes: DataFrame, settings: Settings) -> DataFrame:
    """(image, y, x, component) of found pixels, opened and closed on their grids and filtered by border, area and shape."""
    found = found.select("image", "y", "x").distinct().withColumn("on", F.lit(1))
    grid = pixels.select("image", "y", "x").join(found.hint("merge"), ["image", "y", "x"], "left").withColumn("v", F.coalesce("on", F.lit(0)))
    grid = raster.closed_by(raster.opened_by(grid, settings.opening), settings.closing)
    kept = written(components.components(grid.where("v = 1")))
    kept = components.by_area(components.without_border(kept, sizes), *settings.area)
    return components.by_shape(written(kept), settings.circularity, settings.solidity)


def segment_by_percentiles(pixels: DataFrame, settings: Settings = Settings(), share: float = 0.95, least: float = 170.0) -> DataFrame:
    """(image, y, x) of the mask's pixels whose top-hat or value is among its highest, cleaned; without regions and clusters."""
    pixels = written(pixels.select("image", "y", "x", F.col("v").cast("double").alias("v"), "inside"))
    sizes = written(pixels.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")))
    rich = written(raster.top_hat(pixels, settings.kernel).where("inside"))
    limits = rich.groupBy("image").agg(F.expr(f"percentile(top, {share})").alias("a"), F.expr(f"percentile(v, {share})").alias("b"))
    found = written(rich.join(limits.hint("merge"), "image").where((F.col("top") >= F.col("a")) | (F.col("v") >= F.greatest("b", F.lit(least)))))
    return cleaned(pixels, found, sizes, settings).select("image", "y", "x")


def segment(pixels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(image, y, x) of the inclusions found."""
    inside = F.col("inside")
    enough = pixels.where(inside).groupBy("image").agg(F.count("*").alias("k")).where(F.col("k") >= settings.least_pixels).select("image")
    pixels = written(pixels.join(enough.hint("merge"), "image", "left_semi").select("image", "y", "x", F.col("v").cast("double").alias("v"), "inside"))
    sizes = written(pixels.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")))
    rich = written(raster.top_and_contrast(raster.crop(pixels, inside, settings.below), settings.kernel, settings.kernel // 2))
    spots = raster.bright_pixels(rich, inside).select("image", "y", "x").union(raster.spiky_pixels(rich, inside).select("image", "y", "x"))
    found = written(spots.union(region_mask(rich, settings)))
    kept = cleaned(pixels, found, sizes, settings)
    return kept.join(pixels.where(inside).select("image", "y", "x").hint("merge"), ["image", "y", "x"], "left_semi").select("image", "y", "x")
