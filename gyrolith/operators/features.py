"""Feature tables: row filters, standardisation, texture and region features of images stored as pixel rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_rows(points: DataFrame, keep_nan: bool = False) -> DataFrame:
    """Points with a component that is not 0, and none that is NaN or null (with `keep_nan`, NaN counts as not 0)."""
    some = F.exists("v", lambda x: x != 0)
    return points.where(some if keep_nan else some & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def z_scores(points: DataFrame, centre_constant: bool = True) -> DataFrame:
    """(id, pos, z): components less their column's mean, over its population deviation.

    A column without deviation is centred only, or left as it is with `centre_constant` false (deviation up to 1e-10).
    """
    rows = points.select("id", F.posexplode("v").alias("pos", "x"))
    stats = rows.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))  # a row for each column
    rows = rows.join(F.broadcast(stats), "pos")
    if centre_constant:
        z = (F.col("x") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    else:
        z = F.when(F.col("sd") > 1e-10, (F.col("x") - F.col("mean")) / F.when(F.col("sd") > 1e-10, F.col("sd")).otherwise(1.0)).otherwise(F.col("x"))
    return rows.select("id", "pos", z.alias("z"))


def masked_mean(pixels: DataFrame, mask) -> DataFrame:
    """(image, mean_value): mean over the pixels where `mask` holds, 0 for an empty mask."""
    return pixels.groupBy("image").agg(F.coalesce(F.avg(F.when(mask, F.col("v"))), F.lit(0.0)).alias("mean_value"))


def texture_contrast(pixels: DataFrame, mask, levels: int = 32, least: int = 10) -> DataFrame:
    """(image, contrast): mean squared difference of grey levels between horizontal neighbours in the mask's bounding box.

    Values are scaled to 0 .. levels - 1 between the mask's minimum and maximum; pixels of the box outside the mask
    are level 0 and count. Masks of fewer than `least` pixels or without range give 0.
    """
    rows = pixels.withColumn("__in", mask)
    inside = lambda c: F.when(F.col("__in"), F.col(c))
    box = rows.groupBy("image").agg(
        F.min(inside("y")).alias("y1"), F.max(inside("y")).alias("y2"), F.min(inside("x")).alias("x1"), F.max(inside("x")).alias("x2"),
        F.min(inside("v")).alias("low"), F.max(inside("v")).alias("high"), F.count(inside("v")).alias("size"),
    )
    ok = (F.col("size") >= least) & (F.col("high") > F.col("low"))
    level = F.when(F.col("__in"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * (levels - 1))).otherwise(0)
    cut = rows.join(box.where(ok).hint("merge"), "image").where("y BETWEEN y1 AND y2 AND x BETWEEN x1 AND x2").select("image", "y", "x", level.alias("q"))
    step = F.lead("q").over(Window.partitionBy("image", "y").orderBy("x")) - F.col("q")
    found = cut.withColumn("step", step).groupBy("image").agg(F.avg(F.col("step") * F.col("step")).alias("contrast"))
    return box.select("image").join(found, "image", "left").select("image", F.coalesce("contrast", F.lit(0.0)).alias("contrast"))


def region_features(pixels: DataFrame, region: str = "label") -> DataFrame:
    """(image, region, mean_v, max_v, mean_top, mean_contrast, area, pixels) for pixel rows with v, top and contrast; area is the share of all regions' pixels."""
    found = pixels.groupBy("image", region).agg(F.avg("v").alias("mean_v"), F.max("v").alias("max_v"), F.avg("top").alias("mean_top"), F.avg("contrast").alias("mean_contrast"), F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("image"))
    return found.select("image", region, "mean_v", "max_v", "mean_top", "mean_contrast", (F.col("n") / total).alias("area"), F.col("n").alias("pixels"))


def outlier_clusters(regions: DataFrame, bright: float = 2.0, spiky: float = 1.5, least_max: float = 150.0) -> DataFrame:
    """(image, cluster) whose mean brightness or top-hat stands out among the image's regions, with bright peaks and small areas.

    Regions are rows (image, cluster, mean_v, max_v, mean_top, area); deviations are those of the population of regions.
    """
    of_image = regions.groupBy("image").agg(
        F.avg("mean_v").alias("m1"), F.stddev_pop("mean_v").alias("s1"), F.avg("mean_top").alias("m2"), F.stddev_pop("mean_top").alias("s2"), F.expr("percentile(area, 0.5)").alias("mid"))
    of_cluster = regions.groupBy("image", "cluster").agg(F.avg("mean_v").alias("v"), F.avg("mean_top").alias("t"), F.avg("max_v").alias("peak"), F.avg("area").alias("a"))
    stands_out = (F.col("v") > F.col("m1") + bright * F.col("s1")) | (F.col("t") > F.col("m2") + spiky * F.col("s2"))
    return of_cluster.join(of_image, "image").where(stands_out & (F.col("peak") > least_max) & (F.col("a") < F.col("mid"))).select("image", "cluster")
