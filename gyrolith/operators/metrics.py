"""Quality of masks against a truth, summaries, and comparison of two methods."""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyrolith.functions.blocks import codes, over_images
from gyrolith.operators.components import outer_contours

#: Pixels that distance transforms hold at once, some 100 bytes each, if an image has no more.
CELLS = 1 << 20
MASK_METRICS = ("iou", "dice", "pixel_accuracy", "precision", "recall", "specificity", "f1_score")


def ratio(a, b, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.when(b == 0, 1).otherwise(b))


def mask_metrics(rows: DataFrame, keys: list[str], found: Column, truth: Column) -> DataFrame:
    """Counts and seven metrics by key, in one aggregate. Empty unions give 1, other empty denominators 0."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n = rows.groupBy(*keys).agg(count(found & truth).alias("tp"), count(found & ~truth).alias("fp"), count(~found & truth).alias("fn"), count(~found & ~truth).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    n = n.withColumns({
        "iou": ratio(tp, tp + fp + fn, 1.0), "dice": ratio(2 * tp, 2 * tp + fp + fn, 1.0), "pixel_accuracy": ratio(tp + tn, tp + tn + fp + fn, 0.0),
        "precision": ratio(tp, tp + fp, 0.0), "recall": ratio(tp, tp + fn, 0.0), "specificity": ratio(tn, tn + fp, 0.0),
    })
    p, r = F.col("precision"), F.col("recall")
    return n.withColumn("f1_score", ratio(2 * p * r, p + r, 0.0))


def scored(metrics: DataFrame, skip_empty: bool = False) -> DataFrame:
    """The rows to score: all, or only those in which neither mask is empty."""
    return metrics.where("tp + fp > 0 AND tp + fn > 0") if skip_empty else metrics


def skip_reasons(metrics: DataFrame) -> DataFrame:
    """(reason, images): how many images are scored or skipped for which mask, in one pass."""
    reason = F.when((F.col("tp") + F.col("fn")) == 0, "empty truth").when((F.col("tp") + F.col("fp")) == 0, "empty prediction").otherwise("scored")
    return metrics.groupBy(reason.alias("reason")).agg(F.count("*").alias("images"))


def nearest_in_columns(held: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows to the nearest held pixel of the same column and image; `first` is where each row's image starts. Infinite where there is none."""
    rows = np.arange(len(held))[:, None]
    ends = np.append(np.searchsorted(first, np.unique(first)), len(held))[np.unique(first, return_inverse=True)[1] + 1] - 1
    above = np.maximum.accumulate(np.where(held, rows, -1), axis=0)
    below = np.minimum.accumulate(np.where(held, rows, len(held))[::-1], axis=0)[::-1]
    up = np.where(above >= first[:, None], rows - above, np.inf)
    down = np.where(below <= ends[:, None], below - rows, np.inf)
    return np.minimum(up, down)


def squared_distances(held: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of every pixel to the nearest held one of its image: along columns, then by the lower envelope of a row's parabolas.

    All rows move together: a parabola is added per column, those that it hides leave, and a second pass reads the envelope off.
    """
    f = nearest_in_columns(held, first) ** 2
    n, width = f.shape
    at, start = np.zeros((n, width), np.int64), np.full((n, width + 1), np.inf)  # parabolas of the envelope, and where each begins
    top, row = np.full(n, -1), np.arange(n)
    for q in range(width):
        todo = row[np.isfinite(f[:, q])]
        begin = np.full(n, -np.inf)
        rest = todo[top[todo] >= 0]
        while len(rest):
            v = at[rest, top[rest]]
            s = (f[rest, q] + q * q - f[rest, v] - v * v) / (2.0 * (q - v))
            hidden = s <= start[rest, top[rest]]
            begin[rest[~hidden]] = s[~hidden]
            rest = rest[hidden]
            top[rest] -= 1
            rest = rest[top[rest] >= 0]
        top[todo] += 1
        at[todo, top[todo]], start[todo, top[todo]] = q, begin[todo]
    out, now = np.full((n, width), np.inf), np.zeros(n, np.int64)
    some = row[top >= 0]
    for q in range(width):
        rest = some
        while len(rest):
            rest = rest[now[rest] < top[rest]]
            rest = rest[start[rest, now[rest] + 1] < q]
            now[rest] += 1
        v = at[some, now[some]]
        out[some, q] = (q - v) ** 2 + f[some, v]
    return out


def laid_out(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    """The ranges of rows of whole images whose pixels, laid below each other as wide as the widest, are at most CELLS; a larger image is one by itself."""
    by = pdf.groupby(codes(pdf["image"]))
    out, start, at, high, wide = [], 0, 0, 0, 0
    for size, h, w in zip(by.size(), by["y"].max() + 1, by["x"].max() + 1, strict=True):
        if at > start and (high + h) * max(wide, w) > CELLS:
            out.append((start, at))
            start, high, wide = at, 0, 0
        at, high, wide = at + size, high + h, max(wide, w)
    return [*out, (start, at)]


def boundary_distances(found: DataFrame, truth: DataFrame, images: DataFrame) -> DataFrame:
    """(image, hausdorff, surface): symmetric largest, and mean of both mean, distances between outer outlines; inf if a mask is empty.

    Outlines are those of `outer_contours`; a point that an outline passes twice counts twice in a mean. Distances are read
    from an exact distance transform of the other outline, so the work is linear in pixels. An image stays in one task, many images in a call.
    """
    kind = images.schema["image"].dataType.simpleString()
    sides = outer_contours(found).withColumn("side", F.lit(0)).unionByName(outer_contours(truth).withColumn("side", F.lit(1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([together(pdf.iloc[a:b]) for a, b in laid_out(pdf)], ignore_index=True)

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        of, side, visits = codes(pdf["image"]), pdf["side"].to_numpy(), pdf["visits"].to_numpy(float)
        names = pdf["image"].iloc[np.flatnonzero(np.diff(of, prepend=-1))].reset_index(drop=True)
        heights = pdf["y"].groupby(of).max().to_numpy() + 1
        first = np.concatenate([[0], np.cumsum(heights)])
        row, col = first[of] + pdf["y"].to_numpy(), pdf["x"].to_numpy()
        starts = np.repeat(first[:-1], heights)
        far, means = np.zeros(len(names)), np.zeros(len(names))
        for k in (0, 1):
            held = np.zeros((first[-1], int(col.max()) + 1), bool)
            held[row[side == k], col[side == k]] = True
            ask = side != k
            d = np.sqrt(squared_distances(held, starts)[row[ask], col[ask]])
            np.maximum.at(far, of[ask], d)
            weight = np.bincount(of[ask], visits[ask], len(names))
            with np.errstate(invalid="ignore"):
                means += np.where(weight > 0, np.bincount(of[ask], d * visits[ask], len(names)) / np.where(weight > 0, weight, 1), np.inf) / 2
        return pd.DataFrame({"image": names, "hausdorff": np.where(np.isfinite(means), far, np.inf), "surface": means})

    rows, inf = over_images(sides, run, f"image {kind}, hausdorff double, surface double"), F.lit(float("inf"))
    return images.select("image").join(rows, "image", "left").select("image", F.coalesce("hausdorff", inf).alias("hausdorff"), F.coalesce("surface", inf).alias("surface"))


def all_metrics(rows: DataFrame, found: Column, truth: Column, skip_empty: bool = True) -> DataFrame:
    """(image, counts, the seven metrics, hausdorff, surface) of dense pixel rows; with `skip_empty` only of images in which neither mask is empty."""
    flags = rows.select("image", "y", "x", found.alias("found"), truth.alias("truth"))
    table = scored(mask_metrics(flags, ["image"], F.col("found"), F.col("truth")), skip_empty)
    distances = boundary_distances(flags.where("found").select("image", "y", "x"), flags.where("truth").select("image", "y", "x"), flags.select("image").distinct())
    return table.join(distances, "image")


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def summary(rows: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """(metric, mean, std, min, max, median, n): of finite values, with the sample deviation."""
    v = finite(F.col(value))
    return rows.withColumn("__v", v).groupBy(metric).agg(
        F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("std"), F.min("__v").alias("min"), F.max("__v").alias("max"), F.expr("percentile(__v, 0.5)").alias("median"), F.count("__v").alias("n"),
    )


def unpivoted(rows: DataFrame, key: str, metrics) -> DataFrame:
    return rows.unpivot([key], list(metrics), "metric", "value")


def compared(rows: DataFrame, old: str = "old", new: str = "new", metric: str = "metric", smaller_is_better=("hausdorff",)) -> DataFrame:
    """By metric: means and deviations of both sides' finite values, improvement in percent, paired t and its p-value.

    Rows hold one image's value of each side; pairs are those in which both are finite.
    """
    a, b = finite(F.col(old)), finite(F.col(new))
    d = a - b
    n = rows.withColumns({"__a": a, "__b": b, "__d": d}).groupBy(metric).agg(
        F.avg("__a").alias("old_mean"), F.stddev_samp("__a").alias("old_std"), F.avg("__b").alias("new_mean"), F.stddev_samp("__b").alias("new_std"),
        F.count("__d").alias("pairs"), F.avg("__d").alias("__m"), F.stddev_samp("__d").alias("__s"),
    )
    sign = F.when(F.col(metric).isin(*smaller_is_better), -1.0).otherwise(1.0)
    t = F.when(F.col("pairs") > 1, F.try_divide(F.col("__m"), F.col("__s") / F.sqrt(F.col("pairs").cast("double"))))
    n = n.withColumns({"improvement": sign * F.try_divide(F.col("new_mean") - F.col("old_mean"), F.col("old_mean")) * 100, "t_statistic": t})
    return n.withColumn("p_value", two_sided_p("t_statistic", F.col("pairs") - 1)).withColumn("significant", F.col("p_value") < 0.05).drop("__m", "__s")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            step = 1.0
        elif k % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


@F.pandas_udf(T.DoubleType())
def _p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(n) or n < 1 else incomplete_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df, strict=True)], dtype=float)


def two_sided_p(t: str, freedom: Column) -> Column:
    p = _p(F.col(t), freedom.cast("double"))
    return F.when(F.isnan(p), None).otherwise(p)


def histogram(rows: DataFrame, metric: str = "metric", value: str = "value", bins: int = 20) -> DataFrame:
    """(metric, bin, low, high, n): finite values counted in bins of equal width between each metric's ends; the last bin holds the largest."""
    own = rows.select(F.col(metric).alias("metric"), finite(F.col(value)).alias("v")).where("v IS NOT NULL")
    ends = own.groupBy("metric").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    width = F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / bins).otherwise(1.0 / bins)
    place = F.least(F.floor((F.col("v") - F.col("a")) / F.col("w")), F.lit(bins - 1)).cast("int")
    counted = own.join(ends.withColumn("w", width), "metric").groupBy("metric", "a", "w", place.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select("metric", "bin", (F.col("a") + F.col("w") * F.col("bin")).alias("low"), (F.col("a") + F.col("w") * (F.col("bin") + 1)).alias("high"), "n")


def top_rows(rows: DataFrame, by: str, n: int, key: str = "image") -> DataFrame:
    """The n rows with the largest values; ties go to the smaller key."""
    return rows.orderBy(F.col(by).desc_nulls_last(), key).limit(n)
