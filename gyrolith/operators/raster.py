"""Grid operators over pixel rows (image, y, x, v): neighbourhoods as windows along rows and columns, kernels over whole images.

Grids are dense: every pixel of an image has its row. Beyond the border there are no pixels, so they don't count. Files of pixels
are small for their rows, so joins with them are merges by hint: by the size of its file a table of pixels could be taken for one to broadcast.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gyrolith.functions.blocks import codes, over_images


def _frame(axis: str, radius: int):
    other = "x" if axis == "y" else "y"
    return Window.partitionBy("image", other).orderBy(axis).rangeBetween(-radius, radius)


Offsets = list[tuple[int, int]]


def runs_of(offsets: Offsets, largest: bool) -> dict[int, tuple[int, int]]:
    """Each kernel row's run of columns; a maximum uses the reflected kernel, so that opening and closing stay in place."""
    sign, rows = -1 if largest else 1, {}
    for dy, dx in offsets:
        rows.setdefault(sign * dy, []).append(sign * dx)
    return {dy: (min(dx), max(dx)) for dy, dx in rows.items()}


def extremes(grid: np.ndarray, inside: np.ndarray, steps: list[tuple[Offsets, bool]]) -> np.ndarray:
    """Minima or maxima of a grid over kernels whose rows are runs, one after the other; places not inside don't count.

    Extremes over 1, 2, 4, 8 ... columns come each from two of the level before; every run is the extreme of two of
    them that overlap. So a kernel costs a pass over the grid for each of its rows, whatever its width.
    """
    for offsets, largest in steps:
        f, empty = (np.maximum, -np.inf) if largest else (np.minimum, np.inf)
        runs = runs_of(offsets, largest)
        up = max(map(abs, runs))
        side = max(max(-low, high, 0) for low, high in runs.values())
        levels = [np.pad(np.where(inside, grid, empty), ((up, up), (side, side)), constant_values=empty)]
        h, w = grid.shape
        out = np.full(grid.shape, empty)
        made: dict[tuple[int, int], np.ndarray] = {}
        for dy, (low, high) in runs.items():
            k = (high - low + 1).bit_length() - 1
            while len(levels) <= k:
                last, step = levels[-1], 1 << (len(levels) - 1)
                levels.append(last.copy())
                f(last[:, :-step], last[:, step:], out=levels[-1][:, :-step])
            if (low, high) not in made:
                a, b = side + low, side + high - (1 << k) + 1
                made[low, high] = f(levels[k][:, a : a + w], levels[k][:, b : b + w])
            f(out, made[low, high][up + dy : up + dy + h], out=out)
        grid = out
    return grid


def with_extremes(pixels: DataFrame, made: dict[str, tuple[str, list[tuple[Offsets, bool]]]]) -> DataFrame:
    """The pixels with new or changed columns: name -> (value, kernels one after the other, each with whether it takes maxima).

    An image stays in one task, and a task lays many of them one below the other.
    """
    gap = max((abs(dy) for _, steps in made.values() for offsets, _ in steps for dy, _ in offsets), default=0)
    fields = [f for f in pixels.schema.fields if f.name not in made] + [StructField(n, pixels.schema[v].dataType) for n, (v, _) in made.items()]
    schema = StructType(fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of, x = codes(pdf["image"]), pdf["x"].to_numpy(np.int64)
        heights = pdf["y"].groupby(of).max().to_numpy() + 1
        row = np.concatenate([[0], np.cumsum(heights + gap)])[of] + pdf["y"].to_numpy(np.int64)
        inside = np.zeros((int(row.max()) + 1, int(x.max()) + 1), bool)
        inside[row, x] = True
        new = {}
        for name, (value, steps) in made.items():
            grid = np.zeros(inside.shape)
            grid[row, x] = pdf[value]
            new[name] = extremes(grid, inside, steps)[row, x].astype(pdf[value].dtype)
        return pdf.assign(**new)[[f.name for f in fields]]

    return over_images(pixels, run, schema).select(*pixels.columns, *(n for n in made if n not in pixels.columns))


def square(pixels: DataFrame, radius: int, largest: bool, value: str = "v") -> DataFrame:
    """Minimum or maximum over the square of side 2 radius + 1."""
    return with_extremes(pixels, {value: (value, [(block(radius), largest)])})


def block(radius: int) -> Offsets:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def opened(pixels: DataFrame, radius: int, value: str = "v") -> DataFrame:
    return with_extremes(pixels, {value: (value, [(block(radius), False), (block(radius), True)])})


def closed(pixels: DataFrame, radius: int, value: str = "v") -> DataFrame:
    return with_extremes(pixels, {value: (value, [(block(radius), True), (block(radius), False)])})


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) of an elliptic kernel of size x size pixels; the anchor is at size // 2."""
    radius, centre = size // 2, size // 2
    out = []
    for y in range(size):
        dy = y - radius
        if abs(dy) <= radius:
            half = round(radius * sqrt((radius * radius - dy * dy) / (radius * radius))) if radius else 0
            out += [(y - centre, x - centre) for x in range(max(radius - half, 0), min(radius + half + 1, size))]
    return out


def with_kernel(pixels: DataFrame, offsets: Offsets, largest: bool, value: str = "v") -> DataFrame:
    """Minimum or maximum over a kernel whose rows are runs, such as an ellipse, on dense grids."""
    return with_extremes(pixels, {value: (value, [(offsets, largest)])})


def opened_by(pixels: DataFrame, size: int, value: str = "v") -> DataFrame:
    """Opening by an ellipse; a size of 0 or less changes nothing."""
    return pixels if size <= 0 else with_extremes(pixels, {value: (value, [(ellipse(size), False), (ellipse(size), True)])})


def closed_by(pixels: DataFrame, size: int, value: str = "v") -> DataFrame:
    return pixels if size <= 0 else with_extremes(pixels, {value: (value, [(ellipse(size), True), (ellipse(size), False)])})


def top_hat(pixels: DataFrame, size: int = 15) -> DataFrame:
    """The pixels with `top`: the value less its opening by an ellipse."""
    low = with_extremes(pixels, {"__o": ("v", [(ellipse(size), False), (ellipse(size), True)])})
    return low.withColumn("top", F.col("v") - F.col("__o")).drop("__o")


def local_contrast(pixels: DataFrame, radius: int = 7) -> DataFrame:
    """The pixels with `contrast`: where the value lies between the minimum and maximum of its square."""
    return with_contrast(with_extremes(pixels, {"__a": ("v", [(block(radius), False)]), "__b": ("v", [(block(radius), True)])}))


def with_contrast(rows: DataFrame) -> DataFrame:
    return rows.withColumn("contrast", (F.col("v") - F.col("__a")) / (F.col("__b") - F.col("__a") + 1e-10)).drop("__a", "__b")


def top_and_contrast(pixels: DataFrame, size: int = 15, radius: int = 7) -> DataFrame:
    """The pixels with `top` and `contrast`, from one pass over each image."""
    kernel = ellipse(size)
    rows = with_extremes(pixels, {"__o": ("v", [(kernel, False), (kernel, True)]), "__a": ("v", [(block(radius), False)]), "__b": ("v", [(block(radius), True)])})
    return with_contrast(rows.withColumn("top", F.col("v") - F.col("__o")).drop("__o"))


def _beside(value: str, axis: str) -> tuple[Column, Column]:
    """The values one place before and after along an axis, mirrored at the border without repeating it."""
    other = "x" if axis == "y" else "y"
    line = Window.partitionBy("image", other).orderBy(axis)
    before, after, own = F.lag(value).over(line), F.lead(value).over(line), F.col(value)
    return F.coalesce(before, after, own), F.coalesce(after, before, own)


def gradient(pixels: DataFrame) -> DataFrame:
    """The pixels with `gradient`: the length of both 3 x 3 Sobel derivatives, a difference along one axis and weights 1, 2, 1 along the other."""
    (left, right), (up, down) = _beside("v", "x"), _beside("v", "y")
    rows = pixels.withColumns({"__dx": right - left, "__dy": down - up})
    (up, down), (left, right) = _beside("__dx", "y"), _beside("__dy", "x")
    dx, dy = up + 2 * F.col("__dx") + down, left + 2 * F.col("__dy") + right
    return rows.withColumn("gradient", F.sqrt(dx * dx + dy * dy)).drop("__dx", "__dy")


def laplacian(pixels: DataFrame) -> DataFrame:
    """The pixels with `laplacian`: how far the four neighbours' sum is from four times the value."""
    (left, right), (up, down) = _beside("v", "x"), _beside("v", "y")
    return pixels.withColumn("laplacian", F.abs(left + right + up + down - 4 * F.col("v")))


def _mirrored(rows: DataFrame, axis: str, radius: int) -> DataFrame:
    """The rows with copies beyond both borders of an axis, mirrored with the border repeated; size in a column `__n`."""
    n, at = F.col("__n"), F.col(axis)
    turns = F.expr(f"sequence(-({radius} DIV (2 * __n)) - 1, {radius} DIV (2 * __n) + 1)")
    places = F.flatten(F.transform(turns, lambda k: F.array(at + 2 * n * k, 2 * n * (k + 1) - 1 - at)))
    there = F.filter(places, lambda p: p.between(-radius, n - 1 + radius))
    return rows.withColumn("__p", F.explode(there)).drop(axis).withColumnRenamed("__p", axis)


def local_deviation(pixels: DataFrame, sizes: DataFrame, radius: int = 10) -> DataFrame:
    """(image, y, x, v, deviation): the deviation within the square of side 2 radius + 1, on grids mirrored at the border."""
    rows = pixels.join(sizes.hint("merge"), "image").select("image", "y", "x", "v", "h", "w", F.col("v").alias("__a"), (F.col("v") * F.col("v")).alias("__b"))
    for axis, n in (("x", "w"), ("y", "h")):
        frame = _frame(axis, radius)
        wide = _mirrored(rows.withColumn("__n", F.col(n)), axis, radius)
        rows = wide.withColumns({c: F.avg(c).over(frame) for c in ("__a", "__b")}).where(F.col(axis).between(F.lit(0), F.col("__n") - 1)).drop("__n")
    variance = F.greatest(F.col("__b") - F.col("__a") * F.col("__a"), F.lit(0.0))
    return rows.select("image", "y", "x", "v", F.sqrt(variance).alias("deviation"))


def bright_pixels(pixels: DataFrame, mask, deviations: float = 2.5, share: float = 0.97, least: float = 170.0) -> DataFrame:
    """Pixels of the mask at or above the largest of mean + deviations * sd, the percentile, and `least`, all within the mask."""
    own = pixels.where(mask)
    limits = own.groupBy("image").agg((F.avg("v") + deviations * F.stddev_pop("v")).alias("a"), F.expr(f"percentile(v, {share})").alias("b"))
    return own.join(limits.hint("merge"), "image").where(F.col("v") >= F.greatest("a", "b", F.lit(least))).select(*pixels.columns)


def spiky_pixels(pixels: DataFrame, mask, deviations: float = 1.5, share: float = 0.99, least: float = 150.0) -> DataFrame:
    """Pixels of the mask, with `top`, at or above the percentile of positive top-hats and at or above max(mean + deviations * sd, least)."""
    own = pixels.where(mask)
    limits = own.groupBy("image").agg((F.avg("v") + deviations * F.stddev_pop("v")).alias("a"), F.expr(f"percentile(top, {share}) FILTER (WHERE top > 0)").alias("b"))
    return own.join(limits.hint("merge"), "image").where((F.col("top") >= F.col("b")) & (F.col("v") >= F.greatest("a", F.lit(least)))).select(*pixels.columns)


def grid_regions(pixels: DataFrame, mask, regions: int = 200, least: int = 10) -> DataFrame:
    """Pixels of the mask with `label`: the square cells that touch it, numbered row by row from 0; the side is max(least, root of area / regions)."""
    own = pixels.where(mask)
    side = own.groupBy("image").agg(F.greatest(F.lit(least), F.floor(F.sqrt(F.count("*") / F.lit(regions)))).cast("int").alias("__s"))
    rows = own.join(side.hint("merge"), "image").withColumns({"__cy": F.expr("y DIV __s"), "__cx": F.expr("x DIV __s")})
    label = (F.dense_rank().over(Window.partitionBy("image").orderBy("__cy", "__cx")) - 1).cast("int")
    return rows.withColumn("label", label).drop("__s", "__cy", "__cx")


def crop(pixels: DataFrame, mask, below: int = 30) -> DataFrame:
    """All pixels, 0 outside the mask's bounding box, which is extended downwards; an empty mask gives zeros."""
    inside = lambda c: F.when(mask, F.col(c))
    box = pixels.groupBy("image").agg(F.min(inside("y")).alias("__y1"), (F.max(inside("y")) + below).alias("__y2"), F.min(inside("x")).alias("__x1"), F.max(inside("x")).alias("__x2"))
    held = F.col("y").between(F.col("__y1"), F.col("__y2")) & F.col("x").between(F.col("__x1"), F.col("__x2"))
    return pixels.join(box.hint("merge"), "image").withColumn("v", F.when(held, F.col("v")).otherwise(0.0)).drop("__y1", "__y2", "__x1", "__x2")


def in_boxes(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels in at least one of their image's boxes [x1, x2) x [y1, y2); a semi-join, so overlaps count once."""
    b = boxes.select(F.col("image").alias("__image"), "x1", "y1", "x2", "y2")
    on = (F.col("image") == F.col("__image")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2")) & (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2"))
    return pixels.join(b, on, "left_semi")


def box_labels(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image, y, x, label): 1 + the last of the boxes that hold the pixel, as later ones overwrite; 0 without any."""
    b = boxes.select(F.col("image").alias("__image"), "box", "x1", "y1", "x2", "y2")
    on = (F.col("image") == F.col("__image")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2")) & (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2"))
    return pixels.join(b, on, "left").groupBy("image", "y", "x").agg(F.coalesce(F.max("box") + 1, F.lit(0)).cast("int").alias("label"))


def clip_boxes(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes with positive sides, clipped to their image; the test precedes clipping, so a box outside may become empty and stay."""
    rows = boxes.where("x2 > x1 AND y2 > y1").join(sizes.hint("merge"), "image")
    clip = lambda c, size: F.least(F.greatest(F.col(c), F.lit(0)), F.col(size)).alias(c)
    return rows.select("image", "box", clip("x1", "w"), clip("y1", "h"), clip("x2", "w"), clip("y2", "h"))


def power_map(value: Column, factor: float = 0.8) -> Column:
    """Grey level 0..255 on a power curve, rounded down."""
    return F.floor(F.pow(value / 255.0, F.lit(1.0 / factor)) * 255)


def look_up(value: Column, table: Column) -> Column:
    return F.element_at(table, (value + 1).cast("int"))


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Hue 0..179, saturation and value 0..255 of 8-bit channels, rounded half up."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    spread = (top - low).cast("double")
    one = F.when(spread > 0, spread).otherwise(1.0)
    hue = F.when(top == r, 60 * (g - b) / one).when(top == g, 120 + 60 * (b - r) / one).otherwise(240 + 60 * (r - g) / one)
    hue = F.floor(F.when(hue < 0, hue + 360).otherwise(hue) / 2 + 0.5)
    hue = F.when(spread == 0, 0).when(hue >= 180, hue - 180).otherwise(hue)
    saturation = F.when(top == 0, 0).otherwise(F.floor(spread * 255 / F.when(top == 0, 1).otherwise(top) + 0.5))
    return hue, saturation, top


def red(b: Column, g: Column, r: Column, first: tuple[int, int] = (0, 10), second: tuple[int, int] = (160, 180), saturation: int = 50, value: int = 50) -> Column:
    """Whether a pixel's hue lies in one of two bands of red, with enough saturation and value."""
    h, s, v = hsv(b, g, r)
    return (h.between(*first) | h.between(*second)) & (s >= saturation) & (v >= value)


def resized(pixels: DataFrame, sizes: DataFrame, height: int, width: int) -> DataFrame:
    """Nearest-neighbour resize: each new place reads pixel (floor(y h / height), floor(x w / width)).

    A pixel hands its value to the places that read it; new places outnumber what Spark knows of the tables, so they are no side of a join.
    """
    rows = pixels.join(sizes.select("image", "h", "w").hint("merge"), "image").where("y >= 0 AND y < h AND x >= 0 AND x < w")
    for old, n, new, of in (("y", "h", "ny", height), ("x", "w", "nx", width)):
        first, end = (f"CAST((({old} + {k}) * {of}L + {n} - 1) DIV {n} AS INT)" for k in (0, 1))
        rows = rows.where(f"{first} < {end}").withColumn(new, F.explode(F.expr(f"sequence({first}, {end} - 1)")))
    return rows.select("image", F.col("ny").alias("y"), F.col("nx").alias("x"), "v")
