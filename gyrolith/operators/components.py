"""Connected components of masks (image, y, x), eight neighbours, and filters on their border, area and shape.

An image stays in one task, as a picture fits there. A task works on many images at once, laid out one below the other.
Of larger pictures `tiled_components` and `tiled_holes` hold a tile in a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.functions.blocks import codes, over_images
from gyrolith.functions.graphs import least_linked, numbered_within
from gyrolith.sources.tables import written

#: Side of the tiles of pictures that are larger than a task should hold, and pixels of small tiles that are looked at together.
TILE, TILED = 2048, 1 << 20
TILES = ("image", "ty", "tx")
EIGHT = ((0, 1), (1, 1), (1, 0), (1, -1))
FOUR = ((0, 1), (1, 0))


def numbered(y: np.ndarray, x: np.ndarray, steps=EIGHT) -> np.ndarray:
    """Component of each pixel, numbered from 1 in the order of first pixels row by row."""
    n = len(y)
    width = int(x.max()) + 3 if n else 3
    place = (y.astype(np.int64) + 1) * width + x + 1
    order = np.argsort(place)
    ranked = place[order]
    pairs = []
    for dy, dx in steps:
        k = np.searchsorted(ranked, ranked + dy * width + dx)
        hit = (k < n) & (ranked[np.minimum(k, n - 1)] == ranked + dy * width + dx)
        pairs.append((np.flatnonzero(hit), k[hit]))
    a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
    label = np.arange(n)
    while True:  # the least of both ends, then jumps
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(n, np.int64)
    out[order] = np.unique(label, return_inverse=True)[1] + 1
    return out


def one_below_another(images: np.ndarray, y: np.ndarray, height: int | None = None) -> np.ndarray:
    """Rows of pixels when images stand one below the other, two rows apart."""
    height = (int(y.max()) if len(y) else 0) + 1 if height is None else height
    return images * (height + 2) + y


def components(mask: DataFrame) -> DataFrame:
    """(image, y, x, component) with components numbered from 1 in each image."""
    kind = mask.schema["image"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = codes(pdf["image"])
        label = numbered(one_below_another(of, pdf["y"].to_numpy(np.int64)), pdf["x"].to_numpy())
        first = pd.Series(label).groupby(of).transform("min").to_numpy()
        return pd.DataFrame({"image": pdf["image"], "y": pdf["y"], "x": pdf["x"], "component": label - first + 1})

    return over_images(mask.select("image", "y", "x").distinct(), run, f"image {kind}, y int, x int, component long")


def tiled(mask: DataFrame, tile: int) -> DataFrame:
    return mask.withColumns({"ty": F.expr(f"CAST(y DIV {tile} AS INT)"), "tx": F.expr(f"CAST(x DIV {tile} AS INT)")})


def seams(pixels: DataFrame, tile: int, steps) -> DataFrame:
    """(image, a, b): parts `id` of different tiles that steps between their pixels link; only pixels at a tile's edge are looked at."""
    edge = pixels.where(" OR ".join(f"{c} % {tile} IN (0, {tile - 1})" for c in "yx"))
    step = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps)))
    asks = edge.select("image", "y", "x", F.col("id").alias("a"), step.alias("s"))
    away = F.expr(f"(y + s.dy) DIV {tile} <> y DIV {tile} OR x + s.dx < 0 OR (x + s.dx) DIV {tile} <> x DIV {tile}")
    asks = asks.where(away).select("image", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "a")
    return asks.join(edge.select("image", "y", "x", F.col("id").alias("b")), ["image", "y", "x"]).select("image", "a", "b").distinct()


def tiled_components(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """`components` for images of any size: a tile stays in one task, and parts of components are united over the seams.

    A part goes by the place of its first pixel, row by row, so the least of a component's parts is its own first pixel, by
    which components are numbered.
    """
    kind = mask.schema["image"].dataType.simpleString()
    place = F.shiftleft(F.col("y").cast("long"), 32) + F.col("x")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        label = numbered(one_below_another(codes(*(pdf[c] for c in TILES)), y % tile, tile), x % tile)
        first = np.full(label.max(), np.iinfo(np.int64).max)
        np.minimum.at(first, label - 1, (y << 32) + x)
        return pd.DataFrame({"image": pdf["image"], "y": pdf["y"], "x": pdf["x"], "id": first[label - 1]})

    cut = tiled(mask.select("image", "y", "x").distinct(), tile)
    parts = written(over_images(cut, within, f"image {kind}, y int, x int, id long", TILES))
    roots = least_linked(seams(parts, tile, EIGHT), "image")
    rows = parts.join(roots, ["image", "id"], "left").select("image", "y", "x", F.coalesce("root", "id").alias("root"))
    numbers = numbered_within(rows.where(F.col("root") == place), "image", "root")
    return rows.join(numbers, ["image", "root"]).select("image", "y", "x", F.col("number").alias("component"))


def tiled_holes(mask: DataFrame, sizes: DataFrame, tile: int = TILE) -> DataFrame:
    """(image, y, x): the holes of masks of images (image, h, w) of any size, for `filled`: free pixels that four-neighbour steps don't connect with the border.

    Free pixels are parts of tiles like components; those that touch the border, or are linked to one that does, are outside. Tiles are
    looked at twice, so that only parts at seams or borders are rows.
    """
    kind = mask.schema["image"].dataType.simpleString()
    spans = {"ty": F.explode(F.expr(f"sequence(0, CAST((h - 1) DIV {tile} AS INT))")), "tx": F.explode(F.expr(f"sequence(0, CAST((w - 1) DIV {tile} AS INT))"))}
    frame = sizes.select("image", "h", "w", spans["ty"].alias("ty")).withColumn("tx", spans["tx"]).withColumns({"y": F.lit(-1), "x": F.lit(-1)})
    held = mask.join(sizes.hint("merge"), "image", "left_semi").select("image", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    held = tiled(held, tile)
    rows = frame.unionByName(held.withColumns({"h": F.lit(None).cast("int"), "w": F.lit(None).cast("int")})).withColumn("id", F.lit(-1).cast("long"))
    schema = f"image {kind}, y int, x int, id long"

    def free(pdf: pd.DataFrame, kept: Callable[..., np.ndarray]) -> pd.DataFrame:
        """The tiles' free pixels with the place of the first pixel of each one's part, where `kept` says so from place, their image's size, and whether the part's id is a row of its tile."""
        found = [pdf.iloc[:0][["image", "y", "x", "id"]]]
        of, y, own = codes(*(pdf[c] for c in TILES)), pdf["y"].to_numpy(), pdf["id"].to_numpy()
        frames = np.flatnonzero((y < 0) & (own < 0))  # a row for each tile, in their order
        top, left = (pdf[c].to_numpy(np.int64)[frames] * tile for c in ("ty", "tx"))
        h, w = (pdf[c].to_numpy()[frames].astype(np.int64) for c in ("h", "w"))
        if not np.array_equal(of[frames], np.arange(of[-1] + 1)):
            raise ValueError("pixels outside their image, or an image with two sizes")
        step = max(1, TILED // tile**2)
        for k in range(0, len(frames), step):
            some = slice(k, min(k + step, len(frames)))
            high, wide = np.minimum(tile, h[some] - top[some]), np.minimum(tile, w[some] - left[some])
            side = np.arange(tile)
            grid = np.zeros((len(high), min(tile, high.max()) + 1, wide.max()), bool)  # a row between tiles
            grid[:, :-1] = (side[: grid.shape[1] - 1] < high[:, None])[:, :, None] & (side[: grid.shape[2]] < wide[:, None])[:, None, :]
            rows = slice(*np.searchsorted(of, [some.start, some.stop]))
            on = y[rows] >= 0
            at, v, u = of[rows][on] - k, y[rows][on] % tile, pdf["x"].to_numpy()[rows][on] % tile
            grid[at, v, u] = False
            at, v, u = np.nonzero(grid)
            if not len(at):
                continue
            label = numbered(at * grid.shape[1] + v, u, FOUR)
            first = np.unique(label, return_index=True)[1]
            v, u = v + top[some][at], u + left[some][at]
            part = ((v[first] << 32) + u[first])[label - 1]
            opened = np.unique(np.stack([of[rows][own[rows] >= 0] - k, own[rows][own[rows] >= 0]], 1), axis=0)
            keys = pd.MultiIndex.from_arrays([at[first], (v[first] << 32) + u[first]])
            is_open = keys.isin(pd.MultiIndex.from_arrays(opened.T))[label - 1] if len(opened) else np.zeros(len(at), bool)
            some = kept(v, u, h[k + at], w[k + at], is_open)
            found.append(pd.DataFrame({"image": pdf["image"].to_numpy()[frames[k + at[some]]], "y": v[some].astype(np.int32), "x": u[some].astype(np.int32), "id": part[some]}))
        return pd.concat(found, ignore_index=True)

    def at_edges(pdf: pd.DataFrame) -> pd.DataFrame:
        return free(pdf, lambda y, x, h, w, is_open: (y % tile == 0) | (y % tile == tile - 1) | (x % tile == 0) | (x % tile == tile - 1) | (y == h - 1) | (x == w - 1))

    def closed(pdf: pd.DataFrame) -> pd.DataFrame:
        return free(pdf, lambda y, x, h, w, is_open: ~is_open)

    edges = written(over_images(rows, at_edges, schema, TILES))
    roots = least_linked(seams(edges, tile, FOUR), "image")
    parts = edges.join(roots, ["image", "id"], "left").withColumn("root", F.coalesce("root", "id"))
    open_ = parts.join(sizes.hint("merge"), "image").where("y = 0 OR x = 0 OR y = h - 1 OR x = w - 1").select("image", "root").distinct()
    outside_ = parts.join(open_, ["image", "root"], "left_semi").select("image", "id").distinct()
    here = lambda bits: F.expr(f"CAST({bits} DIV {tile} AS INT)")
    # Keys have one type on both sides: rows of equal keys of different types would go to different tasks.
    outside_ = outside_.withColumns({"h": F.lit(None).cast("int"), "w": F.lit(None).cast("int"), "ty": here("shiftright(id, 32)"), "tx": here("(id & 4294967295)"), "y": F.lit(-1), "x": F.lit(-1)})
    return over_images(rows.unionByName(outside_), closed, schema, TILES).select("image", "y", "x")


def component_table(labelled: DataFrame) -> DataFrame:
    """(image, component, area, cy, cx, x, y, w, h): centroids and bounding boxes."""
    n = labelled.groupBy("image", "component").agg(F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return n


def without_border(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """Components that have no pixel on the edge of their image."""
    at_edge = labelled.join(sizes.hint("merge"), "image").where("y = 0 OR x = 0 OR y = h - 1 OR x = w - 1").select("image", "component").distinct()
    return labelled.join(at_edge.hint("merge"), ["image", "component"], "left_anti")


def by_area(labelled: DataFrame, least: int = 10, most: int = 2000) -> DataFrame:
    """Components whose area lies in [least, most]."""
    kept = labelled.groupBy("image", "component").agg(F.count("*").alias("area")).where(F.col("area").between(least, most))
    return labelled.join(kept.select("image", "component").hint("merge"), ["image", "component"], "left_semi")


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Convex hull, by two monotone chains."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(some):
        out = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def doubled_area(points: list[tuple[int, int]]) -> int:
    return abs(sum(y * v - u * x for (y, x), (u, v) in zip(points, points[1:] + points[:1], strict=True)))


def pattern_sums(of: np.ndarray, y: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(area, perimeter) of the outer outlines of n components, each filled and by itself, as sums over 2 x 2 patterns.

    The outline joins centres of pixels. Four pixels hold a unit of its area and three a half. Three pixels hold a diagonal step, two side by side a
    straight one, and two across a diagonal that is walked both ways.
    """
    low, left = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, of, y)
    np.minimum.at(left, of, x)
    v, u = y - low[of], x - left[of]
    height, width = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(height, of, v + 1)
    np.maximum.at(width, of, u + 1)
    area, straight, across = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    size = np.ceil(np.log2(width)).astype(int)
    for s in np.unique(size):  # components of about one width stand one below the other
        kinds = np.flatnonzero(size == s)
        some = size[of] == s
        rank = np.searchsorted(kinds, of[some])
        first = np.concatenate([[0], np.cumsum(height[kinds] + 2)])
        grid = ~outside(first[rank] + v[some] + 1, u[some] + 1)
        a, b, c, d = grid[:-1, :-1], grid[:-1, 1:], grid[1:, :-1], grid[1:, 1:]
        count = a.astype(np.int8) + b + c + d
        both = (count == 2) & (a == d)
        rows = np.searchsorted(first, np.arange(len(count)), "right") - 1
        rows = np.minimum(rows, len(kinds) - 1)
        total = lambda hits, rows=rows, kinds=kinds: np.bincount(rows, hits.sum(1), len(kinds))
        area[kinds] = total(count == 4) + total(count == 3) / 2
        straight[kinds] = total((count == 2) & ~both)
        across[kinds] = total(count == 3) + 2 * total(both)
    return area, straight + across * np.sqrt(2.0)


def shape_table(labelled: DataFrame) -> DataFrame:
    """(image, component, outline_area, perimeter, circularity, solidity) from the outer outline's polygon and its hull.

    The hull comes from the first and last pixel of each row.
    """
    kind = labelled.schema["image"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["image", "component", "y", "x"], kind="stable")
        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        change = (np.diff(codes(pdf["image"]), prepend=-1) != 0) | (np.diff(pdf["component"].to_numpy(), prepend=-1) != 0)
        starts, of = np.flatnonzero(change), np.cumsum(change) - 1
        area, length = pattern_sums(of, y, x, len(starts))
        turn = change | (np.diff(y, prepend=-1) != 0)
        ends = turn | np.append(turn[1:], True)  # first and last pixels of rows
        corners = np.split(np.column_stack([y, x])[ends], np.flatnonzero(change[ends])[1:])
        whole = np.array([doubled_area(hull([tuple(p) for p in c.tolist()])) for c in corners]) / 2
        table = pd.DataFrame({"outline_area": area, "perimeter": length, "circularity": 4 * np.pi * area / (length * length + 1e-10), "solidity": np.where(whole > 0, area / np.where(whole > 0, whole, 1), 0.0)})
        return pd.concat([pdf[["image", "component"]].iloc[starts].reset_index(drop=True), table], axis=1)

    schema = f"image {kind}, component long, outline_area double, perimeter double, circularity double, solidity double"
    return over_images(labelled.select("image", "component", "y", "x"), run, schema)


def by_shape(labelled: DataFrame, circularity: tuple[float, float] = (0.15, 1.0), solidity: float = 0.4) -> DataFrame:
    """Components with an outline of some area, and circularity and solidity within the limits."""
    ok = shape_table(labelled).where((F.col("outline_area") > 0) & F.col("circularity").between(*circularity) & (F.col("solidity") >= solidity))
    return labelled.join(ok.select("image", "component").hint("merge"), ["image", "component"], "left_semi")


def outside(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Grid of what four-neighbour steps from its corner reach without the pixels given; pictures in it have frames of free pixels, which all hang together."""
    grid = np.ones((int(row.max()) + 2, int(col.max()) + 2), bool)
    grid[row, col] = False
    v, u = np.nonzero(grid)
    label = numbered(v, u, FOUR)
    grid[v, u] = label == label[0]
    return grid


def framed(images: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of pixels when images stand one below the other, each in a frame of one pixel."""
    return one_below_another(images, y.astype(np.int64)) + 1, x.astype(np.int64) + 1


def filled(mask: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The mask with its holes: pixels outside it that four-neighbour steps don't connect with the border.

    Holes lie between pixels of the mask, so images' sizes make no difference.
    """
    kind = mask.schema["image"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = codes(pdf["image"])
        grid = outside(*framed(of, pdf["y"].to_numpy(), pdf["x"].to_numpy()))
        step = int(pdf["y"].max()) + 3
        v, u = np.nonzero(~grid)
        names = pdf["image"].iloc[np.flatnonzero(np.diff(of, prepend=-1))].to_numpy()
        return pd.DataFrame({"image": names[(v - 1) // step], "y": (v - 1) % step, "x": u - 1})

    return over_images(mask.select("image", "y", "x"), run, f"image {kind}, y int, x int")


def outer_contours(mask: DataFrame) -> DataFrame:
    """(image, y, x, visits): pixels of the outer outlines of components, and how often an outline passes through each.

    An outline follows pixels beside the outside, so holes and what lies in them have none. A pixel is passed
    once for each run of outside around it: runs hold a side of the pixel, and go on from side to side over free corners.
    """
    kind = mask.schema["image"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = framed(codes(pdf["image"]), pdf["y"].to_numpy(), pdf["x"].to_numpy())
        grid = outside(row, col)
        held = np.zeros(grid.shape, bool)
        held[row, col] = True
        sides = [grid[row + dy, col + dx] for dy, dx in ((-1, 0), (0, 1), (1, 0), (0, -1))]
        corners = [~held[row + dy, col + dx] for dy, dx in ((-1, 1), (1, 1), (1, -1), (-1, -1))]
        joins = [sides[k] & sides[(k + 1) % 4] & corners[k] for k in range(4)]
        visits = sum(s.astype(int) for s in sides) - sum(j.astype(int) for j in joins)
        visits = np.where(np.all(sides, 0) & np.all(corners, 0), 1, visits)
        some = visits > 0
        return pd.DataFrame({"image": pdf["image"][some], "y": pdf["y"][some], "x": pdf["x"][some], "visits": visits[some]})

    return over_images(mask.select("image", "y", "x").distinct(), run, f"image {kind}, y int, x int, visits long")
