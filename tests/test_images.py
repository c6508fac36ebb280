"""Image operators that work on whole images in numpy, held against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gyrolith.operators import components, metrics, raster


def test_distance_transform_of_stacked_images():
    rng = np.random.default_rng(0)
    heights, width = [1, 9, 4, 17, 6], 13
    held = rng.random((sum(heights), width)) < 0.12
    held[10:14] = False  # an image without any
    first = np.repeat(np.concatenate([[0], np.cumsum(heights)[:-1]]), heights)
    got = metrics.squared_distances(held, first)
    for y in range(len(held)):
        own = [(v, u) for v, u in zip(*np.nonzero(held), strict=True) if first[v] == first[y]]
        want = [min(((v - y) ** 2 + (u - x) ** 2 for v, u in own), default=math.inf) for x in range(width)]
        assert got[y].tolist() == want
    wide = rng.random((40, 300)) < 0.01
    y, x = np.nonzero(wide)
    assert metrics.squared_distances(wide, np.zeros(40, int))[7, 211] == ((y - 7) ** 2 + (x - 211) ** 2).min()


AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def walked(held):
    """Outer outline of one component of pixels (y, x), by keeping a hand on its wall."""
    start = min(held)
    path, at, facing, first = [start], start, 4, None
    while True:
        turns = [(facing + 1 + t) % 8 for t in range(8)]
        k = next((k for k in turns if (at[0] + AROUND[k][0], at[1] + AROUND[k][1]) in held), None)
        if k is None:
            return path
        if (at, k) == first:
            return path[:-1]
        first = first or (at, k)
        at, facing = (at[0] + AROUND[k][0], at[1] + AROUND[k][1]), (k + 4) % 8
        path.append(at)


def shape_of(held):
    path = walked(held)
    ends = path[1:] + path[:1]
    area = abs(sum(y * v - u * x for (y, x), (u, v) in zip(path, ends, strict=True))) / 2
    return area, sum(math.dist(p, q) for p, q in zip(path, ends, strict=True))


@pytest.mark.parametrize("share", [0.15, 0.4, 0.6, 0.85])
def test_shapes_are_those_of_a_walk(spark, share):
    rng = np.random.default_rng(int(share * 100))
    rows = [(f"i{k}", int(y), int(x)) for k in range(6) for y, x in zip(*np.nonzero(rng.random((12, 5 + 7 * k)) < share), strict=True)]
    parts = components.components(spark.createDataFrame(rows, "image string, y int, x int"))
    held = {}
    for r in parts.collect():
        held.setdefault((r.image, r.component), set()).add((r.y, r.x))
    found = {(r.image, r.component): r for r in components.shape_table(parts).collect()}
    assert found.keys() == held.keys()
    for key, pixels in held.items():
        area, length = shape_of(pixels)
        r = found[key]
        assert r.outline_area == area and r.perimeter == pytest.approx(length, abs=1e-9)
        hull = components.hull(sorted(pixels))
        whole = abs(sum(y * v - u * x for (y, x), (u, v) in zip(hull, hull[1:] + hull[:1], strict=True))) / 2
        assert r.solidity == pytest.approx(area / whole if whole else 0.0)


def test_components_in_holes_have_shapes_of_their_own(spark):
    rings = ["#######", "#.....#", "#.###.#", "#.#.#.#", "#.###.#", "#.....#", "#######"]
    rows = [("a", y, x) for y, line in enumerate(rings) for x, c in enumerate(line) if c == "#"]
    parts = components.components(spark.createDataFrame(rows, "image string, y int, x int"))
    assert sorted((r.outline_area, r.perimeter, r.solidity) for r in components.shape_table(parts).collect()) == [(4.0, 8.0, 1.0), (36.0, 24.0, 1.0)]


def plain(a, inside, offsets, f):
    out = np.zeros(a.shape)
    for y, x in zip(*np.nonzero(inside), strict=True):
        at = [(y + dy, x + dx) for dy, dx in offsets]
        out[y, x] = f(a[p] for p in at if 0 <= p[0] < a.shape[0] and 0 <= p[1] < a.shape[1] and inside[p])
    return out


@pytest.mark.parametrize("size", [2, 3, 4, 7, 15])
def test_kernels_of_any_width_on_images_of_any_size(spark, size):
    rng = np.random.default_rng(size)
    images = {"a": rng.random((9, 21)), "b": rng.random((20, 5)), "c": rng.random((1, 1))}
    rows = [(k, y, x, float(a[y, x])) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    pixels = spark.createDataFrame(rows, "image string, y int, x int, v double")
    kernel = raster.ellipse(size)
    back = [(-dy, -dx) for dy, dx in kernel]
    got = {(r.image, r.y, r.x): r for r in raster.top_and_contrast(pixels, size, size // 2).collect()}
    for k, a in images.items():
        every = np.ones(a.shape, bool)
        low = plain(plain(a, every, kernel, min), every, back, max)
        least, most = (plain(a, every, raster.block(size // 2), f) for f in (min, max))
        for y, x in np.ndindex(a.shape):
            r = got[k, y, x]
            assert r.top == a[y, x] - low[y, x] and r.contrast == pytest.approx((a[y, x] - least[y, x]) / (most[y, x] - least[y, x] + 1e-10))


def drawn(side, seed):
    """A large mask: a spiral through all tiles, long diagonals, and scattered pixels."""
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 60, 400_000)
    y, x = side / 2 + t / 61 * side / 2 * np.sin(t), side / 2 + t / 61 * side / 2 * np.cos(t)
    spots = rng.integers(0, side, (20_000, 2))
    k = np.arange(side)
    both = np.concatenate([np.stack([y, x], 1).astype(int), spots, np.stack([k, (3 * k) % side], 1)])
    return np.unique(both, axis=0)


def test_one_large_image_in_tiles(spark):
    """8,000 x 8,000 pixels: the same components, with the same numbers, as in one task; so are the holes of a smaller one."""
    pixels = drawn(8000, 1)
    mask = spark.createDataFrame(pd.DataFrame({"image": "a", "y": pixels[:, 0], "x": pixels[:, 1]}), "image string, y int, x int")
    want = components.numbered(pixels[:, 0], pixels[:, 1])
    got = components.tiled_components(mask, 2048).toPandas().sort_values(["y", "x"])
    assert np.array_equal(got[["y", "x"]].to_numpy(), pixels) and np.array_equal(got["component"].to_numpy(), want) and want.max() > 10_000
    rings = np.zeros((150, 170), bool)
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b, h, w = rng.integers(0, 120), rng.integers(0, 140), rng.integers(2, 30), rng.integers(2, 30)
        rings[a : a + h + 1, [b, b + w]] = True
        rings[[a, a + h], b : b + w + 1] = True
    y, x = np.nonzero(rings)
    mask = spark.createDataFrame([("r", int(v), int(u)) for v, u in zip(y, x, strict=True)], "image string, y int, x int")
    sizes = spark.createDataFrame([("r", 150, 170), ("empty", 40, 33)], "image string, h int, w int")
    filled = {(r.y, r.x) for r in components.filled(mask).collect()}
    for tile in (16, 64, 2048):
        assert {(r.y, r.x) for r in components.tiled_holes(mask, sizes, tile).collect()} == filled - set(zip(y.tolist(), x.tolist(), strict=True))


def test_tiles_of_many_images_with_keys_in_many_partitions(spark):
    """Many images and shuffles that aren't joined up again: each tile's parts must meet its pixels."""
    rng = np.random.default_rng(11)
    images = {k: rng.random((9 + k % 4, 8 + k % 3)) < 0.55 for k in range(60)}
    rows = [(k, int(y), int(x)) for k, a in images.items() for y, x in zip(*np.nonzero(a), strict=True)]
    mask = spark.createDataFrame(rows, "image long, y int, x int")
    sizes = spark.createDataFrame([(k, *a.shape) for k, a in images.items()], "image long, h int, w int")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        holes = {tuple(r) for r in components.tiled_holes(mask, sizes, 4).collect()}
        whole = {tuple(r) for r in components.filled(mask).join(mask, ["image", "y", "x"], "left_anti").collect()}
        parts = {tuple(r) for r in components.tiled_components(mask, 4).select("image", "y", "x", "component").collect()}
        plain = {tuple(r) for r in components.components(mask).select("image", "y", "x", "component").collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert holes == whole and holes
    assert parts == plain


def test_new_places_of_a_resize_are_never_broadcast(spark, sf):
    from gyrolith.sources.tables import small_images, vectors

    sizes = vectors(spark, sf).select(F.col("id").alias("image"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    wide = raster.resized(small_images(spark, sf), sizes, 32, 32)
    plan = wide._jdf.queryExecution().sparkPlan().toString()
    assert not [part for part in plan.split("BroadcastExchange")[1:] if "Generate" in part.split("FileScan")[0]]
    a = np.arange(35).reshape(7, 5)
    rows = spark.createDataFrame([(0, int(y), int(x), float(a[y, x])) for y, x in np.ndindex(a.shape)], "image long, y int, x int, v double")
    for h, w in ((3, 11), (16, 2)):
        new = {(r.y, r.x): r.v for r in raster.resized(rows, spark.createDataFrame([(0, 7, 5)], "image long, h int, w int"), h, w).collect()}
        assert new == {(y, x): float(a[y * 7 // h, x * 5 // w]) for y, x in np.ndindex(h, w)}
