"""The other torque clustering: centres chosen by density and distance, moved by weighted means, and scored by silhouette.

Scores of given centres or clusters are joins and blocks over any number of points, and so are the models of `fit_points`. For
images, which have a few hundred regions each, `fit_images` is one grouped map.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrolith.functions.blocks import against_all, codes, distances, medians, over_images, packed_by
from gyrolith.functions.folds import FEW, all_asks, block_size, folded
from gyrolith.operators.features import z_scores
from gyrolith.sources.tables import starts, written


#: Centres that every task may hold.
MOST_CENTRES = 10_000
#: What a median distance gets, so that it can divide.
TINY = 1e-10


@dataclass(frozen=True)
class Settings:
    least_k: int = 2
    most_k: int = 8
    tolerance: float = 1e-4
    rounds: int = 100
    exponent: float = 2.0
    least_points: int = 5
    seed: int = 42


def bandwidth(points: DataFrame) -> float:
    """Deviation of all components times n ** (-1 / (dimensions + 4)), at least 1e-6."""
    row = points.select("id", F.size("v").alias("d"), F.explode("v").alias("x")).agg(F.stddev_pop("x").alias("s"), F.count_distinct("id").alias("n"), F.max("d").alias("d")).first()
    return max(1e-6, row["s"] * row["n"] ** (-1 / (row["d"] + 4)))


def density(points: DataFrame, width: float | None = None) -> DataFrame:
    """(id, density): sums of Gaussians of the distances to all points, itself included."""
    h = bandwidth(points) if width is None else width

    def part(a, b, d):
        return pd.DataFrame({"id": a["id"], "density": np.exp(-0.5 * (d / h) ** 2).sum(1)})

    return against_all(points.select("id", "v"), part, "id long, density double").groupBy("id").agg(F.sum("density").alias("density"))


def centre_distances(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, k, d) for centres (k, c): every point with every centre, of which there are at most MOST_CENTRES."""
    if centres.count() > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    d = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return points.crossJoin(F.broadcast(centres)).select("id", "k", d.alias("d"))


def force_weights(points: DataFrame, centres: DataFrame, exponent: float = 2.0) -> DataFrame:
    """(id, k, d, weight, torque): shares of 1 / max(d, 1e-10) ** exponent, and the range of a point's shares."""
    own = Window.partitionBy("id")
    raw = 1 / F.pow(F.greatest("d", F.lit(1e-10)), F.lit(exponent))
    rows = centre_distances(points, centres).withColumn("raw", raw).withColumn("weight", F.col("raw") / F.sum("raw").over(own)).drop("raw")
    return rows.withColumn("torque", F.max("weight").over(own) - F.min("weight").over(own))


def assign(points: DataFrame, centres: DataFrame, exponent: float = 2.0) -> DataFrame:
    """(id, cluster): the centre with the least d (1 - torque / 2), lower numbers first among equals."""
    rows = force_weights(points, centres, exponent)
    return rows.groupBy("id").agg(F.min(F.struct((F.col("d") * (1 - 0.5 * F.col("torque"))).alias("s"), "k"))["k"].alias("cluster"))


def inertia(points: DataFrame, centres: DataFrame) -> DataFrame:
    """One row: the sum of squared distances from points (id, v, cluster) to the centre of their cluster."""
    rows = points.join(centres.withColumnRenamed("k", "cluster"), "cluster")
    return rows.agg(F.sum(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).alias("inertia"))


def means(points: DataFrame) -> DataFrame:
    """(k, c): the mean of each cluster of points (id, v, cluster)."""
    rows = points.select("cluster", F.posexplode("v").alias("at", "x")).groupBy("cluster", "at").agg(F.avg("x").alias("x"))
    return rows.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s")).select(F.col("cluster").alias("k"), F.transform("s", lambda s: s["x"]).alias("c"))


def weighted_centres(points: DataFrame) -> DataFrame:
    """(k, c): means of clusters weighted by closeness: sums of exp(-d / median d) over the cluster, itself included."""

    middle = medians(points.select("id", "v", "cluster"), lambda a, b, d: d, within=("cluster",))

    def near(a, b, d):
        return pd.DataFrame({"id": a["id"], "w": np.exp(-d / (a["mid"][:, None] + TINY)).sum(1)})

    own = points.select("id", "v", "cluster").join(middle, "cluster")
    weights = against_all(own, near, "id long, w double", within=("cluster",)).groupBy("id").agg(F.sum("w").alias("w"))
    rows = points.join(weights, "id").select("cluster", "w", F.posexplode("v").alias("at", "x")).groupBy("cluster", "at").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return rows.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s")).select(F.col("cluster").alias("k"), F.transform("s", lambda s: s["x"]).alias("c"))


class Silhouettes:
    """Each point's silhouette while blocks pass by, for points whose clusters lie together in few blocks.

    A cluster's mean distance is taken as soon as all its points have passed (`size` says how many they are), so what is
    held for a point is its inner distance, the least outer one, and sums for the few clusters that are not through.
    """

    schema = "id long, score double"

    def start(self, a):
        n = len(a["id"])
        return {"inner": np.zeros(n), "outer": np.full(n, np.inf), "open": {}}

    def step(self, state, a, b):
        order = np.argsort(b["cluster"], kind="stable")
        kinds, first, counts = np.unique(b["cluster"][order], return_index=True, return_counts=True)
        sums = np.add.reduceat(distances(a["v"], b["v"][order]), first, axis=1)
        sizes = b["size"][order][first]
        self.through(state, a, kinds[counts == sizes], sums[:, counts == sizes], sizes[counts == sizes])
        for k in np.flatnonzero(counts < sizes):
            total, seen = state["open"].pop(kinds[k], (0.0, 0))
            total, seen = total + sums[:, k], seen + counts[k]
            if seen < sizes[k]:
                state["open"][kinds[k]] = (total, seen)
            else:
                self.through(state, a, kinds[k : k + 1], total[:, None], sizes[k : k + 1])

    def through(self, state, a, kinds, sums, sizes):
        if len(kinds):
            own = a["cluster"][:, None] == kinds[None, :]
            at, k = np.nonzero(own)
            state["inner"][at] = sums[at, k] / np.maximum(sizes[k] - 1, 1)
            state["outer"] = np.minimum(state["outer"], np.where(own, np.inf, sums / sizes[None, :]).min(1))

    def finish(self, state, a):
        inner, outer = state["inner"], state["outer"]
        top = np.maximum(inner, outer)
        some = np.isfinite(outer)
        score = np.where(some, np.where(top > 0, np.where(some, outer - inner, 0) / np.where(some & (top > 0), top, 1), 0.0), -1.0)
        return pd.DataFrame({"id": a["id"], "score": score})


def silhouette(points: DataFrame, block: int | None = None) -> DataFrame:
    """One row: the mean silhouette of points (id, v, cluster). A point alone in its cluster has inner distance 0; fewer than two clusters give -1.

    Points are dealt into blocks in order of their clusters: small clusters share a block, large ones have several of their own.
    """
    n = points.count()
    block = block or block_size(points, n)
    sizes = starts(points.groupBy("cluster").agg(F.count("*").alias("size")), "cluster", "size")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / F.lit(block)))
    rows = points.select("id", "v", "cluster").join(sizes, "cluster").withColumn("i", (F.floor(F.col("start") / F.lit(block)) + part).cast("int")).drop("start")
    packs = packed_by(rows)
    if n > FEW:
        packs = written(packs)
    count = 1 if n <= block else n // block + 2  # numbers up to this; some may have no points
    return folded(packs, all_asks(packs, count), Silhouettes(), count).agg(F.avg("score").alias("silhouette"))


# Models over any number of points: centres are on the driver, as they are few, and points never are.


def gap(v, centre: list[float]):
    """Distance of a column of points to one centre."""
    return F.sqrt(F.aggregate(F.zip_with(v, F.array(*map(F.lit, centre)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def with_nearest(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """The points with `cluster`, their nearest centre, and `gap`, its distance; lower numbers first among equals."""
    rows = points.withColumn("__d", F.array(*(gap(F.col("v"), c) for c in centres)))
    near = F.array_min("__d")
    return rows.withColumns({"cluster": F.array_position("__d", near) - 1, "gap": near}).drop("__d")


class Draws:
    """Weighted draws of single points: the smallest of exponential variates over weights, whose uniform parts are hashes of seed, draw and id."""

    def __init__(self, seed: int):
        self.seed, self.number = seed, 0

    def uniform(self):
        return (F.pmod(F.xxhash64(F.lit(self.seed), F.lit(self.number), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def one(self, points: DataFrame, weight=None) -> list[float]:
        """The place of a drawn point, in proportion to the weight; evenly where no weight is above 0."""
        found = None
        for w in (weight, F.lit(1.0)):
            if w is not None and not found:
                found = points.where(w > 0).agg(F.min(F.struct((-F.ln(self.uniform()) / w).alias("key"), "id", "v")).alias("b")).first()["b"]
        self.number += 1
        return list(found["v"])


def seeded(points: DataFrame, k: int, draws: Draws) -> list[list[float]]:
    """The densest point, then draws in proportion to density times the distance to the nearest chosen one."""
    rows = written(points.select("id", "v").join(density(points), "id"))
    centres = [list(rows.agg(F.min(F.struct((-F.col("density")).alias("less"), "id", "v")).alias("b")).first()["b"]["v"])]
    while len(centres) < k:
        far = F.array_min(F.array(*(gap(F.col("v"), c) for c in centres)))
        centres.append(draws.one(rows, F.col("density") * far))
    return centres


def fit_points(points: DataFrame, k: int, settings: Settings = Settings(), draws: Draws | None = None) -> DataFrame:
    """(id, cluster) of points (id, v) by the rules of `fit_k`, over any number of points."""
    draws, before = draws or Draws(settings.seed), np.inf
    points = written(points.select("id", "v"))
    centres = seeded(points, k, draws)
    for _ in range(settings.rounds):
        rows = with_nearest(points, centres)
        held = {r["cluster"] for r in rows.select("cluster").distinct().collect()}
        if len(held) < k:
            for c in sorted(set(range(k)) - held):
                far = with_nearest(points, centres).agg(F.max(F.struct("gap", (-F.col("id")).alias("last"), "v")).alias("b")).first()["b"]
                centres[c] = list(far["v"])
            rows = with_nearest(points, centres)
        labelled = written(rows.select("id", "v", F.col("cluster").cast("long").alias("cluster")))
        found = {r["k"]: list(r["c"]) for r in weighted_centres(labelled).collect()}
        centres = [found[c] if c in found else draws.one(points) for c in range(k)]
        far = F.array(*(gap(F.col("v"), c) for c in centres))
        total = labelled.agg(F.sum(F.pow(F.get(far, F.col("cluster").cast("int")), F.lit(2.0)))).first()[0] or 0.0
        if abs(before - total) < settings.tolerance:
            break
        before = total
    return labelled.select("id", "cluster")


def fit_best_points(points: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, int]:
    """((id, cluster), k) for the number of clusters with the best silhouette, the first of equals, on standardised points (id, v); few points are one cluster."""
    n = points.count()
    if n < settings.least_points:
        return points.select("id", F.lit(0).cast("long").alias("cluster")), 1
    most = min(settings.most_k, n // settings.least_points)
    if most < settings.least_k:
        raise ValueError(f"{n} points are too few for {settings.least_k} clusters: at least {settings.least_points * settings.least_k} are needed")
    z = z_scores(points, False).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "z"))).alias("s")).select("id", F.transform("s", lambda s: s["z"]).alias("v"))
    z, draws, best = written(z), Draws(settings.seed), (-np.inf, None, 0)
    for k in range(settings.least_k, most + 1):
        labels = fit_points(z, k, settings, draws)
        score = silhouette(z.join(labels, "id")).first()[0]
        if score > best[0]:
            best = (score, labels, k)
    return best[1], best[2]


# One image's regions, in numpy.


def seeded_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The densest point, then draws in proportion to density times the distance to the nearest chosen one."""
    h = max(1e-6, x.std() * len(x) ** (-1 / (x.shape[1] + 4)))
    dense = np.exp(-0.5 * (distances(x, x) / h) ** 2).sum(1)
    chosen = [int(dense.argmax())]
    while len(chosen) < k:
        p = dense * distances(x, x[chosen]).min(1)
        chosen.append(int(rng.choice(len(x), p=p / p.sum()) if p.sum() > 0 else rng.integers(len(x))))
    return x[chosen].copy()


def pulled_mean(x: np.ndarray) -> np.ndarray:
    d = distances(x, x)
    w = np.exp(-d / (np.median(d) + TINY)).sum(1)
    return (w[:, None] * x).sum(0) / w.sum()


def fit_k(x: np.ndarray, k: int, settings: Settings, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres); labels are those by which the centres last moved. Ends when the inertia changes by less than the tolerance.

    The centre of an empty cluster goes to the point farthest from all centres, and all points are assigned anew; if
    it stays empty its centre is drawn among the points. A point's torque scales all its distances alike, so the
    nearest centre is that with the least weighted distance.
    """
    centres, before = seeded_centres(x, k, rng), np.inf
    for _ in range(settings.rounds):
        labels = distances(x, centres).argmin(1)
        empty = np.setdiff1d(np.arange(k), labels)
        if len(empty):
            for c in empty:
                centres[c] = x[distances(x, centres).min(1).argmax()]
            labels = distances(x, centres).argmin(1)
        centres = np.stack([pulled_mean(x[labels == c]) if (labels == c).any() else x[rng.integers(len(x))] for c in range(k)])
        inertia = float(((x - centres[labels]) ** 2).sum())
        if abs(before - inertia) < settings.tolerance:
            break
        before = inertia
    return labels, centres


def plain_silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return -1.0
    d = distances(x, x)
    sums = np.stack([d[:, labels == c].sum(1) for c in kinds], 1)
    sizes = np.array([(labels == c).sum() for c in kinds])
    own = np.searchsorted(kinds, labels)
    inner = np.where(sizes[own] > 1, sums[np.arange(len(x)), own] / np.maximum(sizes[own] - 1, 1), 0.0)
    outer = sums / sizes
    outer[np.arange(len(x)), own] = np.inf
    b = outer.min(1)
    top = np.maximum(inner, b)
    return float(np.where(top > 0, (b - inner) / np.where(top > 0, top, 1), 0.0).mean())


def standardised(x: np.ndarray) -> np.ndarray:
    """Columns less their mean over their deviation, where they vary."""
    sd = x.std(0)
    return np.where(sd > 1e-10, (x - x.mean(0)) / np.where(sd > 1e-10, sd, 1), x)


def fit_fixed(x: np.ndarray, k: int, settings: Settings = Settings()) -> np.ndarray:
    """Labels of k clusters; fewer points than that are one cluster."""
    if len(x) < k:
        return np.zeros(len(x), np.int64)
    return fit_k(standardised(x), k, settings, np.random.default_rng(settings.seed))[0]


def fit_best(x: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """Labels of the number of clusters with the best silhouette; the first of equals."""
    n = len(x)
    if n < settings.least_points:
        return np.zeros(n, np.int64)
    most = min(settings.most_k, n // settings.least_points)
    if most < settings.least_k:
        raise ValueError(f"{n} points are too few for {settings.least_k} clusters: at least {settings.least_points * settings.least_k} are needed")
    x, rng, best = standardised(x), np.random.default_rng(settings.seed), (-np.inf, None)
    for k in range(settings.least_k, most + 1):
        labels, _ = fit_k(x, k, settings, rng)
        score = plain_silhouette(x, labels)
        if score > best[0]:
            best = (score, labels)
    return best[1]


def fit_images(regions: DataFrame, settings: Settings = Settings(), k: int | None = None) -> DataFrame:
    """(image, label, cluster) for regions (image, label, f array<double>): a model of its own for each image.

    With `k` every image has so many clusters. An image with too few regions to choose a number, 5 to 9 by default, has null clusters.
    """
    kind = regions.schema["image"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["image", "label"], kind="stable")
        starts = np.flatnonzero(np.diff(codes(pdf["image"]), prepend=-1))
        parts = []
        for x in np.split(np.stack(pdf["f"].to_numpy()).astype(float), starts[1:]):
            few = k is None and settings.least_points <= len(x) < settings.least_points * settings.least_k
            parts.append(np.full(len(x), np.nan) if few else (fit_best(x, settings) if k is None else fit_fixed(x, k, settings)))
        return pd.DataFrame({"image": pdf["image"], "label": pdf["label"], "cluster": pd.array(np.concatenate(parts), "Int64")})

    return over_images(regions.select("image", "label", "f"), run, f"image {kind}, label int, cluster long")
