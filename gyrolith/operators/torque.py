"""Torque clustering: masses, pulls between points, links to the nearest heavier point, and clusters.

Points are rows (id, v array<double>). What needs all pairs runs in blocks; everything else is joins and aggregates.
Ties in distance go to the smaller id.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from gyrolith.functions.blocks import CLOSE, ROWS, SLACK, at_ranks, gathered, medians, meetings, met, packed, readied, squares, unpacked
from gyrolith.functions.folds import FEW, MARGIN, MOST, SAMPLE, all_asks, beyond, block_size, folded, gaps, over_all, over_near
from gyrolith.sources.tables import removed, shared_folder, written

#: What pulls add to distances; squared norms from which on products in single precision aren't taken.
SMALL, LARGE = 1e-9, 1e30
#: Share of the ranks on each side of the middle of a sample's entries between which the median is looked for first.
ASIDE = 0.015
MASSES = ("uniform", "density", "feature_sum", "feature_variance")


def single(ready: tuple) -> np.ndarray:
    """The right side of `likely`, of what `readied` gives: twice the rows and their squared norms below 0, in single precision."""
    with np.errstate(over="ignore"):
        return np.vstack([2.0 * ready[1][:-2], -ready[2]]).astype(np.float32)


def likely(a: np.ndarray, ready: tuple, right: np.ndarray, most: np.ndarray) -> np.ndarray | None:
    """Which pairs can be within `most` of each other, by products in single precision; None for values that these can't hold.

    2 p q - q² is at least p² - most² for such pairs, less what sums of so many terms can lose to rounding. So none is missed.
    """
    centre, _, n = ready
    with np.errstate(over="ignore", invalid="ignore"):
        p = a - centre
        m = np.einsum("ij,ij->i", p, p)
        largest = n.max(initial=0.0)
        if not m.max(initial=0.0) + largest < LARGE:
            return None
        loss = (p.shape[1] + 16) * float(np.finfo(np.float32).eps) * (m + 2.0 * largest) + 1.0 / LARGE
        least = (m - most**2 * (1 + SLACK) - loss).astype(np.float32)
        least = np.nextafter(least, np.float32(-np.inf))
    return np.column_stack([p, np.ones(len(p))]).astype(np.float32) @ right >= least[:, None]


def nearer(a: np.ndarray, b: dict, k: int, most: np.ndarray, able: np.ndarray | None = None, ready: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distances, places in b) of the up to k nearest points of block b within `most` of points `a`, smaller ids first among equals; inf where there are fewer.

    Products say which points can be among them, in single precision where that leaves few; distances by differences decide.
    """
    if ready is None:
        ready = readied(b["v"])
        ready = ready, single(ready)
    if len(a) > ROWS:
        cut = [slice(r, r + ROWS) for r in range(0, len(a), ROWS)]
        return tuple(np.concatenate(x) for x in zip(*(nearer(a[c], b, k, most[c], None if able is None else able[c], ready) for c in cut), strict=True))
    hit = likely(a, *ready, most) if np.isfinite(most).any() else None
    if hit is not None and able is not None:
        hit &= able
    if hit is None or np.count_nonzero(hit) > max(32, 4 * k) * len(a):
        s = squares(a, b["v"], ready[0])[0]
        if able is not None:
            s[~able] = np.inf
        limit = most**2 * (1 + SLACK)
        hit = s <= limit[:, None]
        if np.count_nonzero(hit) > 4 * k * len(a) and s.shape[1] > k:
            limit = np.minimum(limit, np.partition(s, k - 1, axis=1)[:, k - 1] * (1 + SLACK))
            hit = s <= limit[:, None]
        if able is not None:
            hit &= able
    row, at = np.divmod(np.flatnonzero(hit), max(1, hit.shape[1]))
    d = np.sqrt(gathered(a, row, b["v"], at))
    some = d <= most[row] * (1 + SLACK)
    row, at, d = row[some], at[some], d[some]
    order = np.lexsort((at, d, row))  # a block's points are in order of their ids
    row, at, d = row[order], at[order], d[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, at, d, place = (x[place < k] for x in (row, at, d, place))
    near, places = np.full((len(a), k), np.inf), np.zeros((len(a), k), np.int64)
    near[row, place], places[row, place] = d, at
    return near, places


class Nearest:
    """The k nearest points of each point, itself among them, with columns that are wanted of them."""

    schema = "id long, d double, j long, rank int"

    def __init__(self, k: int):
        self.k = k

    def start(self, a):
        n = len(a["id"])
        return {"d": np.full((n, self.k), np.inf), "j": np.full((n, self.k), np.iinfo(np.int64).max), "v": np.zeros((n, self.k, 0)), "m": np.zeros((n, self.k))}

    def step(self, state, a, b):
        rows = np.arange(len(a["id"]))
        if "centre" in b and a is not b:
            rows = np.flatnonzero(beyond(gaps(a["v"], b["centre"][None])[:, 0], b["radius"]) <= state["d"][:, -1])
        if not len(rows):
            return
        d, at = nearer(a["v"][rows], b, self.k, state["d"][rows, -1])
        some = np.isfinite(d[:, 0])
        rows, d, at = rows[some], d[some], at[some]
        d, j = np.hstack([state["d"][rows], d]), np.hstack([state["j"][rows], b["id"][at]])
        best = np.lexsort((j, d), axis=-1)[:, : self.k]
        state["d"][rows], state["j"][rows] = np.take_along_axis(d, best, 1), np.take_along_axis(j, best, 1)
        self.carry(state, rows, best, at, b)

    def carry(self, state, rows, best, at, b):
        """Nothing but ids and distances are kept of the others."""

    def bounds(self, state, a):
        return state["d"][:, -1]

    def narrowed(self, bounds, a, summaries, centres):
        whole = np.where(summaries["size"] >= self.k, (centres + summaries["radius"]) * (1 + MARGIN), np.inf)
        return np.minimum(bounds, whole.min(1))

    def matters(self, a, summaries):
        return None

    def finish(self, state, a):
        row, rank = np.nonzero(np.isfinite(state["d"]))
        return pd.DataFrame({"id": a["id"][row], "d": state["d"][row, rank], "j": state["j"][row, rank], "rank": rank.astype(np.int32)})


def nearest_rows(points: DataFrame, k: int, block: int | None = None, few: int = FEW) -> DataFrame:
    """(id, d, j, rank): the k + 1 nearest points of each point, itself among them, with their rank from 0."""
    return over_near(points.select("id", "v"), Nearest(k + 1), block, few)


def mass(points: DataFrame, method: str = "density", k: int = 5) -> DataFrame:
    """(id, m). All but uniform masses sum to 1; with a sum of 0 every point gets 1 / n."""
    if method == "uniform":
        return points.select("id", F.lit(1.0).alias("m"))
    if method == "density":  # the smallest distance, in general that to itself, is dropped
        raw = nearest_rows(points, k).groupBy("id").agg(F.avg(F.when(F.col("rank") > 0, F.col("d"))).alias("d")).select("id", (1 / (F.coalesce("d", F.lit(0.0)) + SMALL)).alias("raw"))
    elif method == "feature_sum":
        raw = points.select("id", F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)).alias("raw"))
    elif method == "feature_variance":
        mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
        raw = points.withColumn("__mean", mean).select("id", (F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("__mean")) * (x - F.col("__mean"))) / F.size("v")).alias("raw"))
    else:
        raise ValueError(f"mass method must be one of {MASSES}")
    raw = written(raw)
    total = F.broadcast(raw.agg(F.sum("raw").alias("total"), F.count("*").alias("n")))  # one row
    return raw.crossJoin(total).select("id", F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(1.0 / F.col("n")).alias("m"))


class Summary:
    """The nearest and farthest of each point's distances to all others, and their sum."""

    schema = "id long, nearest double, farthest double, total double"

    def start(self, a):
        n = len(a["id"])
        return {"nearest": np.full(n, np.nan), "farthest": np.zeros(n), "total": np.zeros(n)}

    def step(self, state, a, b):
        alike, ready = np.isin(a["id"], b["id"]).any(), readied(b["v"])
        for k in range(0, len(a["id"]), ROWS):
            own = slice(k, k + ROWS)
            d = squares(a["v"][own], b["v"], ready)[0]
            np.sqrt(d, out=d)
            state["farthest"][own] = np.maximum(state["farthest"][own], d.max(1))
            state["total"][own] += d.sum(1)
            if alike:
                d[a["id"][own][:, None] == b["id"][None, :]] = np.inf
            state["nearest"][own] = np.fmin(state["nearest"][own], d.min(1))  # undefined only where all are

    def finish(self, state, a):
        return pd.DataFrame({"id": a["id"], **state})


def distance_summary(points: DataFrame, block: int | None = None) -> DataFrame:
    """(id, nearest, farthest, total): each point's distances to all others."""
    rows = over_all(points.select("id", "v"), Summary(), block)
    return rows.groupBy("id").agg(F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"), F.sum("total").alias("total"))


class Pull:
    """The sum over others of m / (d ** power + 1e-9) times the difference, one row a point."""

    schema = "id long, t array<double>"

    def __init__(self, power: float):
        self.power = power

    def start(self, a):
        return np.zeros(a["v"].shape)

    def step(self, state, a, b):
        """Weights of far points come from products, in place; close ones, with their large weights, are taken by differences and lose no digits."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            centre, alike = b["v"].mean(0), np.isin(a["id"], b["id"]).any()
            q = b["v"] - centre
            n = np.einsum("ij,ij->i", q, q)
            right, weights = np.vstack([-2.0 * q.T, np.ones(len(q)), n]), b["m"][:, None] * np.column_stack([q, np.ones(len(q))])
            most, sound, room = n.max(initial=0.0), np.isfinite(n.sum()), np.empty((min(ROWS, len(a["id"])), len(q)))
            for k in range(0, len(a["id"]), ROWS):
                v, ids, own = a["v"][k : k + ROWS], a["id"][k : k + ROWS], state[k : k + ROWS]
                p = v - centre
                m = np.einsum("ij,ij->i", p, p)
                if not (sound and np.isfinite(m.sum())):  # values that are not finite, or too large
                    i, j = (x.ravel() for x in np.indices((len(v), len(q))))
                    self.near(own, v, ids, b, i, j, alike)
                    continue
                w = np.matmul(np.column_stack([p, m + (SMALL if self.power == 2 else 0.0), np.ones(len(p))]), right, out=room[: len(p)])
                i, j = np.divmod(np.flatnonzero(w <= (CLOSE * (m + most) + SMALL)[:, None]), len(q))
                close = w[i, j] <= CLOSE * (m[i] + n[j]) + SMALL
                i, j = i[close], j[close]
                if len(i):
                    self.near(own, v, ids, b, i, j, alike)
                    w[i, j] = np.inf
                if alike:
                    w[ids[:, None] == b["id"][None, :]] = np.inf
                if self.power != 2:
                    np.power(w, self.power / 2, out=w)
                    w += SMALL
                np.divide(1.0, w, out=w)
                far = w @ weights
                own += far[:, :-1] - far[:, -1:] * p

    def near(self, own, v, ids, b, i, j, alike):
        """Adds the pulls of points j of b on points i, which are in order."""
        some = max(64, (1 << 15) // max(1, v.shape[1]))
        for k in range(0, len(i), some):
            x, y = i[k : k + some], j[k : k + some]
            d = b["v"][y] - v[x]
            w = np.einsum("ij,ij->i", d, d)
            if self.power != 2:
                np.power(w, self.power / 2, out=w)
            w = b["m"][y] / (w + SMALL)
            if alike:
                w[ids[x] == b["id"][y]] = 0.0
            first = np.flatnonzero(np.diff(x, prepend=-1))
            own[x[first]] += np.add.reduceat(d * w[:, None], first, axis=0)

    def pulls(self, state, a) -> np.ndarray:
        return state

    def finish(self, state, a):
        return pd.DataFrame({"id": a["id"], "t": list(self.pulls(state, a))})


class NearPull(Nearest):
    """The pull of the next so many after the nearest point (in general the point itself), as a weighted mean."""

    schema = Pull.schema
    most = 4  # blocks with the places of their neighbours

    def __init__(self, power: float, neighbours: int):
        super().__init__(neighbours + 1)
        self.power = power

    def start(self, a):
        state = super().start(a)
        state["v"] = np.zeros((*state["d"].shape, a["v"].shape[1]))
        return state

    def carry(self, state, rows, best, at, b):
        state["m"][rows] = np.take_along_axis(np.hstack([state["m"][rows], b["m"][at]]), best, 1)
        state["v"][rows] = np.take_along_axis(np.concatenate([state["v"][rows], b["v"][at]], 1), best[:, :, None], 1)

    def pulls(self, state, a):
        known = np.isfinite(state["d"][:, 1:])
        w = np.where(known, state["m"][:, 1:] / (np.where(known, state["d"][:, 1:], 1.0) ** self.power + SMALL), 0.0)
        total = w.sum(1)
        t = np.einsum("ij,ijk->ik", w, state["v"][:, 1:] - a["v"][:, None])
        return t / np.where(total > 0, total, 1.0)[:, None]

    def finish(self, state, a):
        return pd.DataFrame({"id": a["id"], "t": list(self.pulls(state, a))})


def pull(power: float, neighbours: int | None):
    return Pull(power) if neighbours is None else NearPull(power, neighbours)


def torque(points: DataFrame, power: float = 2.0, neighbours: int | None = None, block: int | None = None) -> DataFrame:
    """(id, t array<double>) for points (id, v, m): the sum over others of m / (d ** power + 1e-9) times the difference.

    With `neighbours`, only the next so many after the nearest (in general the point itself), as a weighted mean.
    """
    over = over_all if neighbours is None else over_near
    return over(points.select("id", "v", "m"), pull(power, neighbours), block)


class Heavier:
    """The nearest point of strictly greater mass."""

    schema = "id long, d double, j long"

    def start(self, a):
        n = len(a["id"])
        return {"d": np.full(n, np.inf), "j": np.full(n, np.iinfo(np.int64).max)}

    def step(self, state, a, b):
        may = a["m"] < b["m"].max(initial=-np.inf)
        if "centre" in b and a is not b:
            may &= beyond(gaps(a["v"], b["centre"][None])[:, 0], b["radius"]) <= state["d"]
        rows = np.flatnonzero(may)
        if len(rows):
            d, at = nearer(a["v"][rows], b, 1, state["d"][rows], b["m"][None, :] > a["m"][rows, None])
            d, j = d[:, 0], b["id"][at[:, 0]]
            better = (d < state["d"][rows]) | ((d == state["d"][rows]) & np.isfinite(d) & (j < state["j"][rows]))
            state["d"][rows[better]], state["j"][rows[better]] = d[better], j[better]

    def bounds(self, state, a):
        return state["d"]

    def narrowed(self, bounds, a, summaries, centres):
        """The heaviest point of a block is a heavier one for many points of others."""
        tops = np.where(summaries["mass"][None, :] > a["m"][:, None], gaps(a["v"], summaries["top"]) * (1 + MARGIN), np.inf)
        return np.minimum(bounds, tops.min(1))

    def matters(self, a, summaries):
        return summaries["mass"][None, :] > a["m"][:, None]

    def finish(self, state, a):
        ok = np.isfinite(state["d"])
        return pd.DataFrame({"id": a["id"][ok], "d": state["d"][ok], "j": state["j"][ok]})


def nearest_heavier(points: DataFrame, block: int | None = None, few: int = FEW) -> DataFrame:
    """(id, parent, d) for points (id, v, m): the nearest of strictly greater mass; null where there is none."""
    best = over_near(points.select("id", "v", "m"), Heavier(), block, few)
    return points.select("id").join(best, "id", "left").select("id", F.col("j").alias("parent"), "d")


def edge_torques(points: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, parent, d, torque): m_i m_j / (d² + 1e-9) of each link."""
    m = points.select("id", "m")
    rows = parents.where("parent IS NOT NULL").join(m, "id").join(m.select(F.col("id").alias("parent"), F.col("m").alias("pm")), "parent")
    return rows.select("id", "parent", "d", (F.col("m") * F.col("pm") / (F.col("d") * F.col("d") + SMALL)).alias("torque"))


def pair_torques(a, b, d) -> np.ndarray:
    """Entries of the torque matrix; the diagonal is large, as its distances are 0."""
    return a["m"][:, None] * b["m"][None, :] / (d**2 + SMALL)


def near_torques(a, b, least: float, most: float) -> tuple[int, np.ndarray] | None:
    """(how many entries are below `least` for certain, the entries that may be from `least` to `most`); None for values that single precision can't hold.

    An entry is below x where (d² + 1e-9) / m_b is above m_a / x. Products in single precision say so, less what their sums can lose to rounding.
    """
    most = np.inf if np.isnan(most) else most
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        centre = b["v"].mean(0)
        q = b["v"] - centre
        n, light = np.einsum("ij,ij->i", q, q), b["m"].min(initial=np.inf)
        share = light / b["m"]
        largest = n.max(initial=0.0)
        right = (np.vstack([-2.0 * q.T, np.ones(len(q)), n]) * share).astype(np.float32)
        below, found = 0, []
        for k in range(0, len(a["v"]), ROWS):
            v, mass = a["v"][k : k + ROWS], a["m"][k : k + ROWS]
            p = v - centre
            m = np.einsum("ij,ij->i", p, p) + SMALL
            if not (m.max(initial=0.0) + largest < LARGE and 0 < light < np.inf and mass.min() > 0):
                return None
            loss = 2 * (p.shape[1] + 18) * float(np.finfo(np.float32).eps) * (m + largest) + 1.0 / LARGE
            high = np.nextafter((light * mass / least * (1 + SLACK) + loss).astype(np.float32), np.float32(np.inf))
            low = np.nextafter((light * mass / most * (1 - SLACK) - loss).astype(np.float32), np.float32(-np.inf))
            w = np.column_stack([p, m, np.ones(len(p))]).astype(np.float32) @ right
            sure = w > high[:, None]
            below += int(np.count_nonzero(sure))
            i, j = np.divmod(np.flatnonzero((w >= low[:, None]) ^ sure), w.shape[1])
            found.append(mass[i] * b["m"][j] / (gathered(v, i, b["v"], j) + SMALL))
    return below, np.concatenate(found)


def mean_torque(points: DataFrame) -> float:
    """Mean of the n² entries; a task adds its pairs of blocks up."""
    points = points.select("id", "v", "m")
    n = points.count()
    block = block_size(points, n)

    def part(batches):
        total, size = 0.0, 0
        for _, two, a, b in met(batches):
            ready, times = readied(b["v"]), 2 if two else 1
            for k in range(0, len(a["v"]), ROWS):
                d = squares(a["v"][k : k + ROWS], b["v"], ready)[0]
                d += SMALL
                np.divide(b["m"], d, out=d)
                total += times * float(a["m"][k : k + ROWS] @ d.sum(1))
            size += times * len(a["v"]) * len(b["v"])
        yield pd.DataFrame({"total": [total], "size": [size]})

    rows = meetings(packed(points, block, n=n), -(-n // block) or 1)
    return rows.mapInPandas(part, "total double, size long").agg(F.sum("total") / F.sum("size")).first()[0]


def median_torque(points: DataFrame) -> float:
    """Exact median of the n² entries, without gathering them.

    With many points it is looked for first between two ranks of the entries among a sample, and wherever else it is if it isn't there.
    """
    points = points.select("id", "v", "m")
    n, window = points.count(), None
    block, span = block_size(points, n), 1 << 30
    if n > 2 * SAMPLE:
        some = written(points.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(span)) < span * SAMPLE // n))
        own = block_size(some, SAMPLE)
        ranks = [f"CAST(s * {x} AS BIGINT)" for x in (0.5 - ASIDE, 0.5 + ASIDE)]
        ends = [r["x"] for r in at_ranks(some, written(packed(some, own)), pair_torques, ranks, (), own).collect()]  # two rows
        if ends and 0 < min(ends) and max(ends) < np.inf:
            window = min(ends), float(np.nextafter(max(ends), np.inf))
    return medians(points, pair_torques, block=block, near=near_torques if window else None, window=window).first()["mid"]


def threshold_of(points: DataFrame, threshold: str | float) -> float:
    if isinstance(threshold, str):
        if threshold not in ("median", "mean"):
            raise ValueError("threshold must be 'median', 'mean' or a number")
        return median_torque(points) if threshold == "median" else mean_torque(points)
    return float(threshold)


def subtree_minima(forest: DataFrame) -> DataFrame:
    """(id, least) for rows (id, parent): the smallest id below each node, itself included, by doubling jumps.

    After k steps `least` covers descendants less than 2 ** k levels below and `up` is the ancestor 2 ** k levels above.
    """
    state, folder, step = forest.select("id", F.col("id").alias("least"), F.col("parent").alias("up")), shared_folder(forest.sparkSession), 0
    state = written(state, f"{folder}/0")
    while state.where("up IS NOT NULL").limit(1).count():
        step += 1
        below = state.where("up IS NOT NULL").groupBy("up").agg(F.min("least").alias("below")).withColumnRenamed("up", "id")
        jump = state.select(F.col("id").alias("up"), F.col("up").alias("far"))
        state = written(state.join(below, "id", "left").join(jump, "up", "left").select("id", F.least("least", "below").alias("least"), F.col("far").alias("up")), f"{folder}/{step}")
    return state.select("id", "least")


def dense_index(values: DataFrame, column: str) -> DataFrame:
    """(column, index from 0) of the distinct values in order; ranges are numbered apart and then shifted."""
    ranged = written(values.select(column).distinct().repartitionByRange(F.col(column)).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").count()  # a row for each partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(sizes.select("__part", before.alias("__before")))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return ranged.withColumn("__at", place).join(shift, "__part").select(column, (F.col("__at") + F.col("__before")).cast("long").alias("index"))


def walk_labels(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster) when walks start at each point in order of id, follow the links, and stop at points already met.

    Such a walk gives a point the cluster of the smallest id below it, and clusters are numbered in the order of those ids.
    """
    least = subtree_minima(ids.select("id").join(links.select("id", "parent"), "id", "left"))
    return least.join(dense_index(least, "least"), "least").select("id", F.col("index").alias("cluster"))


def connection_clusters(points: DataFrame, threshold: str | float = "median") -> DataFrame:
    """(id, cluster) for points (id, v, m): links to the nearest heavier point, without those whose torque is above the threshold."""
    parents = written(nearest_heavier(points))
    links = edge_torques(points, parents).where(F.col("torque") <= threshold_of(points, threshold))
    return walk_labels(points, links)


class Step:
    """One step of all points of a block along their pull: the block anew, and how far its points went."""

    schema = "i int, data binary, far double"

    def __init__(self, rate: float, pull):
        self.rate, self.pull, self.start, self.step = rate, pull, pull.start, pull.step
        self.most = getattr(pull, "most", MOST)

    def finish(self, state, a):
        move = self.rate * self.pull.pulls(state, a)
        return pd.DataFrame({"i": [a["i"]], "data": [pickle.dumps({**a, "v": a["v"] + move}, 5)], "far": [float(np.square(move).sum())]})


def iterate(points: DataFrame, rate: float = 0.01, power: float = 2.0, neighbours: int | None = None, rounds: int = 100, tolerance: float = 1e-4, block: int | None = None) -> DataFrame:
    """Positions after at most `rounds` steps; stops from the second on when the norm of the whole move over n is below the tolerance.

    Points are packed into blocks once; a round reads the blocks of the one before, writes them moved, and removes those.
    """
    spark, folder, n = points.sparkSession, shared_folder(points.sparkSession), points.count()
    block = block or block_size(points, n)
    count, pulls = -(-n // block) or 1, pull(power, neighbours)
    packs = written(packed(points.select("id", "v", "m"), block, n=n).select("i", "data"), f"{folder}/0")
    for k in range(1, rounds + 1):
        seen = Observation()  # the norm comes with the write
        packs = written(folded(packs.select("i", "data"), all_asks(packs, count), Step(rate, pulls), count).observe(seen, F.sum("far").alias("far")), f"{folder}/{k}")
        removed(spark, f"{folder}/{k - 1}")
        far = seen.get["far"] or 0.0
        if k > 1 and far**0.5 / max(1, n) < tolerance:
            break

    def rows(batches):
        for batch in batches:
            for data in batch["data"]:
                a = unpacked(data)
                yield pd.DataFrame({"id": a["id"], "v": list(a["v"]), "m": a["m"]})

    return packs.select("data").mapInPandas(rows, f"id {points.schema['id'].dataType.simpleString()}, v array<double>, m double")


def coincident_labels(points: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id among points at the same place."""

    near = nearest_rows(points, 0).select("id", "j")
    return points.select("id").join(near, "id", "left").select("id", F.coalesce("j", "id").alias("cluster"))


def kmeans_labels(points: DataFrame, k: int, seed: int = 42, tries: int = 4) -> DataFrame:
    """(id, cluster) by k-means on the positions: of some tries the one of least cost, as a single one depends on how rows happen to lie in partitions."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = written(points.select("id", array_to_vector("v").alias("features")).repartitionByRange("id").sortWithinPartitions("id"))
    models = [KMeans(k=k, seed=seed + t, initMode="k-means||").fit(rows) for t in range(tries)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("id", F.col("prediction").cast("long").alias("cluster"))


def cluster(points: DataFrame, method: str = "connection", mass_method: str = "density", n_clusters: int | None = None, threshold: str | float = "median", **steps) -> tuple[DataFrame, DataFrame | None]:
    """(labels, positions or None) of points (id, v), by either method."""
    weighed = written(points.select("id", "v").join(mass(points, mass_method), "id"))
    if method == "connection":
        return connection_clusters(weighed, threshold), None
    if method != "iterative":
        raise ValueError("method must be 'iterative' or 'connection'")
    places = iterate(weighed, **steps)
    return (kmeans_labels(places, n_clusters) if n_clusters else coincident_labels(places)), places


def agreement(labels: DataFrame, truth: str = "truth", found: str = "found") -> DataFrame:
    """One row (n, ari, nmi): adjusted Rand index and normalised mutual information of two labellings."""
    cells = labels.groupBy(truth, found).agg(F.count("*").alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    side = lambda c, k: cells.groupBy(c).agg(F.sum("n").alias("s")).agg(F.sum(pairs("s")).alias(f"p{k}"), F.sum(F.col("s") * F.ln("s")).alias(f"h{k}"))
    both = cells.agg(F.sum("n").alias("n"), F.sum(pairs("n")).alias("p"), F.sum(F.col("n") * F.ln("n")).alias("h"))
    row = both.crossJoin(side(truth, 1)).crossJoin(side(found, 2))  # one row each
    expected = F.try_divide(F.col("p1") * F.col("p2"), pairs("n"))
    ari = F.coalesce(F.try_divide(F.col("p") - expected, (F.col("p1") + F.col("p2")) / 2 - expected), F.lit(1.0))
    total = F.col("n") * F.ln("n")
    # With sums of s ln s: entropy times n is n ln n - h, and mutual information times n is n ln n + h - h1 - h2.
    nmi = F.coalesce(F.try_divide(total + F.col("h") - F.col("h1") - F.col("h2"), (2 * total - F.col("h1") - F.col("h2")) / 2), F.lit(1.0))
    return row.select("n", ari.alias("ari"), nmi.alias("nmi"))
