"""Every block of points against others, folded in one task per block, so that results leave as one row a point.

A fold holds one block's points and its partial result while the other blocks pass by, its own first. Tasks hold a group of blocks; blocks are
copied once to each group that needs them and nothing comes back but results: no partial sums are shuffled and no pair is a row.

A fold that looks for near points needs few of the other blocks if points lie close to those of their own block. So `celled`
deals points by a tree of halvings made from a bounded sample, gives every block a ball that encloses it, and lets the fold say, from its own
block alone, how far each of its points must look at most. Blocks are then asked for only where a point's bound reaches their ball; and while
blocks pass by, points whose bound has shrunk leave them out too. Bounds carry a margin for rounding, and distances that
decide are those between points, so results are those of all pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.functions.blocks import BLOCK, Points, packed, short, unpacked
from gyrolith.sources.tables import shared_folder, written

#: Points that a tree of cells is made from, about; points of a cell in it at least; summaries of blocks that meet a block at once.
SAMPLE, CELL_SAMPLE, SUMMARIES = 16_384, 16, 2048
#: Points up to which every block meets every other.
FEW = 8 * BLOCK
#: Groups of blocks for each core, and blocks that a task holds at most.
GROUPS, MOST = 4, 16
#: Share of a distance that rounding may take.
MARGIN = 1e-9


class Fold(Protocol):
    """What is done with a block `a` while blocks `b` pass by, `a` itself first."""

    schema: str

    def start(self, a: Points): ...
    def step(self, state, a: Points, b: Points) -> None: ...
    def finish(self, state, a: Points) -> pd.DataFrame: ...


class NearFold(Fold, Protocol):
    """A fold that can do without blocks that are far from all its points."""

    def bounds(self, state, a: Points) -> np.ndarray:
        """How far each point must look at most, after some blocks have passed."""

    def narrowed(self, bounds: np.ndarray, a: Points, summaries: dict[str, np.ndarray], centres: np.ndarray) -> np.ndarray:
        """The bounds, smaller where what is known of other blocks (`centres`: distances to their centres) shows it."""

    def matters(self, a: Points, summaries: dict[str, np.ndarray]) -> np.ndarray | None:
        """Which blocks can matter at all to which points; None for all to all."""


def block_size(points: DataFrame, n: int) -> int:
    """Points of a block: few enough for two blocks a core where there are few points, and never more than BLOCK."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    return max(64, min(BLOCK, -(-n // (2 * cores))))


def gaps(a: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances between rows of two arrays, by differences."""
    out = np.empty((len(a), len(centres)))
    for k, c in enumerate(centres):
        d = a - c
        np.einsum("ij,ij->i", d, d, out=out[:, k])
    return np.sqrt(out, out=out)


def beyond(distance: np.ndarray, radius) -> np.ndarray:
    """The least distance that a point at `distance` from a ball's centre can have to anything in it."""
    return distance - radius - MARGIN * (distance + radius)


# Blocks dealt by place


class Tree:
    """Halvings of a sample by planes, down to `leaves` cells; equal points stay together."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[np.ndarray, float, int, int] | int] = []
        self.leaves = 0
        self._grow(sample, min(leaves, max(1, len(sample) // CELL_SAMPLE)))

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(0)
        if leaves > 1:
            p = x[np.square(x - x.mean(0)).sum(1).argmax()]
            q = x[np.square(x - p).sum(1).argmax()]
            along = x @ (q - p)
            order = np.argsort(along, kind="stable")
            half = len(x) * (leaves // 2) // leaves
            cut = (along[order[half - 1]] + along[order[half]]) / 2
            low = along <= cut
            if 0 < low.sum() < len(x):
                left = self._grow(x[low], leaves // 2)
                right = self._grow(x[~low], leaves - leaves // 2)
                self.nodes[at] = (q - p, cut, left, right)
                return at
        self.nodes[at] = self.leaves
        self.leaves += 1
        return at

    def cells(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                low = x[rows] @ node[0] <= node[1]
                todo += [(node[2], rows[low]), (node[3], rows[~low])]
        return out


def in_cells(points: DataFrame, block: int, n: int) -> DataFrame:
    """The points with their block `i`: the cell of the tree, and parts of it by a hash where it has more points than a block."""
    if n <= block:
        return points.withColumn("i", F.lit(0))
    span = 1 << 30
    some = points.where(F.pmod(F.xxhash64("id"), F.lit(span)) < min(span, span * SAMPLE // n)).select("v").limit(2 * SAMPLE).collect()
    tree = Tree(np.array([r["v"] for r in some], float).reshape(len(some), -1), -(-n // block))

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(tree.cells(np.stack(v.to_numpy()).astype(float))) if len(v) else pd.Series([], dtype="int32")

    rows = points.withColumn("cell", cell("v"))
    sizes = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most SAMPLE / CELL_SAMPLE rows, and twice that
    parts, first, at = [], [], 0
    for c in range(tree.leaves):
        parts.append(max(1, -(-sizes.get(c, 0) // block)))
        first.append(at)
        at += parts[-1]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    return rows.withColumn("i", (of(first) + F.pmod(F.xxhash64("id"), of(parts))).cast("int")).drop("cell")


def summed(fold: NearFold):
    """Packs one block: points in order of their ids, the ball around them, each point's bound, and a summary for other blocks."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        held = {c: table[c].to_numpy() for c in table.column_names if c not in ("i", "v")}
        held["v"] = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1)
        centre = (held["v"].min(0) + held["v"].max(0)) / 2
        held["centre"], held["radius"] = centre, float(gaps(held["v"], centre[None])[:, 0].max())
        state = fold.start(held)
        fold.step(state, held, held)
        summary = {"i": table["i"][0].as_py(), "centre": centre, "radius": held["radius"], "size": len(table)}
        if "m" in held:
            top = int(held["m"].argmax())
            summary |= {"top": held["v"][top], "mass": float(held["m"][top])}
        held["bound"] = fold.bounds(state, held)
        return pa.table({"i": table["i"].slice(0, 1), "data": pa.array([pickle.dumps(held | {"v": short(held["v"])}, 5)], pa.binary()), "summary": pa.array([pickle.dumps(summary, 5)], pa.binary())})

    return pack


def celled(points: DataFrame, fold: NearFold, block: int | None = None) -> tuple[DataFrame, DataFrame | None, int]:
    """(blocks, asks, their number): blocks (i, data) of points near each other, and (i, j) for each block j that a point of block i needs; None for one block."""
    n, folder = points.count(), shared_folder(points.sparkSession)
    rows = in_cells(points, block or block_size(points, n), n)
    packs = written(rows.groupBy("i").applyInArrow(summed(fold), "i int, data binary, summary binary"), f"{folder}/packs")

    def together(table: pa.Table) -> pa.Table:
        each = [pickle.loads(s.as_py()) for s in table["summary"]]
        return pa.table({"g": table["g"].slice(0, 1), "summaries": pa.array([pickle.dumps({k: np.array([s[k] for s in each]) for k in each[0]}, 5)], pa.binary())})

    count = packs.count()
    if count <= 1:
        return packs.select("i", "data"), None, count
    groups = -(-count // SUMMARIES)
    grouped = packs.select((F.col("i") % groups).alias("g"), "summary").groupBy("g").applyInArrow(together, "g int, summaries binary")
    pairs = packs.select("data", "i", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")).join(grouped, "g").select("i", "data", "summaries")

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, data, summaries in zip(batch["i"], batch["data"], batch["summaries"], strict=True):
                a, s = unpacked(data), pickle.loads(summaries)
                centres = gaps(a["v"], s["centre"])
                near = beyond(centres, s["radius"][None, :]) <= fold.narrowed(a["bound"], a, s, centres)[:, None]
                able = fold.matters(a, s)
                need = (near if able is None else near & able).any(0) & (s["i"] != i)
                yield pd.DataFrame({"i": np.full(need.sum(), i, np.int32), "j": s["i"][need].astype(np.int32)})

    return packs.select("i", "data"), written(pairs.mapInPandas(asked, "i int, j int"), f"{folder}/asks"), count


def all_asks(packs: DataFrame, count: int) -> DataFrame | None:
    """(i, j) of every two of so many blocks; None for one block."""
    if count <= 1:
        return None
    return packs.select("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("j")).where("i <> j")


def group_size(count: int, cores: int, fold: Fold) -> int:
    """Blocks that a task holds at once: few enough for GROUPS groups a core, and never more than the fold can hold."""
    return max(1, min(getattr(fold, "most", MOST), -(-count // (GROUPS * cores))))


def folded(packs: DataFrame, asks: DataFrame | None, fold: Fold, count: int, group: int | None = None) -> DataFrame:
    """The results of the fold over each of `count` blocks and those that it asks for.

    A task holds a group of blocks while others pass by, so a block is copied once for each group and not for each block that asks for it.
    """
    none, spark = F.array().cast("array<int>"), packs.sparkSession
    group = group or group_size(count, spark.sparkContext.defaultParallelism, fold)
    of = lambda c: F.floor(F.col(c) / F.lit(group)).cast("int").alias("g")
    rows = packs.select(of("i"), F.col("i").alias("j"), none.alias("who"), "data")
    if asks is not None:
        wanted = asks.groupBy(of("i"), "j").agg(F.sort_array(F.collect_list("i")).alias("who"))
        others = wanted.hint("merge").join(packs.select(F.col("i").alias("j"), "data"), "j").select("g", "j", "who", "data")
        groups = -(-count // group)
        parts = min(groups, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        rows = rows.unionByName(others).repartitionById(parts, F.col("g") % parts)
    rows = rows.sortWithinPartitions("g", F.size("who") > 0, "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for batch in batches:
            for g, j, who, data in zip(batch["g"], batch["j"], batch["who"], batch["data"], strict=True):
                b = unpacked(data)
                if g != at:
                    yield from (fold.finish(state, a) for a, state in held.values())
                    at, held = g, {}
                if not len(who):  # one of the group's own, which come first, meets itself
                    held[j] = b, fold.start(b)
                    fold.step(held[j][1], b, b)
                for i in who:
                    fold.step(held[i][1], held[i][0], b)
        yield from (fold.finish(state, a) for a, state in held.values())

    return rows.mapInPandas(run, fold.schema)


def over_all(points: DataFrame, fold: Fold, block: int | None = None) -> DataFrame:
    """The fold over all pairs of blocks."""
    n = points.count()
    block = block or block_size(points, n)
    count = -(-n // block) or 1
    packs = packed(points, block, n=n).select("i", "data")
    if n > FEW:
        packs = written(packs)
    return folded(packs, all_asks(packs, count), fold, count)


def over_near(points: DataFrame, fold: NearFold, block: int | None = None, few: int = FEW) -> DataFrame:
    """The fold over the pairs of blocks that can matter; over all of them for few points, where finding out which costs more."""
    if points.count() <= few:
        return over_all(points, fold, block)
    packs, asks, count = celled(points, fold, block)
    return folded(packs, asks, fold, count)
