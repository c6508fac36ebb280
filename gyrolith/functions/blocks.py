"""All pairs of a table of points, in blocks, medians over all pairs, and functions over whole images.

A block of points is packed into one row, so what is copied for pairs of blocks is a few large values and not a row for
each point. Each two blocks meet once: a task holds a group of blocks while half of the others pass by, so a block is copied once for
each second group and not for each block that it meets. The function is called for both orders.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrolith.sources.tables import shared_folder, written

#: Points of a block, about, and rows of whole images that a function gets at least, if there are as many.
BLOCK, IMAGE_ROWS = 2048, 100_000
#: Groups of blocks for each core, and blocks that a task holds at most.
GROUPS, HELD = 2, 32
#: Bits of a value that a pass over all pairs tells apart in a window, and values that a window holds at most to be told apart altogether.
BITS, FEW_VALUES = 16, 1 << 20
#: What no value's bits reach.
TOP = (1 << 63) - 1
#: Rows of a block whose distances to another are held at once.
ROWS = 256
#: Share of two points' squared norms below which their squared distance is taken by differences, and what rounding may take of any.
CLOSE, SLACK = 1e-3, 1e-9

Points = dict[str, np.ndarray]


def by_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows that stand beside each other, few at a time, so that they stay in the processor's cache."""
    out, some = np.empty(len(a)), max(64, (1 << 15) // max(1, a.shape[1]))
    for k in range(0, len(a), some):
        d = b[k : k + some] - a[k : k + some]
        np.einsum("ij,ij->i", d, d, out=out[k : k + some])
    return out


def gathered(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of rows i of `a` from rows j of `b`."""
    out, some = np.empty(len(i)), max(64, (1 << 15) // max(1, a.shape[1]))
    for k in range(0, len(i), some):
        out[k : k + some] = by_differences(a[i[k : k + some]], b[j[k : k + some]])
    return out


def readied(b: np.ndarray) -> tuple[np.ndarray | float, np.ndarray, np.ndarray]:
    """What `squares` needs of `b`, for any number of calls: its mean, the right side of products, and squared norms less the mean."""
    with np.errstate(over="ignore", invalid="ignore"):
        centre = b.mean(0) if len(b) else 0.0
        q = b - centre
        n = np.einsum("ij,ij->i", q, q)
    return centre, np.column_stack([q, np.ones(len(q)), n]).T, n


def squares(a: np.ndarray, b: np.ndarray, ready: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances, from products of rows less their mean, and which were taken by differences: those of close points, as products lose digits there."""
    centre, right, n = ready or readied(b)
    with np.errstate(over="ignore", invalid="ignore"):
        p = a - centre
        m = np.einsum("ij,ij->i", p, p)
        sound = np.isfinite(m.sum() + n.sum())
    if sound:
        out = np.column_stack([-2.0 * p, m, np.ones(len(p))]) @ right
        close = np.zeros(out.shape, bool)
        some = np.flatnonzero(out.min(1, initial=np.inf) <= CLOSE * (m + n.max(initial=0.0)))
        if len(some):
            close[some] = out[some] <= CLOSE * (m[some, None] + n)
    else:  # values that are not finite, or too large, stay with their own pairs
        out, close = np.empty((len(a), len(b))), np.ones((len(a), len(b)), bool)
    count = int(np.count_nonzero(close))
    if count <= 16 * len(a):
        i, j = np.nonzero(close)
        out[i, j] = gathered(a, i, b, j)
    else:
        for k in np.flatnonzero(close.any(1)):
            d = b[close[k]] - a[k]
            out[k, close[k]] = np.einsum("ij,ij->i", d, d)
    return out, close


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; equal points are at distance 0 exactly."""
    out, ready = np.empty((len(a), len(b))), readied(b)
    for k in range(0, len(a), ROWS):
        np.sqrt(squares(a[k : k + ROWS], b, ready)[0], out=out[k : k + ROWS])
    return out


def packed(points: DataFrame, block: int, within: tuple[str, ...] = (), n: int | None = None) -> DataFrame:
    """(*within, n, i, data): the points of each block, sorted by id; a group of `within` has n blocks. `n`: how many points there are, if known."""
    if within:
        sizes = points.groupBy(*within).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
        rows = points.join(sizes, list(within))
    else:
        rows = points.withColumn("n", F.lit(-(-(points.count() if n is None else n) // block) or 1))
    return packed_by(rows.withColumn("i", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")), (*within, "n", "i"))


def packed_by(rows: DataFrame, keys: tuple[str, ...] = ("i",)) -> DataFrame:
    """(*keys, data): the points of each block, sorted by id; components that single precision holds exactly are packed so."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys) + ", data binary"

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        held = {c: table[c].to_numpy() for c in table.column_names if c not in ("n", "i", "v")} | {"i": table["i"][0].as_py()}
        if "v" in table.column_names:
            held["v"] = short(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1))
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "data": pa.array([pickle.dumps(held, 5)], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(pack, schema)


def short(v: np.ndarray) -> np.ndarray:
    """The array in single precision, if that holds it exactly."""
    with np.errstate(over="ignore"):
        found = v.astype(np.float32)
    return found if np.array_equal(found, v) else v


def unpacked(data: bytes) -> Points:
    held = pickle.loads(data)
    if "v" in held:
        held["v"] = held["v"].astype(float, copy=False)
    return held


def meetings(packs: DataFrame, count: int, within: tuple[str, ...] = ()) -> DataFrame:
    """The packs (*within, n, i, data, ...) with `g` and `own`, for `met`: each of the some `count` blocks for its own group g and for those that it meets as another."""
    spark = packs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    group = max(1, min(HELD, -(-count // (GROUPS * cores))))
    parts = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = packs.withColumn("g", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / group).cast("int"))))
    rows = rows.withColumn("own", F.floor(F.col("i") / group) == F.col("g"))
    others = F.sequence(F.col("g") * group, F.least(F.col("g") * group + group, "n") - 1)
    rows = rows.where(F.col("own") | F.exists(others, lambda x: F.pmod(F.col("i") - x, F.col("n")).between(1, F.floor(F.col("n") / 2))))
    parts = min(parts, -(-count // group))
    rows = rows.repartition(parts, *within, "g") if within else rows.repartitionById(parts, F.col("g") % parts)
    return rows.sortWithinPartitions(*within, "g", ~F.col("own"), "i")


def met(batches: Iterator[pd.DataFrame], within: tuple[str, ...] = ()) -> Iterator[tuple[dict, bool, Points, Points]]:
    """(row, whether they are two, a, b): each two blocks of a group of `within` once, and each with itself."""

    def first(i: int, j: int, n: int) -> bool:
        k = (j - i) % n
        return 0 < 2 * k < n or (2 * k == n and 2 * i < n)

    at, held = None, {}
    for batch in batches:
        for row in batch.to_dict("records"):
            own, b, j, n = tuple(row[c] for c in (*within, "g")), unpacked(row["data"]), row["i"], row["n"]
            if own != at:
                at, held = own, {}
            for i, a in held.items():
                if first(i, j, n):
                    yield row, True, a, b
                elif row["own"] and first(j, i, n):
                    yield row, True, b, a
            if row["own"]:  # a group's own come first
                held[j] = b
                yield row, False, b, b


def against_all(points: DataFrame, function: Callable[[Points, Points, np.ndarray], pd.DataFrame], schema: str, block: int = BLOCK, within: tuple[str, ...] = ()) -> DataFrame:
    """`function`(points of one block, points of another, their distances) for every two blocks; blocks never mix values of `within`.

    Points have columns id and v. Results for one point come from several blocks and are to be merged by the caller.
    """
    n = points.count()

    def both_orders(batches):
        for _, two, a, b in met(batches, within):
            d = distances(a["v"], b["v"])
            yield function(a, b, d)
            if two:
                yield function(b, a, d.T)

    return meetings(packed(points, block, within, n), -(-n // block) or 1, within).mapInPandas(both_orders, schema)


def bits_of(x: float) -> int:
    return int(np.array([x]).view(np.int64)[0])


def at_ranks(points: DataFrame, packs: DataFrame, value: Callable, ranks: list[str], within: tuple[str, ...], block: int, near: Callable | None = None, window: tuple[float, float] | None = None) -> DataFrame:
    """(*within, rank, x): the values with these ranks (SQL over s, how many there are) among all ordered pairs of each group.

    Values are at least 0, so their bits order them. A pass over all pairs counts values below a window of bits and in 2 ** BITS parts of it, and
    the next one looks at the part that holds the rank, until a window has few values, which are told apart at once. A task adds its counts up,
    and pairs of blocks are made anew in each pass, so what is written doesn't grow with their number.
    `window` is where to look first; if a rank is outside, that side is looked at next. `near`(a, b, least, most) gives (pairs surely below
    least, the values of pairs that may be in the window), or None where it can't.
    """
    folder, keys = shared_folder(points.sparkSession), list(within)
    count = -(-points.count() // block) or 1
    kinds = "".join(f"{c} {packs.schema[c].dataType.simpleString()}, " for c in keys)
    size = points.groupBy(*keys).agg(F.count("*").alias("c")).withColumn("s", F.col("c") * F.col("c"))
    size = size.join(packs.select(*keys).distinct(), keys, "left_semi") if keys else size
    low = bits_of(window[0]) if window else 0
    span = max(1, bits_of(window[1]) - low) if window else TOP
    start = (F.lit(x).cast("long").alias(c) for c, x in (("low", low), ("span", span)))
    state = size.select(*keys, "c", F.explode(F.array_distinct(F.array(*map(F.expr, ranks)))).alias("rank"), *start, F.col("s").alias("held"))
    state, step = written(state, f"{folder}/state-0"), 0
    some = F.least(F.lit(FEW_VALUES).cast("long"), "c")
    length = lambda c: F.length(F.bin(c))

    def counted(batches):
        """Counts of a task: part 0 is what lies below the window."""
        held: dict = {}

        def tables():
            for (own, low, span, shift), (below, n, few) in held.items():
                parts, times = [np.zeros(1, np.int64)], [np.array([below])]
                if n is not None:
                    parts.append(np.flatnonzero(n) + 1)
                    times.append(n[np.flatnonzero(n)])
                for x, weight in few:
                    part, k = np.unique(x, return_counts=True)
                    parts.append((part >> shift) + 1)
                    times.append(weight * k)
                yield pd.DataFrame({**dict(zip(keys, own, strict=True)), "low": low, "span": span, "part": np.concatenate(parts), "n": np.concatenate(times)})

        for row, two, a, b in met(batches, within):
            times, own, plain = 2 if two else 1, tuple(row[c] for c in keys), None
            for w in row["limits"]:
                low, span, shift = int(w["low"]), int(w["span"]), int(w["shift"])
                key = own, low, span, shift
                if key not in held and len(held) > 64:
                    yield from tables()
                    held = {}
                state = held.setdefault(key, [0, None, []])
                found = near(a, b, *(float(np.array([x]).view(np.float64)[0]) for x in (low, low + span))) if near else None
                if found is None:
                    if plain is None:
                        plain = value(a, b, distances(a["v"], b["v"])).ravel()
                    found = 0, plain
                place = found[1].view(np.int64) - low
                state[0] += times * (found[0] + int(np.count_nonzero(place < 0)))
                place = place[(place >= 0) & (place < span)]
                if shift or span <= 1 << BITS:
                    n = state[1] if state[1] is not None else np.zeros((span - 1 >> shift) + 1, np.int64)
                    n += times * np.bincount(place >> shift, minlength=len(n))
                    state[1] = n
                elif len(place):
                    state[2].append((place, times))
        yield from tables()

    while not state.where("span > 0").isEmpty():
        shift = F.when(F.col("held") <= some, 0).otherwise(F.greatest(F.lit(0), length(F.col("span") - 1) - BITS)).cast("int")
        open_ = state.where("span > 0").withColumn("shift", shift)
        limits = open_.groupBy(*keys).agg(F.collect_set(F.struct("low", "span", "shift")).alias("limits"))
        rows = packs.join(limits, keys) if keys else packs.crossJoin(F.broadcast(limits))  # one row
        sums = meetings(rows, count, within).mapInPandas(counted, f"{kinds}low long, span long, part long, n long").groupBy(*keys, "low", "span", "part").agg(F.sum("n").alias("n"))
        up_to = F.sum("n").over(Window.partitionBy(*keys, "low", "span").orderBy("part"))
        sums = open_.join(sums.withColumn("up_to", up_to), [*keys, "low", "span"])
        reached = F.min(F.when(F.col("up_to") > F.col("rank"), F.struct("part", "n")))
        place = sums.groupBy(*keys, "c", "rank", "low", "span", "shift").agg(reached.alias("at"), F.max(F.struct("part", "n")).alias("last"))
        part = F.coalesce("at.part", "last.part")
        inside = F.struct(
            (F.col("low") + (F.greatest(part, F.lit(1)) - 1) * F.expr("shiftleft(1L, shift)")).alias("low"),
            F.when(F.col("shift") == 0, 0).otherwise(F.least(F.expr("shiftleft(1L, shift)"), F.col("span") - (F.greatest(part, F.lit(1)) - 1) * F.expr("shiftleft(1L, shift)"))).cast("long").alias("span"),
            F.coalesce("at.n", "last.n").alias("held"),
        )
        whole = F.col("c") * F.col("c")
        below = F.struct(F.lit(0).cast("long").alias("low"), F.col("low").alias("span"), whole.alias("held"))
        above = F.struct((F.col("low") + F.col("span")).alias("low"), (TOP - (F.col("low") + F.col("span"))).alias("span"), whole.alias("held"))
        missed = F.lit(window is not None and step == 0)  # later a value can be outside only by its last bits, which may differ between machines
        to = F.when(missed & (F.col("at.part") == 0), below).when(missed & F.col("at").isNull(), above).otherwise(inside)
        step += 1
        state = written(place.select(*keys, "c", "rank", to.alias("to")).select(*keys, "c", "rank", "to.*").unionByName(state.where("span = 0")), f"{folder}/state-{step}")

    def as_values(batches):
        for batch in batches:
            yield pd.DataFrame({**{c: batch[c] for c in keys}, "rank": batch["rank"], "x": batch["low"].to_numpy(np.int64).view(np.float64)})

    return state.select(*keys, "rank", "low").mapInPandas(as_values, f"{kinds}rank long, x double")


def medians(points: DataFrame, value: Callable[[Points, Points, np.ndarray], np.ndarray], within: tuple[str, ...] = (), block: int = BLOCK, near: Callable | None = None, window: tuple[float, float] | None = None) -> DataFrame:
    """(*within, mid): the exact median of `value`, alike in both orders, over all ordered pairs of each group, points with themselves included.

    A group of one block has its median at once; for others see `at_ranks`.
    """
    keys = list(within)
    packs = written(packed(points, block, within), f"{shared_folder(points.sparkSession)}/packs")
    kinds = "".join(f"{c} {packs.schema[c].dataType.simpleString()}, " for c in keys)

    def alone(batches):
        for batch in batches:
            sets = [unpacked(x) for x in batch["data"]]
            yield pd.DataFrame({**{c: batch[c] for c in keys}, "mid": [float(np.median(value(a, a, distances(a["v"], a["v"])))) for a in sets]})

    found = packs.where("n = 1").select(*keys, "data").mapInPandas(alone, f"{kinds}mid double")
    many = packs.where("n > 1")
    if many.isEmpty():
        return found
    ends = at_ranks(points, many, value, ["(s - 1) DIV 2", "s DIV 2"], within, block, near, window)
    return found.unionByName(ends.groupBy(*keys).agg(F.avg("x").alias("mid")))


def over_images(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """`function` on the rows of many images at once: each call gets whole images, one after the other.

    An image stays in one task, a call takes no more images than it needs for IMAGE_ROWS rows. With other `keys`, what has the same ones stays together.
    """
    ends = lambda batch, row: tuple(batch[c].iloc[row] for c in keys)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            last = np.logical_or.reduce([batch[c].to_numpy() != batch[c].iloc[-1] for c in keys]).sum()  # rows are sorted: where the last image starts
            if size + last >= IMAGE_ROWS:
                if last or ends(batch, 0) != ends(held[-1], -1):
                    ready = pd.concat([*held, batch.iloc[:last]], ignore_index=True)
                    yield function(ready)
                    held, size = [], 0
                    batch = batch.iloc[last:]
            held.append(batch)
            size += len(batch)
        if held:
            yield function(pd.concat(held, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def codes(*keys: pd.Series) -> np.ndarray:
    """0, 0, 1, 2, 2 ... for images, or other keys, that stand one after the other."""
    if not len(keys[0]):
        return np.zeros(0, int)
    change = np.logical_or.reduce([x[1:] != x[:-1] for x in (k.to_numpy() for k in keys)])
    return np.concatenate([[0], np.cumsum(change)])
