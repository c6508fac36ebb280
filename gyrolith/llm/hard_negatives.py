"""Hard negatives by vantage-point trees over vectors of whole numbers.

A score is an inner product. Each vector gets one more component, sqrt(M - |x|²) with M the largest squared norm of its block, so
that all are equally long and |x' - q'|² = M + |q|² - 2 score for a query q' = (q, 0): the highest score is the nearest vector, and a window of
scores is an annulus around the query. A vantage-point tree halves a block by distance from a vantage point, again and
again; each node knows the range of distances of its points, so for a query a leaf has a least and a greatest distance. A search
takes the leaves that meet its annulus nearest first, twice as many each time, and ends when no leaf left can hold anything
better than the k rows found, or anything inside the annulus.

Vectors are dealt into blocks of bounded size by a hash; a block and its tree are packed into one row, once, and written. Queries are
packed in groups, and each group meets each block in a task, to which both are dealt by number: joined, the groups, whose copies grow with the
blocks, could be taken for small and broadcast. Two rounds: the best rows of an anchor's own label are its positives, and
their scores give the annuli for its negatives. Every vector takes part in every search, which is exact: distances only decide
what is looked at, with a margin, and scores are integers. Of rows with equal vector and label the k + 1 smallest ids
take part, as others can't be among k answers, so a vector that a third of all rows share is a few rows.

Defined results: rows without id, with a null label, or whose vector is null or holds null or non-finite components take no part;
vectors of different lengths never meet; rows of the anchor's own id are never its positives; of repeated anchors the
one of the smallest label and vector asks; repeated rows count each as candidates, and as a positive ask once; an anchor without positives, or whose windows hold
nothing, has no rows; scores that no long can hold raise an error; columns other than the three are not looked at.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrolith.llm.common import shared_folder, written
from gyrolith.llm.whitening import whole

#: Vectors of a block and anchors of a group, about, and points of a leaf at most.
VECTORS, ANCHORS, LEAF = 8192, 2048, 128
#: What rounding may take from a bound on scores, as a share of the largest that the squares can be.
MARGIN = 1e-9
FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


class VantageTree:
    """One block's vectors, in order of their leaves, and the nodes' ranges of distances."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        exact = vectors.astype(np.float64)
        squares = (exact * exact).sum(1)
        self.most = float(squares.max(initial=0.0))
        points = np.column_stack([exact, np.sqrt(np.maximum(self.most - squares, 0))])
        order, vantage, nodes = np.arange(len(ids)), [], [(0, len(ids), -1, -1, 0.0, 0.0)]  # start, end, parent, vantage point, least, greatest distance from it
        k = 0
        while k < len(nodes):
            start, end = nodes[k][:2]
            if end - start > leaf:
                own = points[order[start:end]]
                far = own[np.square(own - own.mean(0)).sum(1).argmax()]
                d = np.sqrt(np.square(own - far).sum(1))
                by = np.argsort(d, kind="stable")
                order[start:end], d, middle = order[start:end][by], d[by], (end - start) // 2
                nodes.append((start, start + middle, k, len(vantage), d[0], d[middle - 1]))
                nodes.append((start + middle, end, k, len(vantage), d[middle], d[-1]))
                vantage.append(far)
            k += 1
        inner = {n[2] for n in nodes}
        self.nodes, self.leaves = nodes, np.array([k for k in range(len(nodes)) if k not in inner])
        self.starts, self.ends = (np.array([nodes[k][j] for k in self.leaves]) for j in (0, 1))
        self.vantage = np.array(vantage).reshape(-1, points.shape[1])
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest and the lowest score that each query can have in each leaf."""
        q = queries.astype(np.float64)
        square = (q * q).sum(1)
        d = np.sqrt(np.maximum(square[:, None] + self.most - 2 * (q @ self.vantage[:, :-1].T), 0))  # vantage points are as long as all others
        near, far = np.zeros((len(self.nodes), len(q))), np.full((len(self.nodes), len(q)), np.inf)
        for k, (_, _, parent, at, least, greatest) in enumerate(self.nodes[1:], 1):
            near[k] = np.maximum(near[parent], np.maximum(least - d[:, at], d[:, at] - greatest))
            far[k] = np.minimum(far[parent], d[:, at] + greatest)
        total = (square + self.most)[:, None]
        slack = MARGIN * total + 1e-6
        high = (total - near[self.leaves].T ** 2) / 2 + slack
        low = (total - far[self.leaves].T ** 2) / 2 - slack
        return high, low

    def search(self, query: np.ndarray, high: np.ndarray, low: np.ndarray, wanted, windows: list[tuple[int, int]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window of scores (least, greatest) the first k wanted rows inside, as (ids, scores), and the rows looked at; `wanted` tells which of some rows count."""
        found: list = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(windows)
        wide = (min(w[0] for w in windows), max(w[1] for w in windows))
        order = np.argsort(-high, kind="stable")
        order = order[(high[order] >= wide[0]) & (low[order] <= wide[1])]
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        open_, at, step, seen = list(range(len(windows))), 0, 1, 0
        while open_ and at < len(order):
            rows = np.concatenate([np.arange(self.starts[j], self.ends[j]) for j in order[at : at + step]])
            at, step, seen = at + step, 2 * step, seen + len(rows)
            rows = rows[wanted(rows)]
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, products(self.vectors[rows], query)])
            by = np.lexsort((ids, -scores))
            ids, scores = ids[by], scores[by]
            left = high[order[at]] if at < len(order) else -np.inf
            for w in list(open_):
                first, last = np.searchsorted(-scores, [-windows[w][1], -windows[w][0] + 1])
                end = min(first + k, last)
                if left < windows[w][0] or (end - first == k and scores[end - 1] > left) or at >= len(order):
                    found[w] = (ids[first:end], scores[first:end])
                    open_.remove(w)
        return found, seen


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where these hold every sum, else in longs."""
    most = len(query) * int(np.abs(vectors).max(initial=0)) * int(np.abs(query).max(initial=0))
    if most < 1 << 53:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise ArithmeticError("scores must fit a long")
    return vectors @ query


def flat(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def dealt(n: int):
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def each(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


class Blocks:
    """The table's vectors with a tree for each block, written once, and groups of anchors that are held against all of them."""

    def __init__(self, rows: DataFrame, most: int, vectors: int, leaf: int):
        """`rows` has id, label and v array<long>; no search asks for more than `most` rows."""
        self.count = -(-rows.count() // vectors) or 1
        copies = Window.partitionBy("dim", "label", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).orderBy("id")
        rows = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= most + 1).drop("copy")

        def pack(block: pa.Table) -> pa.Table:
            block = block.sort_by("id")
            dim = block["dim"][0].as_py()
            tree = VantageTree(block["id"].to_numpy(), block["label"].to_numpy(), flat(block["v"], dim), leaf)
            return pa.table({"dim": block["dim"].slice(0, 1), "block": block["block"].slice(0, 1), "tree": pa.array([pickle.dumps(tree, 5)], pa.large_binary()).cast(pa.binary())})

        packs = rows.withColumn("block", dealt(self.count)).groupBy("dim", "block").applyInArrow(pack, "dim int, block int, tree binary")
        self.trees = written(packs, f"{shared_folder(rows.sparkSession)}/trees")

    def search(self, anchors: DataFrame, groups: int, same: bool, k: int) -> DataFrame:
        """FOUND rows, of each block up to k for each window; `anchors` has id, dim, label, v and asks, an array of (positive id, positive score, least, greatest)."""

        def pack(group: pa.Table) -> pa.Table:
            dim = group["dim"][0].as_py()
            held = (group["id"].to_numpy(), group["label"].to_numpy(), flat(group["v"], dim), [[(a["j"], a["s"], a["least"], a["greatest"]) for a in x] for x in group["asks"].to_pylist()])
            return pa.table({"dim": group["dim"].slice(0, 1), "part": group["part"].slice(0, 1), "asking": pa.array([pickle.dumps(held, 5)], pa.binary())})

        right = anchors.withColumn("part", dealt(groups)).groupBy("dim", "part").applyInArrow(pack, "dim int, part int, asking binary")
        none, spark = F.lit(None).cast("binary"), anchors.sparkSession
        rows = self.trees.select("dim", "block", each(groups).alias("part"), "tree", none.alias("asking"))
        rows = rows.unionByName(right.select("dim", each(self.count).alias("block"), "part", none.alias("tree"), "asking"))
        parts = min(self.count * groups, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        rows = rows.repartitionById(parts, (F.col("block") * groups + F.col("part")) % parts).sortWithinPartitions("dim", "block", "part", F.col("tree").isNull())

        def run(batches):
            at, tree = None, None
            for batch in batches:
                for *key, data, asking in zip(batch["dim"], batch["block"], batch["part"], batch["tree"], batch["asking"], strict=True):
                    if data is not None:
                        at, tree = key, pickle.loads(data)
                        continue
                    if at != key:  # the block has no vectors of this length
                        continue
                    ids, labels, queries, asks = pickle.loads(asking)
                    high, low = tree.bounds(queries)
                    out = []
                    for n, (me, label, own) in enumerate(zip(ids.tolist(), labels.tolist(), asks, strict=True)):

                        def wanted(rows, label=label, me=me, tree=tree):
                            return (tree.labels[rows] == label) & (tree.ids[rows] != me) if same else tree.labels[rows] != label

                        found, _ = tree.search(queries[n], high[n], low[n], wanted, [a[2:] for a in own], k)
                        out += [(me, a[0], a[1], j, s) for a, (js, ss) in zip(own, found, strict=True) for j, s in zip(js.tolist(), ss.tolist(), strict=True)]
                    yield pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "id", "score"])

        return rows.mapInPandas(run, FOUND)


def ranked(found: DataFrame, k: int, *within: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "v", every: int = 50, positives: int = 5, negatives: int = 3,
    least: int = 50, greatest: int = 95, vectors: int = VECTORS, group: int = ANCHORS, leaf: int = LEAF,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id is divisible by `every`.

    Vectors hold whole numbers (array<long>). A negative scores from `least` to `greatest` hundredths of its positive.
    """
    rows = table.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())).withColumn("dim", F.size("v"))
    blocks = Blocks(rows, max(positives, negatives), vectors, leaf)
    anchors = rows.where(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "dim", "a.label", "a.v")
    groups = -(-anchors.count() // group) or 1

    window = lambda j, s, low, high: F.array(F.struct(j.cast("long").alias("j"), s.cast("long").alias("s"), low.cast("long").alias("least"), high.cast("long").alias("greatest")))
    everything = window(F.lit(0), F.lit(0), F.lit(-(1 << 62)), F.lit(1 << 62))
    first = ranked(blocks.search(anchors.withColumn("asks", everything), groups, True, positives), positives, "anchor_id")
    score = F.col("score").cast("decimal(38,0)")
    low, high = F.ceil(score * least / 100), F.floor(score * greatest / 100)
    asks = first.select(F.col("anchor_id").alias("id"), F.struct(F.col("id").alias("j"), F.col("score").alias("s"), low.cast("long").alias("least"), high.cast("long").alias("greatest")).alias("a"))
    asks = asks.where("a.least <= a.greatest").groupBy("id").agg(F.collect_set("a").alias("asks"))  # at most `positives` each
    second = blocks.search(anchors.join(written(asks, f"{shared_folder(table.sparkSession)}/asks"), "id"), groups, False, negatives)
    found = ranked(second, negatives, "anchor_id", "positive_id", "positive_score")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every embedding whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", whole(F.col("embedding"), 256.0).alias("v"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label))


SQL = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
p AS (SELECT a.id AS anchor_id, a.label AS own, b.id, b.label, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e a JOIN e b ON len(a.v) = len(b.v) WHERE a.id % 50 = 0),
q AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE own = label AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, p.id AS negative_id, positive_score, p.score AS negative_score
FROM q JOIN p USING (anchor_id) WHERE own <> label AND 50 * positive_score <= 100 * p.score AND 100 * p.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY p.score DESC, p.id) QUALIFY rank <= 3"""
