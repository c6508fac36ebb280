import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from gyrolith.llm import hard_negatives


def plain(rows, every=50, positives=5, negatives=3):
    ok = [(i, c, [int(x) for x in v]) for i, c, v in rows if i is not None and c is not None and v is not None]
    anchors = {}
    for i, c, v in ok:
        if i % every == 0:
            anchors[i, len(v)] = min(anchors.get((i, len(v)), (c, v)), (c, v))
    out = []
    for (i, dim), (c, v) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for j, d, w in ok if len(w) == dim)
        for s, j, _ in {x for x in [x for x in scored if x[2] == c and x[1] != i][:positives]}:
            near = [x for x in scored if x[2] != c and -50 * s <= -100 * x[0] <= -95 * s][:negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(near)]
    return sorted(out)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_against_sql(spark, sf):
    compare(hard_negatives.op12_hard_negatives(spark, sf), hard_negatives.SQL, sf)


def test_random_tables_in_small_blocks(spark):
    rng = np.random.default_rng(5)
    for dim, spread, n in ((2, 3, 300), (3, 40, 400), (8, 9, 300)):
        v = rng.integers(-spread, spread + 1, (n, dim))
        v[rng.random(n) < 0.3] = v[0]  # a third of all rows alike
        rows = [(k, int(c), x.tolist()) for k, (c, x) in enumerate(zip(rng.integers(0, 3, n), v, strict=True))]
        table = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
        for vectors, group, leaf in ((64, 5, 4), (10_000, 100, 16)):
            assert got(hard_negatives.hard_negatives(table, every=7, vectors=vectors, group=group, leaf=leaf)) == plain(rows, 7)


def test_no_search_broadcasts_copies_and_pairs_of_block_and_group_are_dealt_over_tasks(spark):
    """Groups of anchors are copied for each block, so their copies grow faster than the table: the driver must never hold them."""
    rng = np.random.default_rng(8)
    rows = [(k, int(c), x.tolist()) for k, (c, x) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(-9, 10, (400, 4)), strict=True))]
    table = spark.createDataFrame(rows, "id long, label long, v array<long>").withColumn("dim", F.size("v"))
    blocks = hard_negatives.Blocks(table, 5, 100, 8)
    asks = F.array(F.struct(*(F.lit(x).cast("long").alias(c) for c, x in (("j", 0), ("s", 0), ("least", -(1 << 62)), ("greatest", 1 << 62)))))
    found = blocks.search(table.where("id % 10 = 0").withColumn("asks", asks), 3, True, 5)
    assert len({(r["anchor_id"], r["id"]) for r in found.collect()}) > 40 * 5
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() == 4  # 12 pairs of a block and a group over as many tasks as Spark has


def test_bad_rows_repeats_lengths_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [0.5, 0.5]), (1, 1, [1.0, 0.25]), (1, 1, [1.0, 0.25]), (2, 2, [0.75, 0.25]), (2, 2, [0.75, 0.25]), (3, 2, [0.5, 0.25]), (4, 3, [0.5, 0.25]),
            (5, None, [1.0, 1.0]), (6, 1, None), (7, 1, [1.0, None]), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (None, 2, [0.75, 0.5]), (10, 2, [1.0]), (50, 1, []), (51, 1, []), (52, 2, []), (100, 5, [1.0, 1.0]),
            (150, 1, [-1.0, 0.0]), (200, 1, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    table = table.select("*", *(F.lit("own").alias(c) for c in ("id", "dim", "block", "part", "asks", "rank", "score", "anchor_id")), hard_negatives.whole(F.col("embedding"), 256.0).alias("v"))
    fine = [(i, c, [np.floor(256 * x) for x in v]) for i, c, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = plain(fine)
    assert got(hard_negatives.hard_negatives(table)) == want and {r[0] for r in want} >= {0, 50}
    assert hard_negatives.hard_negatives(table.limit(0)).count() == 0


def test_scores_beyond_doubles_and_longs(spark):
    big = [(0, 1, [(1 << 30) + 1, 7]), (1, 1, [(1 << 30) + 3, 11]), (2, 2, [(1 << 29) + 5, 3]), (3, 2, [(1 << 29) + 4, 12])]
    assert got(hard_negatives.hard_negatives(spark.createDataFrame(big, "vec_id long, label int, v array<long>"))) == plain(big)
    with pytest.raises(Exception, match="fit a long"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, 1, [1 << 40]), (1, 1, [1 << 40])], "vec_id long, label int, v array<long>")).collect()


def test_a_search_looks_at_few_rows_of_clustered_vectors():
    """Far from all rows where vectors of about one length lie in clusters, and the same answers as a whole pass."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 6))
    centres = (centres / np.linalg.norm(centres, axis=1)[:, None] * 4000).astype(int)
    x = centres[np.arange(4000) % 40] + rng.integers(-30, 31, (4000, 6))
    tree = hard_negatives.VantageTree(np.arange(4000), np.arange(4000) % 3, x)
    high, low = tree.bounds(x[:50])
    looked = [0, 0]
    for q in range(50):
        scores = x @ x[q]
        top = int(np.sort(scores)[-20])
        for windows in ([(-(1 << 62), 1 << 62)], [(top // 2, top), (top // 4, top // 2)]):
            found, seen = tree.search(x[q], high[q], low[q], lambda rows: tree.labels[rows] != 1, windows, 5)
            looked[len(windows) - 1] += seen
            for (ids, s), (least, greatest) in zip(found, windows, strict=True):
                want = sorted((-int(t), int(j)) for j, t in enumerate(scores) if j % 3 != 1 and least <= t <= greatest)[:5]
                assert [(-int(t), int(j)) for j, t in zip(ids, s, strict=True)] == want
    assert looked[0] < 50 * 4000 / 4 and looked[1] <= 50 * 4000
