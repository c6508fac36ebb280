"""Folds over blocks against plain all-pairs versions: pruned and whole, with ties, copies and blocks of any size."""

import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gyrolith.functions import blocks, folds
from gyrolith.operators import centre_torque, torque
from gyrolith.plans import clustering
from gyrolith.sources import tables


def clustered(n, clusters, seed=0, dim=3, spread=1.0):
    rng = np.random.default_rng(seed)
    v = np.round(rng.uniform(-100, 100, (clusters, dim))[np.arange(n) % clusters] + spread * rng.normal(size=(n, dim)), 1)  # rounded: ties
    m = rng.integers(1, 40, n).astype(float)
    return v, m


def frame(spark, v, m, **more):
    rows = [(k, v[k].tolist(), float(m[k]), *(int(c[k]) for c in more.values())) for k in range(len(v))]
    return spark.createDataFrame(rows, ", ".join(["id long, v array<double>, m double", *(f"{c} long" for c in more)]))


def gaps(v):
    return np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))


@pytest.mark.parametrize("block, few", [(20, 0), (64, 0), (5000, 0), (20, 10**6)])
def test_nearest_points_and_heavier_ones(spark, block, few):
    v, m = clustered(400, 9)
    v[50:90] = v[50]  # a tenth of all points at one place
    points, d = frame(spark, v, m), gaps(v)
    got = torque.nearest_rows(points, 4, block, few).collect()
    order = np.lexsort((np.broadcast_to(np.arange(400), d.shape), d), axis=-1)[:, :5]
    assert sorted((r.id, r["rank"], r.j) for r in got) == [(i, k, int(order[i, k])) for i in range(400) for k in range(5)]
    assert all(r.d == pytest.approx(d[r.id, r.j], abs=1e-12) for r in got)
    heavier = np.where(m[None, :] > m[:, None], d, np.inf)
    want = {i: int(heavier[i].argmin()) if np.isfinite(heavier[i]).any() else None for i in range(400)}
    assert {r.id: r.parent for r in torque.nearest_heavier(points, block, few).collect()} == want
    assert torque.nearest_rows(points.limit(3), 4, block, few).count() == 9 and torque.nearest_rows(points.limit(0), 4, block, few).count() == 0


def test_pairs_of_blocks_grow_with_the_points_and_not_with_their_square(spark):
    met = {}
    for n in (2000, 8000):
        v, m = clustered(n, 23, dim=2, spread=9.0)
        points = frame(spark, v, m).repartition(4)
        for name, fold, columns in (("near", torque.Nearest(6), ("id", "v")), ("heavier", torque.Heavier(), ("id", "v", "m"))):
            _, asks, blocks = folds.celled(points.select(*columns), fold, block=50)
            met[name, n] = (asks.count(), blocks)
    for name in ("near", "heavier"):
        (few, b1), (many, b2) = met[name, 2000], met[name, 8000]
        assert b2 > 3 * b1 and many < 8 * few and many < b2 * b2 / 4, met


def test_points_that_do_not_split(spark):
    rows = spark.createDataFrame([(k, [1.0, 2.0], 1.0 + k % 3) for k in range(300)], "id long, v array<double>, m double")
    got = torque.nearest_rows(rows, 2, 40, 0).collect()
    assert {(r.id, r["rank"], r.j, r.d) for r in got} == {(i, k, k, 0.0) for i in range(300) for k in range(3)}
    parents = {r.id: r.parent for r in torque.nearest_heavier(rows, 40, 0).collect()}
    assert parents == {i: (None if i % 3 == 2 else 1 if i % 3 == 0 else 2) for i in range(300)}


def plain_pull(v, m, power):
    d = gaps(v)
    w = m[None, :] / (d**power + 1e-9)
    np.fill_diagonal(w, 0)
    return (w[:, :, None] * (v[None] - v[:, None])).sum(1)


@pytest.mark.parametrize("block", [30, 5000])
def test_pulls_leave_as_one_row_a_point(spark, block):
    v, m = clustered(200, 5)
    v = v + np.random.default_rng(1).normal(size=v.shape)
    points = frame(spark, v, m)
    found = torque.torque(points, power=1.0, block=block)
    got = {r.id: r.t for r in found.collect()}
    np.testing.assert_allclose([got[k] for k in range(200)], plain_pull(v, m, 1.0), rtol=1e-9, atol=1e-7)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in text.split("MapInPandas")[0] and "Generate" not in text.split("MapInPandas")[0] and "Exchange" not in text.split("MapInPandas")[0]
    d = gaps(v)
    order = np.argsort(d, axis=1, kind="stable")[:, 1:8]
    w = np.take_along_axis(m[None, :] / (d**2 + 1e-9), order, 1)
    want = (w[:, :, None] * (v[order] - v[:, None])).sum(1) / w.sum(1)[:, None]
    got = {r.id: r.t for r in torque.torque(points, neighbours=7, block=block).collect()}
    np.testing.assert_allclose([got[k] for k in range(200)], want, rtol=1e-9, atol=1e-9)


def folders(spark):
    root = tables.shared_folder(spark).removeprefix("file://").rsplit("/", 1)[0]
    return set(os.listdir(root)) if os.path.isdir(root) else set(), root


def plain_iteration(v, m, tolerance, rounds=100):
    x, norms = v.copy(), []
    while len(norms) < rounds:
        move = 0.01 * plain_pull(x, m, 2.0)
        x = x + move
        norms.append(np.sqrt((move**2).sum()) / len(x))
        if len(norms) > 1 and norms[-1] < tolerance:
            break
    return x, norms


def test_iteration_to_its_own_stop(spark):
    """Against a plain loop: the same places while rounding can't tell, and at the defaults the same rounds, clusters and inertia; one folder is left.

    Points that meet are thrown apart by weights of up to 1e9, so after many rounds places depend on the last bits of sums.
    """
    points = clustering.blobs(spark, 300, 3, 2, 0.5, seed=4).cache()
    v = np.array([r.v for r in points.orderBy("id").collect()])
    weighed = points.select("id", "v").join(torque.mass(points, "density"), "id").cache()
    m = np.array([r.m for r in weighed.orderBy("id").collect()])
    _, norms = plain_iteration(v, m, 0.0, 8)
    least = min(norms[1:]) * 1.001
    for tolerance in (least, 1e-4):
        x, norms = plain_iteration(v, m, tolerance)
        before, root = folders(spark)
        places = torque.iterate(weighed, tolerance=tolerance, block=64)
        got = np.array([r.v for r in places.orderBy("id").collect()])
        (new,) = folders(spark)[0] - before
        assert os.listdir(f"{root}/{new}") == [str(len(norms))]
        if tolerance == least:
            np.testing.assert_allclose(got, x, atol=1e-6)
    labels = torque.kmeans_labels(places, 3)
    both = labels.join(points.select("id", F.col("label").alias("truth")), "id")
    assert torque.agreement(both, "truth", "cluster").first()["ari"] == pytest.approx(1.0)
    found = np.array([r.cluster for r in labels.orderBy("id").collect()])
    inertia = lambda x: sum(((x[found == c] - x[found == c].mean(0)) ** 2).sum() for c in range(3))
    assert inertia(got) == pytest.approx(inertia(x), rel=0.2)


@pytest.mark.parametrize("kinds", [2, 3, 70])
def test_silhouettes_with_any_number_of_clusters(spark, kinds):
    v, m = clustered(210, 5)
    rng = np.random.default_rng(kinds)
    labels = rng.integers(0, kinds, 210) * 7
    labels[:70] = 7  # a third of all points in one cluster
    points = frame(spark, v, m, cluster=labels)
    want = centre_torque.plain_silhouette(v, labels)
    for block in (16, 50, 5000):
        assert centre_torque.silhouette(points, block).first()[0] == pytest.approx(want, abs=1e-12)
    assert centre_torque.silhouette(points.withColumn("cluster", F.lit(1).cast("long"))).first()[0] == -1.0


def test_cells_hold_their_points():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    tree = folds.Tree(x[:1000], 16)
    cells = tree.cells(x)
    assert tree.leaves == 16 and set(cells.tolist()) == set(range(16)) and np.bincount(cells[:1000]).max() <= 70
    assert folds.Tree(np.ones((500, 3)), 8).leaves == 1 and folds.Tree(np.empty((0, 3)), 8).leaves == 1


def test_distances_by_products_keep_close_points_and_odd_values():
    """Products lose the digits of close points, and values that are not finite must stay with their own pairs."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 9)) + 1e6
    b = np.vstack([a[:40], a[40:90] + 1e-7 * rng.normal(size=(50, 9)), rng.normal(size=(200, 9)) + 1e6])
    plain = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    np.testing.assert_allclose(blocks.distances(a, b), plain(a, b), rtol=1e-9, atol=0)
    a[3, 2], b[5, 1] = np.nan, np.inf
    np.testing.assert_allclose(blocks.distances(a, b), plain(a, b), rtol=1e-9, atol=0)
    assert blocks.distances(a[:0], b).shape == (0, len(b)) and blocks.distances(a, b[:0]).shape == (len(a), 0)


def test_a_block_of_distances_costs_no_pass_over_differences():
    """2,048 points against as many in 64 dimensions: products take a fraction of the time of differences."""
    import time

    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2048, 64)), rng.normal(size=(2048, 64))

    def seconds(f):
        best = np.inf
        for _ in range(3):
            start = time.perf_counter()
            f()
            best = min(best, time.perf_counter() - start)
        return best

    def by_rows():
        for row in a:
            d = b - row
            np.einsum("ij,ij->i", d, d)

    assert seconds(lambda: blocks.distances(a, b)) < seconds(by_rows) / 2
    fold, held = torque.Nearest(6), {"id": np.arange(2048), "v": b}
    assert seconds(lambda: fold.step(fold.start(held), held, held)) < seconds(by_rows) / 2


def test_medians_write_no_pairs_of_blocks(spark):
    """Eight times the points: what a median writes grows with them and not with their pairs."""
    written = {}
    for n in (256, 2048):
        v = np.random.default_rng(n).normal(size=(n, 4))
        before, root = folders(spark)
        got = blocks.medians(frame(spark, v, np.ones(n)).select("id", "v"), lambda a, b, d: d, block=32).first()["mid"]
        assert abs(got - np.median(gaps(v))) < 1e-12
        made = [os.path.join(at, f) for k in folders(spark)[0] - before for at, _, files in os.walk(os.path.join(root, k)) for f in files]
        written[n] = sum(os.path.getsize(f) for f in made if f.endswith(".parquet"))
    assert written[2048] < 12 * written[256], written


def test_training_cuts_links_at_the_median(spark, sf):
    """The registered query does the whole job: its threshold is the exact median over all pairs of a part, not a number."""
    from gyrolith.plans import catalog

    rows = tables.vectors(spark, sf).where("id % 5 = 0")
    points = rows.select("id", "v").join(torque.mass(rows, "density"), "id")
    labels = torque.connection_clusters(points, torque.median_torque(points)).join(rows, "id")
    want = torque.agreement(labels, "label", "cluster").first()
    got = catalog.queries()["train_and_evaluate"](spark, sf).where("part = 'test'").first()
    assert (got.n, got.ari, got.nmi) == (want.n, pytest.approx(want.ari, abs=2e-6), pytest.approx(want.nmi, abs=2e-6))
    assert "quantile_cont" in catalog.oracle_sql()["train_and_evaluate"]


def test_groups_of_blocks_give_the_same_and_copy_a_block_once_for_each(spark):
    """13 blocks in groups of 1, 4 and 16: results are those of single blocks, and blocks pass once for each group."""

    class Seen:
        schema = "id long, n long, s double"

        def start(self, a):
            return {"n": 0, "s": np.zeros(len(a["id"]))}

        def step(self, state, a, b):
            assert state["n"] or a is b, "a block meets itself first"
            state["n"] += 1
            state["s"] += b["v"].sum()

        def finish(self, state, a):
            return pd.DataFrame({"id": a["id"], "n": state["n"], "s": state["s"]})

    points = spark.range(260).select("id", F.array(F.col("id").cast("double")).alias("v"))
    packs = folds.packed(points, 20, n=260).select("i", "data")
    for group in (1, 4, 16):
        rows = folds.folded(packs, folds.all_asks(packs, 13), Seen(), 13, group)
        assert {(r["n"], r["s"]) for r in rows.collect()} == {(13, float(sum(range(260))))}
        assert rows.count() == 260
    assert [folds.group_size(n, 12, Seen()) for n in (1, 48, 301, 10_000)] == [1, 1, 7, 16]


@pytest.mark.parametrize("scale, offset, noise", [(1.0, 0.0, 1.0), (1.0, 1e4, 1e-3), (1e-18, 0.0, 1.0), (1e12, 3e13, 1e-6)])
def test_products_in_single_precision_miss_no_near_point(monkeypatch, scale, offset, noise):
    """Where bounds are settled no product in double precision is needed, and the nearest are those of all differences, ties too."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 7))
    x = scale * (base[rng.integers(0, 40, 700)] + noise * np.round(rng.standard_normal((700, 7)), 1)) + offset
    a, b = x[:300], x[300:]
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    mass = rng.random(400)[None, :] > rng.random(300)[:, None]
    for k, able in ((4, None), (1, mass)):
        own = d if able is None else np.where(able, d, np.inf)
        order = np.argsort(own, axis=1, kind="stable")[:, :k]
        want = np.take_along_axis(own, order, 1)
        if noise == scale == 1.0:
            monkeypatch.setattr(torque, "squares", lambda *_: pytest.fail("products in double precision"))
        near, at = torque.nearer(a, {"v": b}, k, want[:, -1] * (1 + 1e-12), able)
        monkeypatch.undo()
        assert np.allclose(near, want, rtol=1e-12, atol=0) and np.allclose(np.take_along_axis(d, at, 1), near, rtol=1e-12, atol=0)
        assert (at == order)[np.diff(np.sort(own, 1)[:, : k + 1], axis=1).min(1) > 1e-9 * want[:, -1]].all()


def test_values_too_large_for_single_precision_and_points_without_bound_are_found():
    x = np.array([[0.0, 0.0], [1e20, 0.0], [1e200, 0.0], [3.0, 4.0]])
    for most in (np.full(4, np.inf), np.array([np.inf, 2e20, np.inf, 6.0])):
        near, at = torque.nearer(x, {"v": x[[3, 1]]}, 1, most)
        assert at[:, 0].tolist()[:2] == [0, 1] and near[0, 0] == 5.0 and near[3, 0] == 0.0
    assert torque.likely(x[:2], torque.readied(x[:2]), torque.single(torque.readied(x[:2])), np.ones(2)) is None


def test_distance_summaries_shuffle_points_and_no_parts_of_sums(spark):
    """Parts of a point's sums stay in its task, so rows that are added up are as many as points, whatever the number of blocks."""
    x = np.random.default_rng(3).standard_normal((300, 5))
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for block in (300, 40):
        rows = torque.over_all(points, torque.Summary(), block)
        assert rows.count() == 300
        got = torque.distance_summary(points, block).orderBy("id").toPandas()
        assert np.allclose(got[["nearest", "farthest", "total"]], np.column_stack([np.where(d > 0, d, np.inf).min(1), d.max(1), d.sum(1)]), rtol=1e-12)


def test_pairs_of_blocks_meet_once_and_blocks_are_copied_once_for_each_group(spark):
    """65 and 64 blocks: with a row for each pair these were 2,145 and 2,080 copies of two blocks."""
    for n in (65, 64, 2, 1):
        points = spark.range(4 * n).select("id", F.array(F.col("id").cast("double") / 8).alias("v"))
        packs = blocks.packed(points, 4, n=4 * n)
        held = packs.count()  # a block may get no points
        rows = blocks.meetings(packs, n)
        cores = spark.sparkContext.defaultParallelism
        group = max(1, -(-n // (blocks.GROUPS * cores)))
        assert rows.count() <= -(-n // group) * (group + n // 2 + 1)
        pairs = rows.mapInPandas(lambda x: (pd.DataFrame({"a": [a["i"]], "b": [b["i"]], "two": [two]}) for _, two, a, b in blocks.met(x)), "a int, b int, two boolean").collect()
        assert len(pairs) == len({frozenset((r.a, r.b)) for r in pairs}) == held * (held + 1) // 2
        assert all(r.two == (r.a != r.b) for r in pairs)


def test_a_median_is_found_in_a_window_and_on_either_side_of_it(spark, monkeypatch):
    rng = np.random.default_rng(11)
    v, m = rng.standard_normal((400, 5)), rng.random(400) + 0.1
    v[50:60], m[7] = v[40:50] + 1e-4, 80.0
    t = m[:, None] * m / (((v[:, None] - v[None]) ** 2).sum(-1) + 1e-9)
    points, q = frame(spark, v, m), lambda x: float(np.quantile(t, x))
    for window in ((q(0.45), q(0.55)), (q(0.1), q(0.2)), (q(0.7), q(0.9))):
        got = blocks.medians(points, torque.pair_torques, block=60, near=torque.near_torques, window=window).first()["mid"]
        assert got == pytest.approx(np.median(t), rel=1e-12)
    whole = torque.median_torque(points)
    monkeypatch.setattr(torque, "SAMPLE", 100)
    assert torque.median_torque(points) == pytest.approx(whole, rel=1e-12) == pytest.approx(np.median(t), rel=1e-12)
    assert torque.mean_torque(points) == pytest.approx(t.mean(), rel=1e-9)


def test_single_precision_tells_torques_below_a_window_from_those_inside():
    """Few entries beside those in the window are taken by differences, and none of those in it is missed."""
    rng = np.random.default_rng(12)
    for scale, offset in ((1.0, 0.0), (1e-3, 50.0), (1e9, 0.0)):
        a, b = ({"v": scale * rng.standard_normal((300, 64)) + offset, "m": rng.random(300) + 0.5} for _ in range(2))
        b["v"][:9] = a["v"][:9]
        t = a["m"][:, None] * b["m"] / (((a["v"][:, None] - b["v"][None]) ** 2).sum(-1) + 1e-9)
        for low, high in ((0.5, 0.5001), (0.4, 0.6), (0.0, 0.01)):
            least, most = np.quantile(t, [low, high]) if low else (0.0, float(np.quantile(t, high)))
            below, found = torque.near_torques(a, b, least, most)
            slack = 1e-9  # entries on the edge of the window
            assert below + np.count_nonzero(found < least * (1 - slack)) <= np.count_nonzero(t < least) <= below + np.count_nonzero(found < least * (1 + slack))
            assert np.allclose(np.sort(found[(found > least * (1 + slack)) & (found < most * (1 - slack))]), np.sort(t[(t > least * (1 + slack)) & (t < most * (1 - slack))]), rtol=1e-9, atol=0)
            assert offset or len(found) < (high - low + 0.01) * t.size
    assert torque.near_torques({**a, "m": a["m"] * 0}, b, 0.1, 0.2) is None
    assert torque.near_torques({**a, "v": a["v"] * 1e200}, b, 0.1, 0.2) is None


@pytest.mark.parametrize("power", [1.0, 2.0])
def test_pulls_of_close_far_and_equal_points_are_those_of_differences(power):
    rng = np.random.default_rng(13)
    for dimensions in (2, 64):
        v = rng.standard_normal((700, dimensions))
        v[1] *= 1000.0
        v[100:400:3] = v[400:700:3] + 1e-6 * rng.standard_normal((100, dimensions))
        v[5] = v[405]
        every = {"id": np.r_[0:400, 395:695], "v": v, "m": rng.random(700)}
        a, b = ({c: x[s] for c, x in every.items()} for s in (slice(400), slice(400, 700)))
        for far in (False, True):
            if far:
                b["v"][-1] = 1e200  # its squares are infinite, and it pulls nothing
            d = b["v"][None] - a["v"][:, None]
            with np.errstate(over="ignore"):
                w = b["m"] / ((d * d).sum(-1) ** (power / 2) + 1e-9) * (a["id"][:, None] != b["id"])
            want = np.einsum("ij,ijk->ik", w, d)
            fold = torque.Pull(power)
            got = fold.start(a)
            fold.step(got, a, b)
            assert np.allclose(got, want, rtol=1e-9, atol=1e-12 * np.abs(want).max())


def test_a_pull_costs_little_more_than_what_it_must_do():
    """Where every point has a close one: by components in the plane, and by two products and a division in 64 dimensions."""

    def seconds(f):
        return min((f(), time.perf_counter() - start)[1] for start in (time.perf_counter() for _ in range(4)))

    rng = np.random.default_rng(14)
    for dimensions in (2, 64):
        v = rng.standard_normal((2048, dimensions))
        a, b = ({"id": np.arange(2048) + s, "v": v[rng.permutation(2048)] + 1e-3 * rng.standard_normal(v.shape), "m": rng.random(2048)} for s in (0, 5000))

        def least(a=a, b=b, dimensions=dimensions):
            for k in range(0, 2048, 256):
                if dimensions == 2:
                    x, y = b["v"][:, 0] - a["v"][k : k + 256, 0, None], b["v"][:, 1] - a["v"][k : k + 256, 1, None]
                    w = b["m"] / (x * x + y * y + 1e-9)
                    np.einsum("ij,ij->i", w, x), np.einsum("ij,ij->i", w, y)
                else:
                    (1.0 / (a["v"][k : k + 256] @ b["v"].T + 1e-9)) @ b["v"]

        fold = torque.Pull(2.0)
        assert seconds(lambda: fold.step(fold.start(a), a, b)) < 2.5 * seconds(least)
