import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrolith.llm import whitening


def plain(x, most=32):
    """(whitened, explained, deviation) by a full decomposition; components in order, signs free."""
    x = np.array(x, object)
    n, sums = len(x), x.sum(0)
    d = n * x - sums
    c = d.astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return c @ vectors / np.sqrt(values), values / (c * c).sum() * n, (d * d).sum(1)


def whole(v):
    return np.floor(64 * np.asarray(v, np.float32).astype(float)).astype(np.int64) + 1_000_000


def close(got, want, tolerance):
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() <= tolerance


def test_the_query_against_a_full_decomposition(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    w, explained, deviation = plain([whole(r.embedding) for r in table])
    rows = whitening.op11_whitening(spark, sf).collect()
    at = {r.vec_id: k for k, r in enumerate(table)}
    assert len(rows) == len(table) * 32 == len({(r.vec_id, r.component) for r in rows})
    got = np.empty((len(table), 32))
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(table) and r.deviation == deviation[at[r.vec_id]] and abs(r.explained / explained[r.component - 1] - 1) < 1e-12
    close(got, w, 1e-7)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-11
    assert np.abs(got.T @ got / len(table) - np.eye(32)).max() < 1e-11


@pytest.mark.parametrize("dim, flat", [(200, False), (300, True)])
def test_blocks_much_smaller_than_the_space(dim, flat):
    rng = np.random.default_rng(1)
    a = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    values = np.linspace(1.3, 0.7, dim) if flat else 1.0 / np.arange(1, dim + 1)
    v = (a * values) @ a.T
    found, vectors, residual, products = whitening.lobpcg(lambda b: v @ b, dim, 12, block=20)
    assert residual <= 1e-13 and 3 < products < 400
    assert np.abs(found - values[:12]).max() < 1e-13 * 5 and np.abs(np.abs((vectors * a[:, :12]).sum(0)) - 1).max() < 1e-9


def test_it_says_so_when_residuals_stay_large():
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda b: np.diag(np.linspace(1, 0.9, 100)) @ b, 100, 4, block=4, steps=3)


def test_sums_in_a_tree_of_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "WIDTH", 3)
    spark.range(40).select(F.array(F.col("id"), F.col("id") * 2).alias("x")).repartition(20).write.parquet(str(tmp_path / "x"))
    total = whitening.gathered(spark.read.parquet(str(tmp_path / "x")), 2, lambda x: x.sum(0))
    assert total.tolist() == [780, 1560]


NAN, INF = float("nan"), float("inf")


def test_bad_vectors_lengths_repeats_flat_dimensions_and_clashing_names(spark):
    rng = np.random.default_rng(3)
    good = [(k, rng.standard_normal(3).tolist()) for k in range(50)]
    good += [good[0], good[1], (None, [0.5, 0.25, 0.125])]
    two = [(100 + k, [float(k % 7), 2.5]) for k in range(20)]  # the second dimension never varies
    bad = [(60, None), (61, [1.0, None, 2.0]), (62, [1.0, NAN, 2.0]), (63, [INF, 1.0, 2.0]), (64, []), (65, [1.0, 2.0, 3.0, 4.0])]
    table = spark.createDataFrame(good + two + bad, "vec_id long, embedding array<float>")
    names = ("x", "id", "dim", "n", "deviation", "whitened", "component")
    table = table.select("*", *(F.lit("own").alias(c) for c in names)).withColumn("x", whitening.whole(F.col("embedding"), 64.0, 1_000_000))
    rows = whitening.whiten(table, "vec_id", "x").collect()
    assert len(rows) == len(good) + len(two)  # a length of one row, and empty vectors, have no component
    w, explained, deviation = plain([whole(v) for _, v in good])
    mine = sorted((r for r in rows if len(r.whitened) == 3), key=lambda r: r.deviation)
    order = np.argsort(np.array(deviation, float), kind="stable")
    assert [r.deviation for r in mine] == sorted(deviation) and {r.n for r in mine} == {len(good)} and sum(r.vec_id is None for r in mine) == 1
    close(np.array([r.whitened for r in mine])[[0, 5, 9]], w[order][[0, 5, 9]], 1e-9)
    assert {len(r.whitened) for r in rows if (r.vec_id or 0) >= 100} == {1}
    assert whitening.whiten(table.limit(0), "vec_id", "x").count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(k, [(1 << 52) - 7 * k, -(1 << 51) + k * k]) for k in range(9)]
    got = {r.id: r for r in whitening.whiten(spark.createDataFrame(rows, "id long, x array<long>"), "id", "x").collect()}
    w, _, deviation = plain([x for _, x in rows])
    assert [got[k].deviation for k in range(9)] == deviation.tolist()
    close(np.array([got[k].whitened for k in range(9)]), w, 1e-9)
    d = np.array([[3 << 40, 5]], object)
    assert whitening.deviations(d) == [None] and whitening.deviations(np.array([[3, 4]])) == [25]
    with pytest.raises(Exception, match="2 \\*\\* 53"):
        whitening.whiten(spark.createDataFrame([(1, [1 << 60]), (2, [5])], "id long, x array<long>"), "id", "x")
