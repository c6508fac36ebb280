import numpy as np

from gyrolith.llm import neighbours


def plain(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            d = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = d[:k]
    return out


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items()) / max(1, sum(len(w) for w in want.values()))


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_of_the_query(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        got, want = answers(neighbours.op8_neighbours(spark, sf)), plain(rows, 10, 100)
        assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
        assert recall(got, want) >= 0.95
        for q, own in got.items():
            exact = dict((i, d) for d, i in plain([(a, b) for a, b in rows if a == q or a in {i for _, i in own}], 10, 1)[q])
            assert all(abs(exact[i] - d) <= 1e-12 for d, i in own) and own == sorted(own)


def test_ties_bad_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(0, 60)] + [(100, None), (200, [0.0, 0.0, 0.0]), (300, [1.0, nan, 2.0]), (400, [inf, 1.0, 1.0]), (500, [1.0, None, 2.0]),
            (600, [1.0, 2.0]), (700, [2.0, 2.0]), (None, [1.0, 2.0, 3.0]), (61, [1.0, 2.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert answers(neighbours.nearest(table)) == plain(rows, 10, 100)
    assert answers(neighbours.nearest(table, every=1)) == plain(rows, 10, 1)
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_repeated_rows(spark):
    """A row that is there many times is one candidate and one query, and hides no other row of its vector."""
    rows = [(0, [1.0, 2.0])] * 30 + [(1, [1.0, 2.0])] * 30 + [(2, [1.0, 2.0]), (3, [1.0, 3.0]), (3, [1.0, 3.0]), (4, [5.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = plain(sorted({(i, tuple(v)) for i, v in rows}), 10, 1)
    assert answers(neighbours.nearest(table, every=1)) == want and [i for _, i in want[0]] == [1, 2, 3, 4]
    assert answers(neighbours.nearest(table, k=2, every=1)) == {q: w[:2] for q, w in want.items()}
