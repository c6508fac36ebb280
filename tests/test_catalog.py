import math
import os

import duckdb
import pytest

from gyrolith.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    want = duck.execute(catalog.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted([value(r[k]) for k in at] for r in want.fetchall())
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    got = sorted([value(r[c]) for c in columns] for r in df.collect())
    assert len(got) == len(rows) > 0
    for a, b in zip(got, rows, strict=True):
        assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, name):
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_fit_regions_has_a_row_for_every_region(spark):
    sf = "/root/testdata/sf0.001"
    sizes = {r["image"]: r["count"] for r in catalog.regions(spark, sf).groupBy("image").count().collect()}
    got = catalog.fit_regions(spark, sf).collect()
    assert len(got) == sum(sizes.values())
    assert all((r["cluster"] is None) == (5 <= sizes[r["image"]] <= 9) for r in got)
