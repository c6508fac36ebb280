import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gyrolith.llm import common


def test_slices_by_rows_and_bytes():
    texts = ["x" * 10, None, "", "y" * 95, "z" * 300, "a", "b"] + ["c"] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    parts = list(common.slices([batch, batch.slice(0, 0)], "t", rows=4, size=100))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 100) for p in parts)
    assert any(p.num_rows == 1 and len(p.column(1)[0].as_py()) == 300 for p in parts)


def test_free_names():
    assert common.free_names(["A", "__r1", "__R1_", "b"], "__r1", "a", "c", "c") == ["__r1__", "a_", "c", "c_"]


def test_written_restores_the_setting_and_folders_go(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    with pytest.raises(Exception, match="DIVIDE|divide"):
        common.written(spark.range(3).select((1 / (F.col("id") - F.col("id"))).alias("x")), f"{common.shared_folder(spark)}/x")
    assert spark.conf.get(key, "false") == before
    with common.tidied():
        folder = common.shared_folder(spark)
        table = common.written(spark.range(5), f"{folder}/x")
        assert table.count() == 5
        local = folder.removeprefix("file://")
        assert os.path.isdir(local)
    assert not os.path.isdir(local)


def test_arrow_batches_are_bounded_without_a_setting(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t")).mapInArrow(sizes, "n long").collect()
    assert max(r.n for r in rows) < 80 << 20
