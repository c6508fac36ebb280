"""What the operators share: parts of Arrow batches, the shared folder and what is written there, and free column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a worker turns into Python objects at once. Spark itself bounds an Arrow batch to 64 MB (spark.sql.execution.arrow.maxBytesPerBatch).
SLICE_ROWS, SLICE_BYTES = 500, 4 << 20

_scratch: list[list[tuple[SparkSession, str]]] = []


def slices(batches, column: int | str = 0, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, and bytes in one of their columns of texts; a longer row is a part by itself."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else ()
        at = 0
        while at < batch.num_rows:
            most = size + (ends[at - 1] if at else 0)
            n = max(1, min(rows, int(np.searchsorted(ends, most, "right")) - at))
            yield batch.slice(at, n)
            at += n


def free_names(columns, *wanted: str) -> list[str]:
    """The wanted names, longer where a column has one of them already, in any case."""
    taken, found = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; set only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gyrolith-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/gyrolith-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append((spark, path))
    return path


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def tidied():
    """Shared folders made within are deleted at the end, when all that was read from them has been written elsewhere."""
    _scratch.append([])
    try:
        yield
    finally:
        for spark, path in _scratch.pop():
            with suppress(Exception):  # a folder that can't be deleted is no reason to lose results
                removed(spark, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage ends here.

    With the lineage cut, the shuffle files behind it are of no more use and go as soon as the write ends.
    """
    conf, cleanup = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup, "false")
    conf.set(cleanup, "true")
    try:
        df = df.select("*")  # planned anew, under this setting
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(cleanup, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmap_bits(count: int) -> int:
    """Bits of a bitmap over so many values: 16 for each, a power of two from 2 ** 16 to 2 ** 28, so at most 32 MB."""
    return 1 << min(28, max(16, (16 * count).bit_length()))


def bitmap(places: DataFrame, bits: int) -> bytes:
    """The bits set at `places` (p, from 0); Spark makes it in pieces of 4096 bytes, which are put together here."""
    at = F.col("p") + 1
    parts = places.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = bytearray(bits // 8)
    for r in parts.collect():
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["bits"]
    return bytes(out)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text):
    """A-Z lower-cased and no other letter. Plain ASCII texts take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
