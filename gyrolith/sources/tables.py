"""Tables that the operators read and write: schemas, scans of masks and metadata, file listings, and sinks."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable
from contextlib import suppress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIXELS = "image string, y int, x int, v double"
MASK = "image string, y int, x int"
SIZES = "image string, h int, w int"
DETECTIONS = "filename string, image_shape array<int>, num_detections int, bboxes array<array<double>>, confidence_scores array<double>, class_ids array<double>, segmentation_labels int"

# The extensions of image files.
IMAGES = ("png", "jpg", "jpeg", "tif", "bmp")


_scratch: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local one is made only for a local session that has none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gyrolith-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/gyrolith-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder, read again, so that lineage ends and nothing is computed twice.

    The shuffle files behind it are of no more use and go as soon as the write ends.
    """
    path = path or shared_folder(df.sparkSession)
    conf, cleanup = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup, "false")
    conf.set(cleanup, "true")
    try:
        df.select("*").write.mode("overwrite").parquet(path)  # planned anew, under this setting
    finally:
        conf.set(cleanup, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def tidied(spark: SparkSession, rows: Callable[[], DataFrame]) -> DataFrame:
    """What `rows` gives, written where it made tables on the way; these go, also when it fails."""
    _scratch.append([])
    made: list[str] = []
    try:
        found = rows()
        made = _scratch.pop()
        return written(found) if made else found
    except BaseException:
        made = made or _scratch.pop()
        raise
    finally:
        for path in made:
            with suppress(Exception):  # a folder that can't be deleted is no reason to lose results
                removed(spark, path)


def starts(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """The rows of distinct keys with `start`, the sum of the sizes before theirs in order of the keys; ranges are summed apart and then shifted."""
    ranged = written(sizes.repartitionByRange(F.col(key)).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(F.sum(size).alias("__sum"))  # a row for each partition
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(totals.select("__part", before(Window.orderBy("__part"), "__sum").alias("__before")))
    own = ranged.withColumn("start", before(Window.partitionBy("__part").orderBy(key), size))
    return own.join(shift, "__part").withColumn("start", F.col("start") + F.col("__before")).drop("__part", "__before")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, label) of the embeddings, with double components."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


def small_images(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    """(image, y, x, v): every embedding read as an image of `width` columns, row by row."""
    rows = vectors(spark, sf_dir).select(F.col("id").alias("image"), F.posexplode("v").alias("at", "v"))
    return rows.select("image", F.expr(f"CAST(at DIV {width} AS INT)").alias("y"), (F.col("at") % width).cast("int").alias("x"), "v")


def list_files(spark: SparkSession, path: str, extensions=IMAGES, recursive: bool = False, any_case: bool = True) -> DataFrame:
    """(path, file) of the files with one of the extensions, each once; order rows by file where order counts."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path")
    rows = rows.withColumn("file", F.element_at(F.split("path", "/"), -1)).dropDuplicates(["path"])
    name = F.lower("file") if any_case else F.col("file")
    return rows.where(name.rlike(r"\.(" + "|".join(extensions) + ")$"))


def list_truths(spark: SparkSession, path: str, extensions=("jpg", "png", "jpeg")) -> DataFrame:
    """(path, file, stem, priority) of the annotated images in a folder itself, endings as they are written.

    Priority is the ending's place in the list, from 0: images go by priority, then file. Each file is a row, also where stems are equal.
    """
    ending = F.array_position(F.array(*map(F.lit, extensions)), F.regexp_extract("file", r"\.([^.]+)$", 1))
    rows = list_files(spark, path, extensions, any_case=False)
    return rows.select("path", "file", F.regexp_replace("file", r"\.[^.]+$", "").alias("stem"), (ending - 1).cast("int").alias("priority"))


def array_rows(name: str, content: bytes, above: float, luma: bool) -> pd.DataFrame:
    a = np.load(io.BytesIO(content), allow_pickle=False)
    if a.ndim == 3:
        if a.shape[2] != 3:
            a = a[:, :, 0]
        else:
            a = np.floor(a.astype(np.uint8) @ (0.299, 0.587, 0.114) + 0.5) if luma else a.max(axis=2)
    y, x = np.indices(a.shape)
    return pd.DataFrame({"image": name.rsplit("/", 1)[-1], "y": y.ravel(), "x": x.ravel(), "v": (a.ravel() > above).astype(float)})


def files_of(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "content")


def read_arrays(spark: SparkSession, path: str, above: float = 0.0, recursive: bool = False, pattern: str = "*.npy", luma: bool = True) -> DataFrame:
    """(image, y, x, v) of `.npy` files, `*_mask.npy` being those of predictions: values above the threshold as 1.

    Of three channels their luma counts, rounded, or with `luma` false any of them; of other numbers of channels the first.
    """

    def decode(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield array_rows(name, content, above, luma)

    return files_of(spark, path, pattern, recursive).mapInPandas(decode, PIXELS)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETECTIONS).json(path, multiLine=True)


def boxes_of(detections: DataFrame) -> DataFrame:
    """(image, box, x1, y1, x2, y2), whole numbers."""
    rows = detections.select(F.col("filename").alias("image"), F.posexplode("bboxes").alias("box", "b"))
    return rows.select("image", "box", *(F.col("b")[k].cast("int").alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_files(files: DataFrame, path: str) -> int:
    """Writes each row (file, content) as a file below `path`, which all tasks and the driver share; gives their number.

    A task writes under a name of its own first, so that a task that is run again leaves no half file.
    """

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        mark, n = TaskContext.get().taskAttemptId(), 0
        target, root = fs.FileSystem.from_uri(path)
        target.create_dir(root, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                own = f"{root}/_{mark}-{name}"
                with target.open_output_stream(own) as out:
                    out.write(content)
                target.move(own, f"{root}/{name}")
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select("file", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def as_arrays(labels: DataFrame) -> DataFrame:
    """(file, content) of `.npy` files for dense label maps (image, y, x, v), named <image>_mask.npy; one picture in one task."""

    def encode(a: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.save(out, a)
        return out.getvalue()

    return encoded(labels, encode, "_mask.npy")


def encoded(labels: DataFrame, encode, ending: str) -> DataFrame:
    """(file, content) of each image's array of whole numbers, by `encode`."""
    from gyrolith.functions.blocks import codes, over_images

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(of=codes(pdf["image"])).sort_values(["of", "y", "x"], kind="stable")
        parts = [(one["image"].iloc[0], one["v"].to_numpy(np.int32).reshape(int(one["y"].max()) + 1, -1)) for _, one in pdf.groupby("of", sort=True)]
        return pd.DataFrame({"file": [f"{name}{ending}" for name, _ in parts], "content": [encode(a) for _, a in parts]})

    rows = labels.select(F.col("image").cast("string").alias("image"), "y", "x", F.col("v").cast("int").alias("v"))
    return over_images(rows, run, "file string, content binary")
