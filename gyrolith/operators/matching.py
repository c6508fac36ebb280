"""Pairs of files by name: equi-joins on candidate names, each with a priority, and the best candidate wins.

Names that hold other names are found by one gram a name. Where several are equally good the first by name is taken, whatever order a file system lists them in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolith.functions.grams import containing


def base_of(file: Column) -> Column:
    return F.regexp_replace(file, r"\.[^.]*$", "")


def without(name: Column, *parts: str) -> Column:
    for p in parts:
        name = F.replace(name, F.lit(p), F.lit(""))
    return name


def best(rows: DataFrame, key: str, *order) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def match_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(image, mask, exact): the mask of the same name, else the first whose cleaned base is the image's or whose name contains it."""
    left = images.select("image", base_of(F.col("image")).alias("b")).where("b <> ''")
    same = left.select("image").join(masks.select(F.col("mask").alias("image"), "mask"), "image").select("image", "mask", F.lit(True).alias("exact"))
    cleaned = masks.select("mask", without(base_of(F.col("mask")), "_stone_mask", "_mask").alias("b"))
    held = containing(left.select(F.col("image").alias("item"), F.col("b").alias("n")), masks.select(F.col("mask").alias("doc"), F.col("mask").alias("t")))
    near = left.join(cleaned, "b").select("image", "mask").unionByName(held.select(F.col("item").alias("image"), F.col("doc").alias("mask"))).withColumn("exact", F.lit(False))
    return best(same.unionByName(near), "image", F.col("exact").desc(), "mask")


def match_candidates(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(image, mask, priority): the first of folder/base_mask.npy, folder/base.npy, base_mask.npy and base.npy that is there.

    Images have their folder in a column of that name.
    """
    b = base_of(F.col("image"))
    names = [F.concat("folder", F.lit("/"), b, F.lit("_mask.npy")), F.concat("folder", F.lit("/"), b, F.lit(".npy")), F.concat(b, F.lit("_mask.npy")), F.concat(b, F.lit(".npy"))]
    rows = images.select("image", F.posexplode(F.array(*names)).alias("priority", "mask")).join(masks.select("mask"), "mask")
    return best(rows, "image", "priority").select("image", "mask", "priority")


# The extensions of annotated images, best first.
EXTENSIONS = ("png", "jpg", "jpeg", "PNG", "JPG")


def match_stems(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """(prediction, truth): the annotated image whose stem is the prediction's without `_mask`, by extension priority."""
    stem = without(base_of(F.col("prediction")), "_mask")
    names = F.array(*(F.concat(stem, F.lit(f".{e}")) for e in EXTENSIONS))
    rows = predictions.select("prediction", F.posexplode(names).alias("priority", "truth")).join(truths.select("truth"), "truth")
    return best(rows, "prediction", "priority").select("prediction", "truth")


def match_patterns(truths: DataFrame, predictions: DataFrame, arrays: bool = True) -> DataFrame:
    """(truth, prediction): the prediction, by its path below the predictions' folder, of each annotated image.

    Four fixed places come first: stone_mask in a folder of the cleaned stem, or of the whole stem, then <clean>_stone_mask and
    <clean> beside them; then, at any depth, names that start with the cleaned stem and have `stone` after it, and
    last names that hold the cleaned stem, and `stone` in any case. With `arrays` false, PNG files are looked for, and neither
    the fourth place nor the last kind counts. Stems that are empty when cleaned match nothing.
    """
    end = ".npy" if arrays else ".png"
    base = base_of(F.col("truth"))
    left = truths.select("truth", base.alias("base"), without(base, "_gt", "_ground_truth", "_annotated", "_mask").alias("clean")).where("clean <> ''")
    at = [F.concat("clean", F.lit(f"/stone_mask{end}")), F.concat("base", F.lit(f"/stone_mask{end}")), F.concat("clean", F.lit(f"_stone_mask{end}"))]
    at += [F.concat("clean", F.lit(end))] if arrays else []
    files = predictions.select("prediction").where(F.col("prediction").endswith(end))
    fixed = left.select("truth", F.posexplode(F.array(*at)).alias("priority", "prediction")).join(files, "prediction")

    name = F.element_at(F.split("prediction", "/"), -1)
    named = files.withColumn("name", F.expr(f"left(element_at(split(prediction, '/'), -1), length(element_at(split(prediction, '/'), -1)) - {len(end)})")).where(F.contains(F.lower(name), F.lit("stone")))
    held = containing(left.select(F.col("truth").alias("item"), F.col("clean").alias("n")), named.select(F.col("prediction").alias("doc"), F.col("name").alias("t")))
    held = held.select(F.col("item").alias("truth"), F.col("doc").alias("prediction")).join(left.select("truth", "clean"), "truth").join(named, "prediction")
    rest = F.expr("substring(name, length(clean) + 1)")
    kind = F.when(F.startswith("name", "clean") & F.contains(rest, F.lit("stone")), 4)
    loose = held.withColumn("priority", kind.otherwise(5) if arrays else kind).where("priority IS NOT NULL")
    rows = fixed.select("truth", "priority", "prediction").unionByName(loose.select("truth", "priority", "prediction"))
    return best(rows, "truth", "priority", "prediction").select("truth", "prediction")


def common_names(a: DataFrame, b: DataFrame, name: str = "image") -> DataFrame:
    return a.select(name).intersect(b.select(name))


def contained(needles: DataFrame, haystacks: DataFrame, needle: str = "text", haystack: str = "text") -> DataFrame:
    """(item_id, doc_id) where the haystack's text contains the needle's."""
    own = needles.select(F.col("item_id").alias("item"), F.col(needle).alias("n"))
    found = containing(own, haystacks.select(F.col("doc_id").alias("doc"), F.col(haystack).alias("t")))
    return found.select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"))
