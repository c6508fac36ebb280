"""Images clustered by two features: mean value and texture within their masks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolith.operators import features, torque
from gyrolith.sources.tables import written


def image_features(pixels: DataFrame, mask) -> DataFrame:
    """(image, mean_value, contrast) of each image's mask."""
    return features.masked_mean(pixels, mask).join(features.texture_contrast(pixels, mask), "image")


def train_and_evaluate(parts: dict[str, DataFrame], method: str = "connection", **settings) -> DataFrame:
    """(part, n, ari, nmi) for parts of points (id, v, label): each is clustered on its own and held against its labels."""
    rows = []
    for name, points in parts.items():
        labels, _ = torque.cluster(points, method, **settings)
        both = labels.join(points.select("id", F.col("label").alias("truth")), "id")
        rows.append(torque.agreement(both, "truth", "cluster").select(F.lit(name).alias("part"), "n", "ari", "nmi"))
    return reduce(DataFrame.unionAll, rows)


def blobs(spark: SparkSession, n: int = 300, centres: int = 3, dimensions: int = 2, deviation: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, v, label): points dealt in turn to centres drawn from [-10, 10), with normal noise; the same for equal arguments."""
    at = np.random.default_rng(seed).uniform(-10, 10, (centres, dimensions))

    def run(batches):
        for pdf in batches:
            label = pdf["id"].to_numpy() % centres
            noise = np.stack([np.random.default_rng((seed, int(k))).standard_normal(dimensions) for k in pdf["id"]]) if len(pdf) else np.empty((0, dimensions))
            yield pd.DataFrame({"id": pdf["id"], "v": list(at[label] + deviation * noise), "label": label})

    return spark.range(n).mapInPandas(run, "id long, v array<double>, label long")


def cluster_images(table: DataFrame, n_clusters: int = 2, **steps) -> DataFrame:
    """The feature table's valid rows with their cluster, by torque steps on standardised features and k-means."""
    points = written(table.select(F.xxhash64("image").alias("id"), "image", F.array("mean_value", "contrast").alias("v")))
    valid = written(features.valid_rows(points))
    z = features.z_scores(valid).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "z"))).alias("s")).select("id", F.transform("s", lambda s: s["z"]).alias("v"))
    labels, _ = torque.cluster(z, "iterative", "density", n_clusters=n_clusters, **steps)
    return table.join(valid.select("id", "image"), "image").join(labels, "id").select("image", "mean_value", "contrast", "cluster")
