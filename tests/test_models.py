"""Models over tables of points against those of one array, given the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrolith.operators import centre_torque
from gyrolith.sources.tables import vectors


class Same:
    """Draws of a table's points, for the version on one array: the same uniform numbers, read from Spark."""

    def __init__(self, points, seed):
        self.points, self.draws = points, centre_torque.Draws(seed)

    def _key(self):
        u = np.array([r[0] for r in self.points.select("id", self.draws.uniform().alias("u")).orderBy("id").select("u").collect()])
        self.draws.number += 1
        return -np.log(u)

    def choice(self, n, p):
        with np.errstate(divide="ignore"):
            return int((self._key() / p).argmin())

    def integers(self, n):
        return int(self._key().argmin())


def test_a_model_of_all_embeddings_is_that_of_one_array(spark):
    points = vectors(spark, "/root/testdata/sf0.1").select("id", "v").cache()
    x = np.array([r.v for r in points.orderBy("id").collect()])
    settings = centre_torque.Settings(rounds=3)
    labels, _ = centre_torque.fit_k(x, 3, settings, Same(points, settings.seed))
    got = centre_torque.fit_points(points, 3, settings).orderBy("id").collect()
    assert len(x) == 2000 and [r.cluster for r in got] == labels.tolist() and len(set(labels.tolist())) > 1


def test_selection_empty_clusters_and_few_points(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (20, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").cache()
    settings = centre_torque.Settings(most_k=4, rounds=5)
    labels, k = centre_torque.fit_best_points(points, settings)
    found = np.array([r.cluster for r in labels.orderBy("id").collect()])
    assert k == 3 and all(len(set(found[a : a + 20].tolist())) == 1 for a in (0, 20, 40))
    same = points.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    assert {r.cluster for r in centre_torque.fit_points(same, 2, settings).collect()} == {0}
    assert centre_torque.fit_best_points(points.limit(3))[1] == 1
    with pytest.raises(ValueError):
        centre_torque.fit_best_points(points.limit(7))
