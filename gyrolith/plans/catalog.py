"""Registered queries over the reference operators, each with DuckDB SQL for the same rows where SQL can state them.

The driver's tables stand in for the inputs: an embedding is a point of 64 dimensions, and also an image of 8 x 8 pixels.
Doubles are rounded alike on both sides; adding 0.0 turns -0.0 into 0.0.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from functools import reduce, wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrolith.operators import annotations, centre_torque, components, features, matching, metrics, raster, torque
from gyrolith.plans import clustering, segmentation
from gyrolith.sources import png
from gyrolith.sources.tables import DETECTIONS, as_arrays, boxes_of, encoded, list_files, list_truths, read_arrays, shared_folder, small_images, tidied, vectors, write_csv, write_files, write_json, written

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = wraps(f)(lambda spark, sf_dir: tidied(spark, lambda: f(spark, sf_dir)))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


# Points

POINTS = "p AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
CELLS = POINTS + ", e AS (SELECT id, label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM p)"
PAIRS = POINTS + ", d AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM p a, p b)"
MASS = PAIRS + """, k AS (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) - 1 AS r FROM d),
q AS (SELECT i AS id, 1 / (avg(d) + 1e-9) AS raw FROM k WHERE r BETWEEN 1 AND 5 GROUP BY i), m AS (SELECT id, raw / sum(raw) OVER () AS m FROM q)"""
HEAVIER = MASS + """, h AS (SELECT d.i AS id, d.j AS parent, d.d FROM d JOIN m a ON a.id = d.i JOIN m b ON b.id = d.j WHERE b.m > a.m
  QUALIFY row_number() OVER (PARTITION BY d.i ORDER BY d.d, d.j) = 1),
t AS (SELECT h.id, parent, d, a.m * b.m / (d * d + 1e-9) AS torque FROM h JOIN m a ON a.id = h.id JOIN m b ON b.id = parent)"""
MATRIX = MASS + ", f AS (SELECT a.m * b.m / (d.d * d.d + 1e-9) AS t FROM d JOIN m a ON a.id = d.i JOIN m b ON b.id = d.j)"


def clusters_sql(threshold: str, head: str = HEAVIER) -> str:
    return head.replace("WITH ", "") + f""", u AS (SELECT p.id, t.parent FROM p LEFT JOIN t ON t.id = p.id AND t.torque <= {threshold}),
w AS (SELECT id, id AS a FROM u UNION ALL SELECT w.id, u.parent FROM w JOIN u ON u.id = w.a WHERE u.parent IS NOT NULL),
l AS (SELECT a AS id, min(id) AS least FROM w GROUP BY a), c AS (SELECT id, dense_rank() OVER (ORDER BY least) - 1 AS cluster FROM l)"""


def weighed(spark, sf_dir):
    points = written(vectors(spark, sf_dir).select("id", "v"))
    return written(points.join(torque.mass(points, "density"), "id"))


@registered(f"WITH {POINTS} SELECT id FROM p WHERE len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0")
def valid_rows(spark, sf_dir):
    return features.valid_rows(vectors(spark, sf_dir)).select("id")


@registered(f"WITH {CELLS}, s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY pos) SELECT id, pos, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS z FROM e JOIN s USING (pos)")
def zscore_a(spark, sf_dir):
    return features.z_scores(vectors(spark, sf_dir)).select("id", F.col("pos").cast("long").alias("pos"), rounded("z").alias("z"))


@registered(f"WITH {CELLS}, s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY pos) SELECT id, pos, round(CASE WHEN s > 1e-10 THEN (x - m) / s ELSE x END, 6) + 0.0 AS z FROM e JOIN s USING (pos)")
def zscore_b(spark, sf_dir):
    return features.z_scores(vectors(spark, sf_dir), False).select("id", F.col("pos").cast("long").alias("pos"), rounded("z").alias("z"))


@registered(f"WITH {POINTS} SELECT id, 1.0::DOUBLE AS m FROM p")
def mass_uniform(spark, sf_dir):
    return torque.mass(vectors(spark, sf_dir), "uniform")


@registered(f"WITH {MASS} SELECT id, round(m, 9) AS m FROM m")
def mass_density(spark, sf_dir):
    return torque.mass(vectors(spark, sf_dir), "density").select("id", rounded("m", 9).alias("m"))


@registered(f"WITH {CELLS}, r AS (SELECT id, sum(abs(x)) AS raw FROM e GROUP BY id) SELECT id, round(raw / sum(raw) OVER (), 9) AS m FROM r")
def mass_feature_sum(spark, sf_dir):
    return torque.mass(vectors(spark, sf_dir), "feature_sum").select("id", rounded("m", 9).alias("m"))


@registered(f"WITH {CELLS}, r AS (SELECT id, var_pop(x) AS raw FROM e GROUP BY id) SELECT id, round(raw / sum(raw) OVER (), 9) AS m FROM r")
def mass_feature_variance(spark, sf_dir):
    return torque.mass(vectors(spark, sf_dir), "feature_variance").select("id", rounded("m", 9).alias("m"))


@registered(f"WITH {PAIRS} SELECT i AS id, round(min(CASE WHEN i <> j THEN d END), 6) AS nearest, round(max(d), 6) AS farthest, round(sum(d), 6) AS total FROM d GROUP BY i")
def distance_summary(spark, sf_dir):
    rows = torque.distance_summary(vectors(spark, sf_dir).select("id", "v"))
    return rows.select("id", *(rounded(c).alias(c) for c in ("nearest", "farthest", "total")))


def pull_sql(power: str) -> str:
    return f"""WITH {MASS}, c AS (SELECT id, unnest(range(len(v))) AS pos, unnest(v) AS x FROM p), w AS (SELECT i, j, m / (d ** {power} + 1e-9) AS w FROM d JOIN m ON m.id = j WHERE i <> j)
SELECT i AS id, a.pos, round(sum(w * (b.x - a.x)), 6) + 0.0 AS t FROM w JOIN c a ON a.id = i JOIN c b ON b.id = j AND b.pos = a.pos GROUP BY i, a.pos"""


def long_torque(rows):
    return rows.select("id", F.posexplode("t").alias("pos", "t")).select("id", F.col("pos").cast("long").alias("pos"), rounded("t").alias("t"))


@registered(pull_sql("2"))
def torque_step_all(spark, sf_dir):
    return long_torque(torque.torque(weighed(spark, sf_dir)))


@registered(pull_sql("1"))
def torque_step_linear(spark, sf_dir):
    return long_torque(torque.torque(weighed(spark, sf_dir), power=1.0))


@registered(f"""WITH {MASS}, c AS (SELECT id, unnest(range(len(v))) AS pos, unnest(v) AS x FROM p), n AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) - 1 AS r FROM d),
w AS (SELECT i, j, m / (d ** 2 + 1e-9) AS w FROM n JOIN m ON m.id = j WHERE r BETWEEN 1 AND 10)
SELECT i AS id, a.pos, round(sum(w * (b.x - a.x)) / sum(w), 6) + 0.0 AS t FROM w JOIN c a ON a.id = i JOIN c b ON b.id = j AND b.pos = a.pos GROUP BY i, a.pos""")
def torque_step_knn(spark, sf_dir):
    return long_torque(torque.torque(weighed(spark, sf_dir), neighbours=10))


@registered(f"""WITH {MASS}, c0 AS (SELECT id, unnest(range(len(v))) AS pos, unnest(v) AS x FROM p),
w0 AS (SELECT i, j, m / (d ** 2 + 1e-9) AS w FROM d JOIN m ON m.id = j WHERE i <> j),
c1 AS (SELECT i AS id, a.pos, any_value(a.x) + 0.01 * sum(w * (b.x - a.x)) AS x FROM w0 JOIN c0 a ON a.id = i JOIN c0 b ON b.id = j AND b.pos = a.pos GROUP BY i, a.pos),
d1 AS (SELECT a.id AS i, b.id AS j, sqrt(sum((a.x - b.x) ** 2)) AS d FROM c1 a JOIN c1 b USING (pos) GROUP BY 1, 2),
w1 AS (SELECT i, j, m / (d ** 2 + 1e-9) AS w FROM d1 JOIN m ON m.id = j WHERE i <> j)
SELECT i AS id, a.pos, round(any_value(a.x) + 0.01 * sum(w * (b.x - a.x)), 6) + 0.0 AS x FROM w1 JOIN c1 a ON a.id = i JOIN c1 b ON b.id = j AND b.pos = a.pos GROUP BY i, a.pos""")
def iterative_2steps(spark, sf_dir):
    rows = torque.iterate(weighed(spark, sf_dir), rounds=2, tolerance=0.0)
    return rows.select("id", F.posexplode("v").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), rounded("x").alias("x"))


@registered()
def iterative_kmeans(spark, sf_dir):
    """k-means on the places that points have when the iteration stops by itself."""
    return torque.cluster(vectors(spark, sf_dir), "iterative", n_clusters=10)[0]


TRIPLES = MASS.replace(POINTS, "p AS (SELECT a.vec_id AS id, CAST(a.label AS BIGINT) AS label, CAST(b.embedding AS DOUBLE[]) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 3)")


@registered(f"""WITH {TRIPLES}, c0 AS (SELECT id, unnest(range(len(v))) AS pos, unnest(v) AS x FROM p),
w0 AS (SELECT i, j, m / (d ** 2 + 1e-9) AS w FROM d JOIN m ON m.id = j WHERE i <> j),
c1 AS (SELECT i AS id, a.pos, any_value(a.x) + 0.01 * sum(w * (b.x - a.x)) AS x FROM w0 JOIN c0 a ON a.id = i JOIN c0 b ON b.id = j AND b.pos = a.pos GROUP BY i, a.pos),
s1 AS (SELECT id, list(round(x, 9) + 0.0 ORDER BY pos) AS v FROM c1 GROUP BY id) SELECT a.id, min(b.id) AS cluster FROM s1 a JOIN s1 b ON a.v = b.v GROUP BY a.id""")
def iterative_nearest(spark, sf_dir):
    """The iteration without a number of clusters, after one step: the first of the points at the same place. Each three ids have one vector; places are rounded, as sums differ in their last bits."""
    rows = vectors(spark, sf_dir).select("id", "v")
    points = written(rows.select("id", (F.col("id") - F.col("id") % 3).alias("of")).join(rows.withColumnRenamed("id", "of"), "of").select("id", "v"))
    weighed = written(points.join(torque.mass(points, "density"), "id"))
    places = torque.iterate(weighed, rounds=1).select("id", F.transform("v", lambda x: rounded(x, 9)).alias("v"))
    return torque.coincident_labels(places)


@registered(f"WITH {HEAVIER} SELECT p.id, h.parent, round(h.d, 6) AS d FROM p LEFT JOIN h ON h.id = p.id")
def nearest_heavier(spark, sf_dir):
    return torque.nearest_heavier(weighed(spark, sf_dir)).select("id", "parent", rounded("d").alias("d"))


@registered(f"WITH {HEAVIER} SELECT id, parent, round(torque * 1e6, 6) AS torque FROM t")
def edge_torques(spark, sf_dir):
    points = weighed(spark, sf_dir)
    return torque.edge_torques(points, torque.nearest_heavier(points)).select("id", "parent", rounded(F.col("torque") * 1e6).alias("torque"))


@registered(f"WITH {MATRIX} SELECT round(avg(t), 6) AS mean, round(quantile_cont(t, 0.5) * 1e6, 6) AS median FROM f")
def torque_thresholds(spark, sf_dir):
    points = weighed(spark, sf_dir)
    row = (torque.threshold_of(points, "mean"), torque.threshold_of(points, "median") * 1e6)
    return spark.createDataFrame([row], "mean double, median double").select(rounded("mean").alias("mean"), rounded("median").alias("median"))


def numeric(points) -> float:
    """A threshold that cuts some links pos every size: torques fall with the square of the number of points."""
    return 0.79 / points.count() ** 2


@registered(f"WITH RECURSIVE {clusters_sql('(SELECT 0.79 / (count(*) * count(*)) FROM p)')} SELECT id, cluster FROM c")
def connection_labels(spark, sf_dir):
    points = weighed(spark, sf_dir)
    return torque.connection_clusters(points, numeric(points))


@registered(f"WITH RECURSIVE {clusters_sql('(SELECT quantile_cont(t, 0.5) FROM f)', HEAVIER + MATRIX[len(MASS):])} SELECT id, cluster FROM c")
def connection_median(spark, sf_dir):
    return torque.connection_clusters(weighed(spark, sf_dir), "median")


@registered(f"WITH RECURSIVE {clusters_sql('(SELECT avg(t) FROM f)', HEAVIER + MATRIX[len(MASS):])} SELECT id, cluster FROM c")
def connection_mean(spark, sf_dir):
    return torque.connection_clusters(weighed(spark, sf_dir), "mean")


AGREEMENT = """g AS (SELECT sum(k) AS n, sum(k * (k - 1) / 2) AS i FROM (SELECT count(*) AS k FROM r GROUP BY truth, found)),
s1 AS (SELECT truth, count(*) AS k FROM r GROUP BY truth), s2 AS (SELECT found, count(*) AS k FROM r GROUP BY found),
o AS (SELECT truth, found, count(*) AS k FROM r GROUP BY truth, found),
y AS (SELECT n, i, (SELECT sum(k * (k - 1) / 2) FROM s1) AS a, (SELECT sum(k * (k - 1) / 2) FROM s2) AS b,
  (SELECT -sum(k / n * ln(k / n)) FROM s1) AS h1, (SELECT -sum(k / n * ln(k / n)) FROM s2) AS h2,
  (SELECT sum(o.k / n * ln(n * o.k / (s1.k * s2.k))) FROM o JOIN s1 USING (truth) JOIN s2 USING (found)) AS mi FROM g)
SELECT CAST(n AS BIGINT) AS n, round((i - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) + 0.0 AS ari, round(mi / ((h1 + h2) / 2), 6) + 0.0 AS nmi FROM y"""


@registered(f"WITH RECURSIVE {clusters_sql('(SELECT 0.79 / (count(*) * count(*)) FROM p)')}, r AS (SELECT p.label AS truth, c.cluster AS found FROM p JOIN c USING (id)), {AGREEMENT}")
def flagship(spark, sf_dir):
    """Density masses, links to the nearest heavier point, cut at a number, clusters, and their agreement with the labels."""
    labels = connection_labels(spark, sf_dir).join(vectors(spark, sf_dir).select("id", "label"), "id")
    found = torque.agreement(labels.select(F.col("label").alias("truth"), F.col("cluster").alias("found")))
    return found.select("n", rounded("ari").alias("ari"), rounded("nmi").alias("nmi"))


# Points with clusters and centres

CENTRES = CELLS + ", z AS (SELECT label AS k, pos, avg(x) AS c FROM e GROUP BY label, pos)"
WEIGHTS = CENTRES + """, g AS (SELECT e.id, z.k, sqrt(sum((x - c) ** 2)) AS d FROM e JOIN z USING (pos) GROUP BY e.id, z.k),
w AS (SELECT *, (1 / greatest(d, 1e-10) ** 2) / sum(1 / greatest(d, 1e-10) ** 2) OVER (PARTITION BY id) AS weight FROM g),
o AS (SELECT *, max(weight) OVER (PARTITION BY id) - min(weight) OVER (PARTITION BY id) AS torque FROM w)"""


def labelled(spark, sf_dir):
    return vectors(spark, sf_dir).withColumnRenamed("label", "cluster")


@registered(f"""WITH {CELLS}, d AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM p a, p b),
h AS (SELECT greatest(1e-6, stddev_pop(x) * (SELECT count(*) FROM p) ** (-1.0 / 68)) AS h FROM e) SELECT i AS id, round(sum(exp(-0.5 * (d / h) ** 2)), 6) AS density FROM d, h GROUP BY i""")
def gaussian_density(spark, sf_dir):
    return centre_torque.density(vectors(spark, sf_dir).select("id", "v")).select("id", rounded("density").alias("density"))


@registered(f"WITH {WEIGHTS} SELECT id, k, round(d, 6) AS d, round(weight, 6) AS weight, round(torque, 6) AS torque FROM o")
def force_weights(spark, sf_dir):
    points = labelled(spark, sf_dir)
    rows = centre_torque.force_weights(points, centre_torque.means(points))
    return rows.select("id", "k", *(rounded(c).alias(c) for c in ("d", "weight", "torque")))


@registered(f"WITH {WEIGHTS} SELECT id, k AS cluster FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY d * (1 - 0.5 * torque), k) = 1")
def centre_assign(spark, sf_dir):
    points = labelled(spark, sf_dir)
    return centre_torque.assign(points, centre_torque.means(points))


@registered(f"WITH {CENTRES} SELECT round(sum((x - c) ** 2), 6) AS inertia FROM e JOIN z ON z.k = e.label AND z.pos = e.pos")
def inertia(spark, sf_dir):
    points = labelled(spark, sf_dir)
    return centre_torque.inertia(points, centre_torque.means(points)).select(rounded("inertia").alias("inertia"))


@registered(f"""WITH {CELLS}, d AS (SELECT a.id AS i, a.label AS k, b.id AS j, list_distance(a.v, b.v) AS d FROM p a JOIN p b USING (label)),
w AS (SELECT i, k, sum(exp(-d / (s + 1e-10))) AS w FROM d JOIN (SELECT k, quantile_cont(d, 0.5) AS s FROM d GROUP BY k) USING (k) GROUP BY i, k)
SELECT k, pos, round(sum(w * x) / sum(w), 6) + 0.0 AS c FROM w JOIN e ON e.id = w.i GROUP BY k, pos""")
def weighted_centres(spark, sf_dir):
    rows = centre_torque.weighted_centres(labelled(spark, sf_dir))
    return rows.select("k", F.posexplode("c").alias("pos", "c")).select("k", F.col("pos").cast("long").alias("pos"), rounded("c").alias("c"))


@registered(f"""WITH {CELLS}, s AS (SELECT id AS k, v AS c FROM p WHERE id < 4),
l AS (SELECT id, arg_min(k, struct_pack(d := d, k := k)) AS label, min(d) AS d FROM (SELECT p.id, s.k, list_distance(p.v, s.c) AS d FROM p, s) GROUP BY id),
d AS (SELECT a.id AS i, x.label AS k, list_distance(a.v, b.v) AS d FROM p a JOIN l x ON x.id = a.id JOIN l y ON y.label = x.label JOIN p b ON b.id = y.id),
w AS (SELECT i, k, sum(exp(-d / (s + 1e-10))) AS w FROM d JOIN (SELECT k, quantile_cont(d, 0.5) AS s FROM d GROUP BY k) USING (k) GROUP BY i, k)
SELECT k, pos, round(sum(w * x) / sum(w), 6) + 0.0 AS c FROM w JOIN e ON e.id = w.i GROUP BY k, pos""")
def model_step(spark, sf_dir):
    """One step of a model over all points: from the first four as centres to the weighted means of their clusters."""
    points = written(vectors(spark, sf_dir).select("id", "v"))
    seeds = [list(r["v"]) for r in points.where("id < 4").orderBy("id").collect()]
    found = centre_torque.weighted_centres(centre_torque.with_nearest(points, seeds).select("id", "v", F.col("cluster").cast("long").alias("cluster")))
    return found.select("k", F.posexplode("c").alias("pos", "c")).select("k", F.col("pos").cast("long").alias("pos"), rounded("c").alias("c"))


@registered(f"""WITH {POINTS}, d AS (SELECT a.id AS i, a.label AS own, b.label AS k, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM p a, p b GROUP BY 1, 2, 3),
s AS (SELECT i, max(CASE WHEN k = own THEN CASE WHEN n > 1 THEN t / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN k <> own THEN t / n END) AS b FROM d GROUP BY i)
SELECT round(avg(CASE WHEN b IS NULL THEN -1 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM s""")
def silhouette(spark, sf_dir):
    return centre_torque.silhouette(labelled(spark, sf_dir)).select(rounded("silhouette").alias("silhouette"))


# Images

PX = POINTS + ", px AS (SELECT id AS image, pos // 8 AS y, pos % 8 AS x, v FROM (SELECT id, unnest(range(len(v))) AS pos, unnest(v) AS v FROM p))"
MASKS = PX + ", mk AS (SELECT *, v > 0 AS found, v > avg(v) OVER (PARTITION BY image) AS truth FROM px)"


def pixel_rows(rows, *columns, digits: int = 6):
    return rows.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *(rounded(c, digits).alias(c) for c in columns))


def masks(spark, sf_dir):
    return small_images(spark, sf_dir).withColumns({"found": F.col("v") > 0, "truth": F.col("v") > F.avg("v").over(Window.partitionBy("image"))})


@registered(f"WITH {PX} SELECT image, round(coalesce(avg(v) FILTER (WHERE v > 0), 0), 6) AS mean_value FROM px GROUP BY image")
def masked_mean(spark, sf_dir):
    return features.masked_mean(small_images(spark, sf_dir), F.col("v") > 0).select("image", rounded("mean_value").alias("mean_value"))


@registered(f"""WITH {PX}, b AS (SELECT image, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2, min(v) AS lo, max(v) AS hi, count(*) AS n FROM px WHERE v > 0 GROUP BY image),
c AS (SELECT image, y, x, CASE WHEN v > 0 THEN floor((v - lo) / (hi - lo) * 31) ELSE 0 END AS q FROM px JOIN b USING (image) WHERE n >= 10 AND hi > lo AND y BETWEEN y1 AND y2 AND x BETWEEN x1 AND x2),
s AS (SELECT image, lead(q) OVER (PARTITION BY image, y ORDER BY x) - q AS s FROM c)
SELECT p.id AS image, round(coalesce(avg(s * s), 0), 6) AS contrast FROM p LEFT JOIN s ON s.image = p.id GROUP BY p.id""")
def glcm_contrast(spark, sf_dir):
    return features.texture_contrast(small_images(spark, sf_dir), F.col("v") > 0).select("image", rounded("contrast").alias("contrast"))


def square_sql(f: str, source: str, name: str, radius: int = 1) -> str:
    return f"""{name}x AS (SELECT image, y, x, {f}(v) OVER (PARTITION BY image, y ORDER BY x RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS v FROM {source}),
{name} AS (SELECT image, y, x, {f}(v) OVER (PARTITION BY image, x ORDER BY y RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS v FROM {name}x)"""


@registered(f"WITH {PX}, {square_sql('min', 'px', 'a')}, {square_sql('max', 'a', 'b')} SELECT image, y, x, round(v, 6) + 0.0 AS v FROM b")
def square_open(spark, sf_dir):
    return pixel_rows(raster.opened(small_images(spark, sf_dir), 1), "v")


@registered(f"WITH {PX}, {square_sql('max', 'px', 'a')}, {square_sql('min', 'a', 'b')} SELECT image, y, x, round(v, 6) + 0.0 AS v FROM b")
def square_close(spark, sf_dir):
    return pixel_rows(raster.closed(small_images(spark, sf_dir), 1), "v")


CONTRAST = f"{square_sql('min', 'px', 'lo', 2)}, {square_sql('max', 'px', 'hi', 2)}, ct AS (SELECT px.*, (px.v - lo.v) / (hi.v - lo.v + 1e-10) AS contrast FROM px JOIN lo USING (image, y, x) JOIN hi USING (image, y, x))"


@registered(f"WITH {PX}, {CONTRAST} SELECT image, y, x, round(contrast, 6) + 0.0 AS contrast FROM ct")
def local_contrast(spark, sf_dir):
    return pixel_rows(raster.local_contrast(small_images(spark, sf_dir), 2), "contrast")


def cross_sql(f: str, source: str, name: str) -> str:
    return f"{name} AS (SELECT a.image, a.y, a.x, {f}(b.v) AS v FROM {source} a JOIN {source} b ON a.image = b.image AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.image, a.y, a.x)"


TOP = f"{cross_sql('min', 'px', 'er')}, {cross_sql('max', 'er', 'op')}, th AS (SELECT px.*, px.v - op.v AS top FROM px JOIN op USING (image, y, x))"


@registered(f"WITH {PX}, {TOP} SELECT image, y, x, round(top, 6) + 0.0 AS top FROM th")
def top_hat(spark, sf_dir):
    return pixel_rows(raster.top_hat(small_images(spark, sf_dir), 3), "top")


@registered(f"WITH {PX}, {cross_sql('max', 'px', 'di')}, {cross_sql('min', 'di', 'cl')} SELECT image, y, x, round(v, 6) + 0.0 AS v FROM cl")
def ellipse_close(spark, sf_dir):
    return pixel_rows(raster.closed_by(small_images(spark, sf_dir), 3), "v")


def ellipse_sql(size: int) -> str:
    """of: offsets of an ellipse, row by row, from its half axes."""
    r = size // 2
    return f"""of AS (SELECT y - {r} AS dy, x - {r} AS dx FROM range(0, {size}) a(y), range(0, {size}) b(x)
  WHERE abs(y - {r}) <= {r} AND x BETWEEN {r} - round({r} * sqrt(1 - ((y - {r}) / {float(r)}) ** 2)) AND {r} + round({r} * sqrt(1 - ((y - {r}) / {float(r)}) ** 2)))"""


def kernel_sql(f: str, source: str, name: str, sign: int) -> str:
    return f"{name} AS (SELECT a.image, a.y, a.x, {f}(b.v) AS v FROM {source} a, of JOIN {source} b ON b.image = a.image AND b.y = a.y + {sign} * dy AND b.x = a.x + {sign} * dx GROUP BY a.image, a.y, a.x)"


@registered(f"WITH {PX}, {ellipse_sql(2)}, {kernel_sql('min', 'px', 'er', 1)}, {kernel_sql('max', 'er', 'op', -1)} SELECT image, y, x, round(v, 6) + 0.0 AS v FROM op")
def ellipse_open_2(spark, sf_dir):
    """Opening by the smallest ellipse, which is not symmetric."""
    return pixel_rows(raster.opened_by(small_images(spark, sf_dir), 2), "v")


@registered(f"WITH {PX}, {ellipse_sql(5)}, {kernel_sql('max', 'px', 'di', -1)}, {kernel_sql('min', 'di', 'cl', 1)} SELECT image, y, x, round(v, 6) + 0.0 AS v FROM cl")
def ellipse_close_5(spark, sf_dir):
    return pixel_rows(raster.closed_by(small_images(spark, sf_dir), 5), "v")


@registered(f"WITH {PX}, {ellipse_sql(15)}, {kernel_sql('min', 'px', 'er', 1)}, {kernel_sql('max', 'er', 'op', -1)} SELECT px.image, px.y, px.x, round(px.v - op.v, 6) + 0.0 AS top FROM px JOIN op USING (image, y, x)")
def top_hat_15(spark, sf_dir):
    """The default kernel, wider than the images."""
    return pixel_rows(raster.top_hat(small_images(spark, sf_dir), 15), "top")


BESIDE = """a1 AS (SELECT px.*, coalesce(l.v, r.v) AS lv, coalesce(r.v, l.v) AS rv, coalesce(u.v, d.v) AS uv, coalesce(d.v, u.v) AS dv FROM px
  LEFT JOIN px l ON l.image = px.image AND l.y = px.y AND l.x = px.x - 1 LEFT JOIN px r ON r.image = px.image AND r.y = px.y AND r.x = px.x + 1
  LEFT JOIN px u ON u.image = px.image AND u.x = px.x AND u.y = px.y - 1 LEFT JOIN px d ON d.image = px.image AND d.x = px.x AND d.y = px.y + 1)"""


@registered(f"""WITH {PX}, {BESIDE}, s AS (SELECT image, y, x, rv - lv AS dx, dv - uv AS dy FROM a1), k AS (SELECT * FROM (VALUES (-1, 1), (0, 2), (1, 1)) t(o, w)),
gx AS (SELECT s.image, s.y, s.x, sum(w * n.dx) AS g FROM s, k JOIN s n ON n.image = s.image AND n.x = s.x AND n.y = CASE WHEN s.y + o < 0 THEN 1 WHEN s.y + o > 7 THEN 6 ELSE s.y + o END GROUP BY 1, 2, 3),
gy AS (SELECT s.image, s.y, s.x, sum(w * n.dy) AS g FROM s, k JOIN s n ON n.image = s.image AND n.y = s.y AND n.x = CASE WHEN s.x + o < 0 THEN 1 WHEN s.x + o > 7 THEN 6 ELSE s.x + o END GROUP BY 1, 2, 3)
SELECT image, y, x, round(sqrt(gx.g * gx.g + gy.g * gy.g), 6) + 0.0 AS gradient FROM gx JOIN gy USING (image, y, x)""")
def gradient_magnitude(spark, sf_dir):
    return pixel_rows(raster.gradient(small_images(spark, sf_dir)), "gradient")


@registered(f"WITH {PX}, {BESIDE} SELECT image, y, x, round(abs(lv + rv + uv + dv - 4 * v), 6) + 0.0 AS laplacian FROM a1")
def laplacian(spark, sf_dir):
    return pixel_rows(raster.laplacian(small_images(spark, sf_dir)), "laplacian")


def fold_sql(p: str) -> str:
    return f"CASE WHEN {p} < 0 THEN -1 - ({p}) WHEN {p} > 7 THEN 15 - ({p}) ELSE {p} END"


@registered(f"""WITH {PX}, o AS (SELECT range AS o FROM range(-3, 4)), n AS (SELECT px.image, px.y, px.x, q.v FROM px, o a, o b JOIN px q ON q.image = px.image AND q.y = {fold_sql('px.y + a.o')} AND q.x = {fold_sql('px.x + b.o')})
SELECT image, y, x, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)), 6) + 0.0 AS deviation FROM n GROUP BY image, y, x""")
def local_deviation(spark, sf_dir):
    sizes = vectors(spark, sf_dir).select(F.col("id").alias("image"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    return pixel_rows(raster.local_deviation(small_images(spark, sf_dir), sizes, 3), "deviation")


@registered(f"WITH {PX}, hi AS (SELECT image, y, x, CASE WHEN v > 0.1 THEN 255.0 ELSE 0.0 END AS v FROM px), {square_sql('max', 'hi', 'a', 2)}, {square_sql('min', 'a', 'b', 2)} SELECT image, y, x, v + 0.0 AS v FROM b")
def threshold_close(spark, sf_dir):
    """A threshold, then closing by a square of five."""
    rows = small_images(spark, sf_dir).withColumn("v", F.when(F.col("v") > 0.1, 255.0).otherwise(0.0))
    return pixel_rows(raster.closed(rows, 2), "v")


LIMITS = "l AS (SELECT image, avg(v) AS m, stddev_pop(v) AS s, quantile_cont(v, 0.97) AS q FROM px WHERE v > -0.2 GROUP BY image)"


@registered(f"WITH {PX}, {LIMITS} SELECT image, y, x, round(v, 6) AS v FROM px JOIN l USING (image) WHERE v > -0.2 AND v >= greatest(m + 1.5 * s, q, 0.1)")
def bright_pixels(spark, sf_dir):
    return pixel_rows(raster.bright_pixels(small_images(spark, sf_dir), F.col("v") > -0.2, 1.5, 0.97, 0.1), "v")


@registered(f"""WITH {PX}, {TOP}, l AS (SELECT image, avg(v) AS m, stddev_pop(v) AS s, quantile_cont(top, 0.9) FILTER (WHERE top > 0) AS q FROM th WHERE v > -0.2 GROUP BY image)
SELECT image, y, x, round(v, 6) AS v FROM th JOIN l USING (image) WHERE v > -0.2 AND top >= q AND v >= greatest(m + 1.0 * s, 0.05)""")
def spiky_pixels(spark, sf_dir):
    return pixel_rows(raster.spiky_pixels(raster.top_hat(small_images(spark, sf_dir), 3), F.col("v") > -0.2, 1.0, 0.9, 0.05), "v")


REGIONS = f"""{CONTRAST}, {TOP}, rg AS (SELECT image, ct.v, top, contrast, dense_rank() OVER (PARTITION BY image ORDER BY y // 2, x // 2) - 1 AS label FROM ct JOIN th USING (image, y, x) WHERE ct.v > -0.1),
rf AS (SELECT image, label, avg(v) AS mean_v, max(v) AS max_v, avg(top) AS mean_top, avg(contrast) AS mean_contrast, count(*) / sum(count(*)) OVER (PARTITION BY image) AS area, count(*) AS pixels FROM rg GROUP BY image, label)"""


def regions(spark, sf_dir):
    rows = raster.local_contrast(raster.top_hat(small_images(spark, sf_dir), 3), 2)
    return features.region_features(raster.grid_regions(rows, F.col("v") > -0.1, regions=200, least=2))


@registered(f"WITH {PX}, {REGIONS} SELECT image, label, round(mean_v, 6) + 0.0 AS mean_v, round(max_v, 6) + 0.0 AS max_v, round(mean_top, 6) + 0.0 AS mean_top, round(mean_contrast, 6) + 0.0 AS mean_contrast, round(area, 6) AS area FROM rf")
def superpixel_features(spark, sf_dir):
    rows = regions(spark, sf_dir)
    return rows.select("image", F.col("label").cast("long").alias("label"), *(rounded(c).alias(c) for c in ("mean_v", "max_v", "mean_top", "mean_contrast", "area")))


@registered(f"""WITH {PX}, {REGIONS}, q AS (SELECT * EXCLUDE (area), pixels AS area, label % 4 AS cluster FROM rf),
i AS (SELECT image, avg(mean_v) AS m1, stddev_pop(mean_v) AS s1, avg(mean_top) AS m2, stddev_pop(mean_top) AS s2, quantile_cont(area, 0.5) AS mid FROM q GROUP BY image),
c AS (SELECT image, cluster, avg(mean_v) AS v, avg(mean_top) AS t, avg(max_v) AS peak, avg(area) AS a FROM q GROUP BY image, cluster)
SELECT image, cluster FROM c JOIN i USING (image) WHERE (v > m1 + 0.2 * s1 OR t > m2 + 0.2 * s2) AND peak > 0.1 AND a < mid""")
def outlier_clusters(spark, sf_dir):
    """Areas in pixels: whole numbers, whose means compare alike in any order of summing."""
    rows = regions(spark, sf_dir).withColumns({"cluster": F.col("label").cast("long") % 4, "area": F.col("pixels")})
    return features.outlier_clusters(rows, 0.2, 0.2, 0.1)


@registered()
def fit_regions(spark, sf_dir):
    """A model for each image over its regions' features; regions of images of 5 to 9, for which no number of clusters can be chosen, have a null cluster."""
    return centre_torque.fit_images(regions(spark, sf_dir).select("image", "label", F.array("mean_v", "max_v", "mean_top", "mean_contrast", "area").alias("f")))


BOXES = "bx AS (SELECT id AS image, 0 AS box, label % 4 AS x1, label // 4 AS y1, label % 4 + 4 AS x2, label // 4 + 3 AS y2 FROM p UNION ALL SELECT id, 1, 2, 2, 5, 5 FROM p UNION ALL SELECT id, 2, label - 3, 5, 12, label FROM p)"


def boxes(spark, sf_dir):
    p = vectors(spark, sf_dir).select(F.col("id").alias("image"), F.col("label").cast("int").alias("label"))
    l4 = F.expr("CAST(label DIV 4 AS INT)")
    rows = [(F.lit(0), F.col("label") % 4, l4, F.col("label") % 4 + 4, l4 + 3), (F.lit(1), F.lit(2), F.lit(2), F.lit(5), F.lit(5)), (F.lit(2), F.col("label") - 3, F.lit(5), F.lit(12), F.col("label"))]
    box = F.explode(F.array(*(F.struct(*(c.cast("int").alias(n) for c, n in zip(r, ("box", "x1", "y1", "x2", "y2"), strict=True))) for r in rows)))
    return p.select("image", box.alias("b")).select("image", "b.*")


@registered(f"WITH {PX}, {BOXES} SELECT DISTINCT px.image, y, x, round(v, 6) + 0.0 AS v FROM px JOIN bx ON px.image = bx.image AND y >= y1 AND y < y2 AND x >= x1 AND x < x2")
def box_mask(spark, sf_dir):
    return pixel_rows(raster.in_boxes(small_images(spark, sf_dir), boxes(spark, sf_dir)), "v")


@registered(f"WITH {PX}, {BOXES} SELECT px.image, y, x, coalesce(max(box) + 1, 0) AS label FROM px LEFT JOIN bx ON px.image = bx.image AND y >= y1 AND y < y2 AND x >= x1 AND x < x2 GROUP BY px.image, y, x")
def box_labels(spark, sf_dir):
    rows = raster.box_labels(small_images(spark, sf_dir), boxes(spark, sf_dir))
    return rows.select("image", *(F.col(c).cast("long").alias(c) for c in ("y", "x", "label")))


@registered(f"WITH {POINTS}, {BOXES} SELECT image, box, least(greatest(x1, 0), 8) AS x1, least(greatest(y1, 0), 8) AS y1, least(greatest(x2, 0), 8) AS x2, least(greatest(y2, 0), 8) AS y2 FROM bx WHERE x2 > x1 AND y2 > y1")
def box_clip(spark, sf_dir):
    b = boxes(spark, sf_dir)
    rows = raster.clip_boxes(b, b.select("image", F.lit(8).alias("h"), F.lit(8).alias("w")).distinct())
    return rows.select("image", *(F.col(c).cast("long").alias(c) for c in ("box", "x1", "y1", "x2", "y2")))


@registered(f"""WITH {PX}, b AS (SELECT image, min(y) AS y1, max(y) + 1 AS y2, min(x) AS x1, max(x) AS x2 FROM px WHERE v > 0.25 GROUP BY image)
SELECT px.image, y, x, round(CASE WHEN y BETWEEN y1 AND y2 AND x BETWEEN x1 AND x2 THEN v ELSE 0 END, 6) + 0.0 AS v FROM px LEFT JOIN b ON b.image = px.image""")
def roi_crop(spark, sf_dir):
    return pixel_rows(raster.crop(small_images(spark, sf_dir), F.col("v") > 0.25, 1), "v")


GREY = PX + ", gr AS (SELECT image, y, x, CAST(floor(least(greatest((v + 1) * 127.5, 0), 255)) AS BIGINT) AS g FROM px)"


def grey(spark, sf_dir):
    return small_images(spark, sf_dir).withColumn("g", F.floor(F.least(F.greatest((F.col("v") + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("long"))


@registered(f"WITH {GREY} SELECT image, y, x, g, CAST(floor((g / 255.0) ** 1.25 * 255) AS BIGINT) AS dark, 255 - g AS inverse, CASE WHEN g > 127 THEN 255 ELSE 0 END AS high FROM gr")
def grey_maps(spark, sf_dir):
    """A power curve, a look-up table that inverts, and a threshold."""
    table = F.array(*(F.lit(255 - k) for k in range(256)))
    rows = grey(spark, sf_dir)
    return rows.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "g", raster.power_map(F.col("g")).cast("long").alias("dark"),
        raster.look_up(F.col("g"), table).cast("long").alias("inverse"), F.when(F.col("g") > 127, 255).otherwise(0).cast("long").alias("high"))


@registered(f"""WITH {GREY}, c AS (SELECT image, (y * 8 + x) // 3 AS k, max(g) FILTER ((y * 8 + x) % 3 = 0) AS b, max(g) FILTER ((y * 8 + x) % 3 = 1) AS g, max(g) FILTER ((y * 8 + x) % 3 = 2) AS r FROM gr GROUP BY 1, 2 HAVING count(*) = 3),
m AS (SELECT *, greatest(b, g, r) AS t, greatest(b, g, r) - least(b, g, r) AS s FROM c),
h AS (SELECT *, CASE WHEN s = 0 THEN 0 WHEN t = r THEN 60 * (g - b) / s WHEN t = g THEN 120 + 60 * (b - r) / s ELSE 240 + 60 * (r - g) / s END AS a FROM m),
q AS (SELECT *, floor(CASE WHEN a < 0 THEN a + 360 ELSE a END / 2 + 0.5) AS u, CASE WHEN t = 0 THEN 0 ELSE floor(s * 255 / t + 0.5) END AS sat FROM h)
SELECT image, k, CAST(CASE WHEN u >= 180 THEN u - 180 ELSE u END AS BIGINT) AS hue, CAST(sat AS BIGINT) AS saturation,
  (CASE WHEN u >= 180 THEN u - 180 ELSE u END BETWEEN 0 AND 10 OR CASE WHEN u >= 180 THEN u - 180 ELSE u END BETWEEN 160 AND 180) AND sat >= 50 AND t >= 50 AS red FROM q""")
def red_pixels(spark, sf_dir):
    """Every three pixels in a row as blue, green and red."""
    pos = F.col("y") * 8 + F.col("x")
    pick = lambda k: F.max(F.when(pos % 3 == k, F.col("g")))
    rows = grey(spark, sf_dir).groupBy("image", F.floor(pos / 3).cast("long").alias("k")).agg(pick(0).alias("b"), pick(1).alias("gg"), pick(2).alias("r"), F.count("*").alias("n")).where("n = 3")
    b, g, r = F.col("b"), F.col("gg"), F.col("r")
    h, s, _ = raster.hsv(b, g, r)
    return rows.select("image", "k", h.cast("long").alias("hue"), s.cast("long").alias("saturation"), raster.red(b, g, r).alias("red"))


COLOUR = GREY + """, cl AS (SELECT image, y, x, CASE WHEN image % 3 = 2 AND (y * 8 + x) % 5 = 0 THEN 0 ELSE q END AS b, CASE WHEN image % 3 = 2 AND (y * 8 + x) % 5 = 0 THEN 0 ELSE q END AS g, q AS r
  FROM (SELECT image, y, x, CASE image % 3 WHEN 0 THEN CASE y * 8 + x WHEN 0 THEN 0 WHEN 63 THEN 255 ELSE least(255, greatest(0, 4 * (g - 96))) END WHEN 1 THEN CASE WHEN g > 127 THEN 255 ELSE 0 END ELSE least(200, greatest(20, g)) END AS q FROM gr))"""


def coloured(spark, sf_dir):
    """Pictures of three kinds, by turns: grey levels over the whole range, black and white, and middle grey levels with every fifth pixel red."""
    g, kind, at = F.col("g"), F.col("image") % 3, F.col("y") * 8 + F.col("x")
    red = (kind == 2) & (at % 5 == 0)
    level = F.when(kind == 0, F.when(at == 0, 0).when(at == 63, 255).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), 4 * (g - 96))))).when(kind == 1, F.when(g > 127, 255).otherwise(0)).otherwise(F.least(F.lit(200), F.greatest(F.lit(20), g)))
    rows = grey(spark, sf_dir).withColumn("q", level.cast("long"))
    return rows.select("image", "y", "x", F.when(red, 0).otherwise(F.col("q")).alias("b"), F.when(red, 0).otherwise(F.col("q")).alias("g"), F.col("q").alias("r"))


@registered(f"""WITH {COLOUR}, l AS (SELECT *, floor(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r + 0.5) AS v, greatest(b, g, r) AS t, greatest(b, g, r) - least(b, g, r) AS s FROM cl),
m AS (SELECT image, count(DISTINCT v) <= 2 OR (min(v) < 10 AND max(v) > 245) AS is_mask FROM l GROUP BY image),
h AS (SELECT *, floor(CASE WHEN s = 0 THEN 0 WHEN t = r THEN CASE WHEN g < b THEN 360 + 60 * (g - b) / s ELSE 60 * (g - b) / s END WHEN t = g THEN 120 + 60 * (b - r) / s ELSE 240 + 60 * (r - g) / s END / 2 + 0.5) % 180 AS hue, CASE WHEN t = 0 THEN 0 ELSE floor(s * 255 / t + 0.5) END AS sat FROM l)
SELECT image, y, x, CASE WHEN is_mask THEN v > 127 ELSE sat > 30 OR ((hue <= 10 OR hue BETWEEN 170 AND 180) AND sat >= 50 AND t >= 50) END AS marked FROM h JOIN m USING (image)""")
def annotation_mask(spark, sf_dir):
    """Truth masks from pictures that are masks themselves or have coloured marks."""
    rows = annotations.annotation_mask(coloured(spark, sf_dir))
    return rows.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("on").alias("marked"))


@registered(f"WITH {PX}, n AS (SELECT p.id AS image, y, x FROM p, range(5) a(y), range(12) b(x)) SELECT n.image, n.y, n.x, round(v, 6) + 0.0 AS v FROM n JOIN px ON px.image = n.image AND px.y = n.y * 8 // 5 AND px.x = n.x * 8 // 12")
def resize_nearest(spark, sf_dir):
    pixels = small_images(spark, sf_dir)
    sizes = vectors(spark, sf_dir).select(F.col("id").alias("image"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    return pixel_rows(raster.resized(pixels, sizes, 5, 12), "v")


# Masks

EMPTY_ONE, EMPTY_ZERO = "CASE WHEN {b} = 0 THEN 1.0 ELSE {a} / {b} END", "CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / {b} END"


def metrics_sql(rows: str, key: str) -> str:
    one = lambda a, b: EMPTY_ONE.format(a=a, b=b)
    zero = lambda a, b: EMPTY_ZERO.format(a=a, b=b)
    return f"""n AS (SELECT {key}, count(*) FILTER (found AND truth) AS tp, count(*) FILTER (found AND NOT truth) AS fp, count(*) FILTER (NOT found AND truth) AS fn, count(*) FILTER (NOT found AND NOT truth) AS tn FROM {rows} GROUP BY {key}),
s AS (SELECT *, {one('tp', '(tp + fp + fn)')} AS iou, {one('(2 * tp)', '(2 * tp + fp + fn)')} AS dice, {zero('(tp + tn)', '(tp + tn + fp + fn)')} AS pixel_accuracy,
  {zero('tp', '(tp + fp)')} AS precision, {zero('tp', '(tp + fn)')} AS recall, {zero('tn', '(tn + fp)')} AS specificity FROM n),
a AS (SELECT *, {zero('(2 * precision * recall)', '(precision + recall)')} AS f1_score FROM s)"""


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in metrics.MASK_METRICS)


def rounded_metrics(rows, *keys):
    return rows.select(*keys, "tp", "fp", "fn", "tn", *(rounded(c).alias(c) for c in metrics.MASK_METRICS))


@registered(f"WITH {MASKS}, {metrics_sql('mk', 'image')} SELECT image, tp, fp, fn, tn, {ROUNDED} FROM a")
def mask_metrics(spark, sf_dir):
    return rounded_metrics(metrics.mask_metrics(masks(spark, sf_dir), ["image"], F.col("found"), F.col("truth")), "image")


@registered(f"WITH {MASKS.replace('v > 0 AS found', 'v > 0.3 AS found')}, {metrics_sql('mk', 'image')} SELECT CASE WHEN tp + fn = 0 THEN 'empty truth' WHEN tp + fp = 0 THEN 'empty prediction' ELSE 'scored' END AS reason, count(*) AS images FROM a GROUP BY 1")
def skip_reasons(spark, sf_dir):
    return metrics.skip_reasons(metrics.mask_metrics(masks(spark, sf_dir), ["image"], F.col("v") > 0.3, F.col("truth")))


@registered(f"""WITH r AS (SELECT source, toxic = 0 AS found, quality = 1 AS truth FROM labels JOIN documents USING (doc_id)), {metrics_sql('r', 'source')} SELECT source, tp, fp, fn, tn, {ROUNDED} FROM a""")
def label_metrics(spark, sf_dir):
    """Labels by source: being free of toxicity as a guess pos quality."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id")
    return rounded_metrics(metrics.mask_metrics(rows, ["source"], F.col("toxic") == 0, F.col("quality") == 1), "source")


def outline_sql(flag: str, n: str) -> str:
    """o{n}: (image, y, x, visits) of outer outlines: what is outside is found by steps from a corner of each image's frame."""
    near = lambda dy, dx: f"list_contains(out, (c.y + {dy}) * 100 + c.x + {dx})"
    free = lambda dy, dx: f"NOT list_contains(held, (c.y + {dy}) * 100 + c.x + {dx})"
    sides, corners = ((-1, 0), (0, 1), (1, 0), (0, -1)), ((-1, 1), (1, 1), (1, -1), (-1, -1))
    number = lambda xs: " + ".join(f"CAST({x} AS INT)" for x in xs)
    joins = [f"({near(*sides[k])} AND {near(*sides[(k + 1) % 4])} AND {free(*corners[k])})" for k in range(4)]
    alone = " AND ".join([*(near(*s) for s in sides), *(free(*c) for c in corners)])
    return f"""bg{n} AS (SELECT fr.* FROM fr LEFT JOIN (SELECT image, y, x FROM mk WHERE {flag}) m USING (image, y, x) WHERE m.image IS NULL),
ou{n} AS (SELECT image, y, x FROM bg{n} WHERE y = -1 AND x = -1 UNION SELECT b.image, b.y, b.x FROM ou{n} JOIN bg{n} b ON b.image = ou{n}.image AND abs(b.y - ou{n}.y) + abs(b.x - ou{n}.x) = 1),
ol{n} AS (SELECT image, list(y * 100 + x) AS out FROM ou{n} GROUP BY image), hl{n} AS (SELECT image, list(y * 100 + x) AS held FROM mk WHERE {flag} GROUP BY image),
o{n} AS (SELECT * FROM (SELECT c.image, c.y, c.x, CASE WHEN {alone} THEN 1 ELSE {number(near(*s) for s in sides)} - ({number(joins)}) END AS visits FROM mk c JOIN ol{n} USING (image) JOIN hl{n} USING (image) WHERE c.{flag}) WHERE visits > 0)"""


OUTLINES = f"""{MASKS.replace('v > 0 AS found', 'v > 0.3 AS found')}, fr AS (SELECT p.id AS image, y, x FROM p, range(-1, 9) a(y), range(-1, 9) b(x)), {outline_sql('found', '1')}, {outline_sql('truth', '2')},
g AS (SELECT a.image, a.y AS ay, a.x AS ax, a.visits AS av, b.y AS by_, b.x AS bx, b.visits AS bv, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d FROM o1 a JOIN o2 b USING (image)),
u AS (SELECT image, max(m) AS h, sum(m * n) / sum(n) AS s FROM (SELECT image, min(d) AS m, any_value(av) AS n FROM g GROUP BY image, ay, ax) GROUP BY image), w AS (SELECT image, max(m) AS h, sum(m * n) / sum(n) AS s FROM (SELECT image, min(d) AS m, any_value(bv) AS n FROM g GROUP BY image, by_, bx) GROUP BY image)"""
DISTANCES = "SELECT p.id AS image, round(greatest(u.h, w.h), 6) AS hausdorff, round((u.s + w.s) / 2, 6) AS surface FROM p LEFT JOIN u ON u.image = p.id LEFT JOIN w ON w.image = p.id"


@registered(f"WITH RECURSIVE {OUTLINES} {DISTANCES}")
def boundary_distances(spark, sf_dir):
    """Distances between outer outlines; an undefined distance is null here."""
    rows = masks(spark, sf_dir)
    images = vectors(spark, sf_dir).select(F.col("id").alias("image"))
    found = metrics.boundary_distances(rows.where("v > 0.3"), rows.where("truth"), images)
    return found.select("image", *(rounded(metrics.finite(F.col(c))).alias(c) for c in ("hausdorff", "surface")))


@registered(f"""WITH {MASKS}, {metrics_sql('mk', 'image')}, u AS (SELECT 'iou' AS metric, iou AS v FROM a UNION ALL SELECT 'dice', dice FROM a UNION ALL SELECT 'recall', recall FROM a),
e AS (SELECT metric, min(v) AS lo, CASE WHEN max(v) > min(v) THEN (max(v) - min(v)) / 20 ELSE 0.05 END AS w FROM u GROUP BY metric)
SELECT metric, CAST(least(floor((v - lo) / w), 19) AS BIGINT) AS bin, round(lo + w * least(floor((v - lo) / w), 19), 6) AS low, round(lo + w * (least(floor((v - lo) / w), 19) + 1), 6) AS high, count(*) AS n
FROM u JOIN e USING (metric) GROUP BY ALL""")
def metric_histograms(spark, sf_dir):
    """Twenty bins of three metrics over all images."""
    rows = metrics.mask_metrics(masks(spark, sf_dir), ["image"], F.col("found"), F.col("truth"))
    found = metrics.histogram(metrics.unpivoted(rows, "image", ("iou", "dice", "recall")))
    return found.select("metric", F.col("bin").cast("long").alias("bin"), rounded("low").alias("low"), rounded("high").alias("high"), "n")


@registered(f"WITH {MASKS} SELECT image, y, x, CASE WHEN found AND truth THEN 'tp' WHEN found THEN 'fp' ELSE 'fn' END AS kind FROM mk WHERE found OR truth")
def mask_differences(spark, sf_dir):
    """Intersection and both differences of two masks, as sets of pixels."""
    rows = masks(spark, sf_dir)
    a, b = (rows.where(c).select("image", "y", "x") for c in ("found", "truth"))
    sets = [(a.intersect(b), "tp"), (a.exceptAll(b), "fp"), (b.exceptAll(a), "fn")]
    parts = [s.withColumn("kind", F.lit(k)) for s, k in sets]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "kind")


@registered(f"WITH {MASKS} SELECT image, y, x FROM mk WHERE found OR truth")
def mask_union(spark, sf_dir):
    rows = masks(spark, sf_dir)
    both = rows.where("found").select("image", "y", "x").union(rows.where("truth").select("image", "y", "x")).distinct()
    return both.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


#: Components by reaching every pixel from every other of its component: least labels, spread to a fixed point.
REACHED = """ed AS (SELECT p.image, p.a, q.a AS b FROM mq p JOIN mq q ON p.image = q.image AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1),
cl AS (SELECT image, a, a AS r FROM mq UNION SELECT cl.image, ed.b, cl.r FROM cl JOIN ed ON ed.image = cl.image AND ed.a = cl.a),
lb AS (SELECT image, a, min(r) AS r FROM cl GROUP BY image, a), cc AS (SELECT image, a // 8 AS y, a % 8 AS x, dense_rank() OVER (PARTITION BY image ORDER BY r) AS component FROM lb)"""
PARTS = f"mq AS (SELECT image, y * 8 + x AS a, y, x FROM px WHERE v > 0.08), {REACHED}"


def parts(spark, sf_dir):
    return components.components(small_images(spark, sf_dir).where("v > 0.08"))


@registered(f"WITH RECURSIVE {PX}, {PARTS} SELECT image, component, count(*) AS area, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM cc GROUP BY image, component")
def components_area(spark, sf_dir):
    rows = components.component_table(parts(spark, sf_dir))
    return rows.select("image", "component", "area", rounded("cy").alias("cy"), rounded("cx").alias("cx"), *(F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h")))


@registered(f"""WITH RECURSIVE {PX}, {PARTS}, k AS (SELECT image, component FROM cc GROUP BY image, component HAVING count(*) BETWEEN 2 AND 12 AND min(y) > 0 AND min(x) > 0 AND max(y) < 7 AND max(x) < 7)
SELECT image, y, x, component FROM cc JOIN k USING (image, component)""")
def inner_components(spark, sf_dir):
    """Components off the border, of 2 to 12 pixels."""
    sizes = vectors(spark, sf_dir).select(F.col("id").alias("image"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    rows = components.by_area(components.without_border(written(parts(spark, sf_dir)), sizes), 2, 12)
    return rows.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "component")


@registered(f"""WITH RECURSIVE {PX}, hi AS (SELECT image, y, x, CASE WHEN v > -0.15 AND v >= -0.05 THEN 1 ELSE 0 END AS v FROM px), {square_sql('min', 'hi', 'oa')}, {square_sql('max', 'oa', 'ob')},
mq AS (SELECT image, y * 8 + x AS a, y, x FROM ob WHERE v = 1), {REACHED}, k AS (SELECT image, component FROM cc GROUP BY image, component HAVING count(*) BETWEEN 5 AND 40)
SELECT image, y, x FROM cc JOIN k USING (image, component)""")
def intense_spots(spark, sf_dir):
    """Components of 5 to 40 pixels of what opening leaves of the bright pixels."""
    rows = segmentation.intense_spots(small_images(spark, sf_dir).withColumn("inside", F.col("v") > -0.15), -0.05, (5, 40))
    return rows.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


@registered(f"WITH RECURSIVE {PX}, {PARTS} SELECT image, y, x, component FROM cc")
def tiled_components(spark, sf_dir):
    """Components united over the seams of tiles of five pixels."""
    rows = components.tiled_components(small_images(spark, sf_dir).where("v > 0.08").select("image", "y", "x"), tile=5)
    return rows.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "component")


@registered(f"""WITH RECURSIVE {PX}, mk AS (SELECT image, y, x FROM px WHERE v > 0.02), bg AS (SELECT image, y, x FROM px WHERE v <= 0.02),
ou AS (SELECT image, y, x FROM bg WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT bg.image, bg.y, bg.x FROM ou JOIN bg ON bg.image = ou.image AND abs(bg.y - ou.y) + abs(bg.x - ou.x) = 1)
SELECT bg.image, bg.y, bg.x FROM bg ANTI JOIN ou USING (image, y, x)""")
def tiled_holes(spark, sf_dir):
    sizes = vectors(spark, sf_dir).select(F.col("id").alias("image"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    rows = components.tiled_holes(small_images(spark, sf_dir).where("v > 0.02").select("image", "y", "x"), sizes, tile=5)
    return rows.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


SHAPES = """bb AS (SELECT image, component, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2 FROM cc GROUP BY image, component),
fs AS (SELECT image, component, y, unnest(range(x1 - 1, x2 + 2)) AS x FROM (SELECT *, unnest(range(y1 - 1, y2 + 2)) AS y FROM bb)),
fb AS (SELECT fs.* FROM fs ANTI JOIN cc USING (image, component, y, x)),
fo AS (SELECT image, component, y1 - 1 AS y, x1 - 1 AS x FROM bb UNION SELECT fb.image, fb.component, fb.y, fb.x FROM fo JOIN fb ON fb.image = fo.image AND fb.component = fo.component AND abs(fb.y - fo.y) + abs(fb.x - fo.x) = 1),
fi AS (SELECT fs.* FROM fs ANTI JOIN fo USING (image, component, y, x)),
pt AS (SELECT image, component, y - dy AS v, x - dx AS u, sum(bit) AS bits, count(*) AS n FROM fi, (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)) o(dy, dx, bit) GROUP BY ALL),
po AS (SELECT image, component, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0.0 END) AS area, CAST(sum(CASE WHEN n = 2 AND bits NOT IN (6, 9) THEN 1 ELSE 0 END) AS DOUBLE) AS straight, CAST(sum(CASE WHEN n = 3 THEN 1 WHEN bits IN (6, 9) THEN 2 ELSE 0 END) AS DOUBLE) AS across FROM pt GROUP BY ALL),
er AS (SELECT image, component, y, min(x) AS l, max(x) AS r FROM cc GROUP BY ALL),
en AS (SELECT m.image, m.component, m.y, min(a.l + CASE WHEN a.y = b.y THEN 0 ELSE (b.l - a.l) * (m.y - a.y) / (b.y - a.y) END) AS l, max(a.r + CASE WHEN a.y = b.y THEN 0 ELSE (b.r - a.r) * (m.y - a.y) / (b.y - a.y) END) AS r
  FROM er m JOIN er a ON a.image = m.image AND a.component = m.component AND a.y <= m.y JOIN er b ON b.image = m.image AND b.component = m.component AND b.y >= m.y GROUP BY ALL),
hu AS (SELECT image, component, coalesce(sum(w), 0) AS hull FROM (SELECT image, component, ((r - l) + lead(r - l) OVER (PARTITION BY image, component ORDER BY y)) / 2 AS w FROM en) GROUP BY ALL)
SELECT image, component, area AS outline_area, round(straight + across * sqrt(2.0), 6) AS perimeter, round(4 * pi() * area / ((straight + across * sqrt(2.0)) ** 2 + 1e-10), 6) AS circularity,
  round(CASE WHEN hull > 0 THEN area / hull ELSE 0 END, 6) AS solidity FROM po JOIN hu USING (image, component)"""


@registered(f"WITH RECURSIVE {PX}, {PARTS}, {SHAPES}")
def component_shapes(spark, sf_dir):
    """Outlines by 2 x 2 patterns; in SQL each component is flooded around by itself, and its hull is the envelope of its rows' ends."""
    rows = components.shape_table(parts(spark, sf_dir))
    return rows.select("image", "component", "outline_area", *(rounded(c).alias(c) for c in ("perimeter", "circularity", "solidity")))


@registered(f"""WITH RECURSIVE {PX}, mk AS (SELECT image, y, x FROM px WHERE v > 0.02), fr AS (SELECT p.id AS image, y, x FROM p, range(-1, 9) a(y), range(-1, 9) b(x)),
bg AS (SELECT fr.* FROM fr LEFT JOIN mk USING (image, y, x) WHERE mk.image IS NULL), ou AS (SELECT image, y, x FROM bg WHERE y = -1 AND x = -1
  UNION SELECT bg.image, bg.y, bg.x FROM ou JOIN bg ON bg.image = ou.image AND abs(bg.y - ou.y) + abs(bg.x - ou.x) = 1)
SELECT px.image, px.y, px.x FROM px LEFT JOIN ou USING (image, y, x) WHERE ou.image IS NULL AND px.image IN (SELECT image FROM mk)""")
def filled_masks(spark, sf_dir):
    sizes = vectors(spark, sf_dir).select(F.col("id").alias("image"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    rows = components.filled(small_images(spark, sf_dir).where("v > 0.02"), sizes)
    return rows.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


# Reports

@registered("""WITH v AS (SELECT event_type AS metric, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.5), 6) AS median, count(v) AS n FROM v GROUP BY metric""")
def metric_summary(spark, sf_dir):
    """Some values are infinite, which stands for undefined."""
    value = F.when(F.col("event_id") % 97 == 0, float("inf")).otherwise(F.col("value"))
    rows = metrics.summary(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("metric"), value.alias("value")))
    return rows.select("metric", *(rounded(c).alias(c) for c in ("mean", "std", "min", "max", "median")), "n")


SIDES = "o AS (SELECT user_id AS image, avg(value) FILTER (event_type = 'view') AS old, avg(value) FILTER (event_type = 'click') AS new FROM events GROUP BY user_id)"


def sides(spark, sf_dir):
    side = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("image")).agg(side("view").alias("old"), side("click").alias("new"))


COMPARED = f"""WITH {SIDES}, c AS (SELECT avg(old) AS a, stddev_samp(old) AS sa, avg(new) AS b, stddev_samp(new) AS sb, count(old - new) AS n, avg(old - new) AS m, stddev_samp(old - new) AS s FROM o)
SELECT round(a, 6) AS old_mean, round(sa, 6) AS old_std, round(b, 6) AS new_mean, round(sb, 6) AS new_std, n AS pairs, round((b - a) / a * 100, 6) + 0.0 AS improvement, round(m / (s / sqrt(n)), 6) + 0.0 AS t_statistic FROM c"""


@registered(COMPARED)
def method_compare(spark, sf_dir):
    rows = metrics.compared(sides(spark, sf_dir).withColumn("metric", F.lit("value")))
    return rows.select(*(rounded(c).alias(c) for c in ("old_mean", "old_std", "new_mean", "new_std")), "pairs", rounded("improvement").alias("improvement"), rounded("t_statistic").alias("t_statistic"))


#: Two-sided p-values by Simpson's rule over the density of the t distribution.
PAIRED = f"""WITH {SIDES}, c AS (SELECT count(old - new) AS n, avg(old - new) / (stddev_samp(old - new) / sqrt(count(old - new))) AS t FROM o),
k AS (SELECT n, t, exp(lgamma(n / 2) - lgamma((n - 1) / 2)) / sqrt((n - 1) * pi()) AS c, abs(t) / 2000 AS h FROM c),
s AS (SELECT n, t, sum(c * (1 + (i * h) ** 2 / (n - 1)) ** (-n / 2) * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * any_value(h) / 3 AS area FROM k, range(0, 2001) r(i) GROUP BY n, t)
SELECT n AS pairs, round(t, 6) AS t_statistic, round(1 - 2 * area, 6) + 0.0 AS p_value, 1 - 2 * area < 0.05 AS significant FROM s"""


@registered(PAIRED)
def paired_t(spark, sf_dir):
    rows = metrics.compared(sides(spark, sf_dir).withColumn("metric", F.lit("value")))
    return rows.select("pairs", rounded("t_statistic").alias("t_statistic"), rounded("p_value").alias("p_value"), "significant")


@registered(f"WITH {SIDES} SELECT image, round(new - old, 6) + 0.0 AS gain FROM o WHERE new - old IS NOT NULL ORDER BY new - old DESC, image LIMIT 15")
def improvement_topn(spark, sf_dir):
    rows = sides(spark, sf_dir).select("image", (F.col("new") - F.col("old")).alias("gain")).where("gain IS NOT NULL")
    return metrics.top_rows(rows, "gain", 15).select("image", rounded("gain").alias("gain"))


@registered(f"WITH {MASKS}, {metrics_sql('mk', 'image')} SELECT image, round(iou, 6) AS iou FROM a ORDER BY iou DESC, image LIMIT 10")
def best_masks(spark, sf_dir):
    return metrics.top_rows(mask_metrics(spark, sf_dir), "iou", 10).select("image", "iou")


# Names

NAMES = "im AS (SELECT DISTINCT page_id || '.png' AS image FROM pages), nu AS (SELECT DISTINCT CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS n FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) <> '')"


def names(spark, sf_dir):
    """Image files by page, and numbers from the urls that name masks."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    number = F.regexp_extract("url", "/([0-9]+)", 1)
    return pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".png")).alias("image")).distinct(), pages.where(number != "").select(number.cast("long").alias("n")).distinct()


@registered(f"""WITH {NAMES}, mk AS (SELECT n || '_mask.npy' AS mask FROM nu),
c AS (SELECT image, mask, image = mask AS exact FROM im JOIN mk ON image = mask OR replace(replace(regexp_replace(mask, '\\.[^.]*$', ''), '_stone_mask', ''), '_mask', '') = regexp_replace(image, '\\.[^.]*$', '') OR contains(mask, regexp_replace(image, '\\.[^.]*$', '')))
SELECT image, mask, exact FROM c QUALIFY row_number() OVER (PARTITION BY image ORDER BY exact DESC, mask) = 1""")
def mask_match(spark, sf_dir):
    images, numbers = names(spark, sf_dir)
    return matching.match_masks(images, numbers.select(F.concat(F.col("n").cast("string"), F.lit("_mask.npy")).alias("mask")))


@registered(f"""WITH {NAMES}, mk AS (SELECT CASE n % 4 WHEN 0 THEN 'img/' || n || '_mask.npy' WHEN 1 THEN 'img/' || n || '.npy' WHEN 2 THEN n || '_mask.npy' ELSE n || '.npy' END AS mask FROM nu),
b AS (SELECT image, regexp_replace(image, '\\.[^.]*$', '') AS b FROM im), c AS (SELECT image, unnest([0, 1, 2, 3]) AS priority, unnest(['img/' || b || '_mask.npy', 'img/' || b || '.npy', b || '_mask.npy', b || '.npy']) AS mask FROM b)
SELECT image, mask, CAST(priority AS BIGINT) AS priority FROM c SEMI JOIN mk USING (mask) QUALIFY row_number() OVER (PARTITION BY image ORDER BY priority) = 1""")
def candidate_match(spark, sf_dir):
    images, numbers = names(spark, sf_dir)
    n, kind = F.col("n").cast("string"), F.col("n") % 4
    mask = F.when(kind == 0, F.concat(F.lit("img/"), n, F.lit("_mask.npy"))).when(kind == 1, F.concat(F.lit("img/"), n, F.lit(".npy"))).when(kind == 2, F.concat(n, F.lit("_mask.npy"))).otherwise(F.concat(n, F.lit(".npy")))
    rows = matching.match_candidates(images.withColumn("folder", F.lit("img")), numbers.select(mask.alias("mask")))
    return rows.select("image", "mask", F.col("priority").cast("long").alias("priority"))


@registered(f"""WITH {NAMES}, pr AS (SELECT DISTINCT page_id || '_mask.npy' AS prediction FROM pages), tr AS (SELECT n || '.' || ['png', 'jpg', 'jpeg', 'PNG', 'JPG'][n % 5 + 1] AS truth FROM nu UNION SELECT n || '.JPG' FROM nu),
c AS (SELECT prediction, truth, list_position(['png', 'jpg', 'jpeg', 'PNG', 'JPG'], regexp_extract(truth, '[^.]*$')) AS r FROM pr JOIN tr ON regexp_replace(truth, '\\.[^.]*$', '') = replace(regexp_replace(prediction, '\\.[^.]*$', ''), '_mask', ''))
SELECT prediction, truth FROM c QUALIFY row_number() OVER (PARTITION BY prediction ORDER BY r) = 1""")
def stem_match(spark, sf_dir):
    _, numbers = names(spark, sf_dir)
    predictions = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.col("page_id").cast("string"), F.lit("_mask.npy")).alias("prediction")).distinct()
    kinds = F.array(*(F.lit(e) for e in matching.EXTENSIONS))
    own = numbers.select(F.concat(F.col("n").cast("string"), F.lit("."), F.get(kinds, (F.col("n") % 5).cast("int"))).alias("truth"))
    return matching.match_stems(predictions, own.union(numbers.select(F.concat(F.col("n").cast("string"), F.lit(".JPG")))).distinct())


PATTERNS = f"""{NAMES}, tr AS (SELECT DISTINCT page_id || CASE page_id % 3 WHEN 0 THEN '_gt' WHEN 1 THEN '_annotated' ELSE '' END || '.jpg' AS truth FROM pages),
bs AS (SELECT truth, regexp_replace(truth, '\\.[^.]*$', '') AS base, replace(replace(replace(replace(regexp_replace(truth, '\\.[^.]*$', ''), '_gt', ''), '_ground_truth', ''), '_annotated', ''), '_mask', '') AS clean FROM tr),
pr AS (SELECT CASE n % 7 WHEN 0 THEN n || '/stone_mask.@' WHEN 1 THEN n || '_annotated/stone_mask.@' WHEN 2 THEN n || '_stone_mask.@' WHEN 3 THEN n || '.@' WHEN 4 THEN 'deep/' || n || '_x_stone.@' WHEN 5 THEN 'deep/er/Stone_' || n || '.@' ELSE n || '_mask.@' END AS prediction FROM nu),
nm AS (SELECT prediction, regexp_replace(regexp_extract(prediction, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM pr)"""


@registered(f"""WITH {PATTERNS.replace('@', 'npy')}, c AS (SELECT truth, prediction, CASE WHEN prediction = clean || '/stone_mask.npy' THEN 0 WHEN prediction = base || '/stone_mask.npy' THEN 1 WHEN prediction = clean || '_stone_mask.npy' THEN 2 WHEN prediction = clean || '.npy' THEN 3
  WHEN starts_with(stem, clean) AND contains(substr(stem, length(clean) + 1), 'stone') THEN 4 WHEN contains(stem, clean) AND contains(lower(stem), 'stone') THEN 5 END AS r FROM bs, nm)
SELECT truth, prediction FROM c WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY truth ORDER BY r, prediction) = 1""")
def pattern_match(spark, sf_dir):
    """Arrays for annotated images, by all six rules."""
    return matching.match_patterns(*pattern_files(spark, sf_dir, ".npy"))


@registered(f"""WITH {PATTERNS.replace('@', 'png')}, c AS (SELECT truth, prediction, CASE WHEN prediction = clean || '/stone_mask.png' THEN 0 WHEN prediction = base || '/stone_mask.png' THEN 1 WHEN prediction = clean || '_stone_mask.png' THEN 2
  WHEN starts_with(stem, clean) AND contains(substr(stem, length(clean) + 1), 'stone') THEN 4 END AS r FROM bs, nm)
SELECT truth, prediction FROM c WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY truth ORDER BY r, prediction) = 1""")
def pattern_match_png(spark, sf_dir):
    """Pictures for annotated images, by the four rules that pictures have."""
    return matching.match_patterns(*pattern_files(spark, sf_dir, ".png"), arrays=False)


def pattern_files(spark, sf_dir, end: str):
    _, numbers = names(spark, sf_dir)
    page = F.col("page_id").cast("string")
    mark = F.when(F.col("page_id") % 3 == 0, "_gt").when(F.col("page_id") % 3 == 1, "_annotated").otherwise("")
    truths = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(page, mark, F.lit(".jpg")).alias("truth")).distinct()
    n, kind = F.col("n").cast("string"), F.col("n") % 7
    forms = (("", "/stone_mask"), ("", "_annotated/stone_mask"), ("", "_stone_mask"), ("", ""), ("deep/", "_x_stone"), ("deep/er/Stone_", ""))
    path = F.concat(n, F.lit("_mask"))
    for k, (before, after) in enumerate(forms):
        path = F.when(kind == k, F.concat(F.lit(before), n, F.lit(after))).otherwise(path)
    return truths, numbers.select(F.concat(path, F.lit(end)).alias("prediction"))


@registered(f"WITH {NAMES} SELECT image FROM im INTERSECT SELECT n || '.png' FROM nu")
def common_names(spark, sf_dir):
    images, numbers = names(spark, sf_dir)
    return matching.common_names(images, numbers.select(F.concat(F.col("n").cast("string"), F.lit(".png")).alias("image")))


@registered("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passages_contained(spark, sf_dir):
    return matching.contained(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


@registered("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, left(b.text, CAST(3 + b.item_id % 12 AS BIGINT)))")
def starts_contained(spark, sf_dir):
    """Short needles: the first 3 to 14 characters of each passage."""
    starts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.expr("left(text, CAST(3 + item_id % 12 AS INT))").alias("text"))
    return matching.contained(starts, spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Sources and sinks: files are written to a shared folder, listed and read again.

LABELS = PX + ", lm AS (SELECT image, y, x, CASE WHEN v > 0.1 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END AS v FROM px)"


def label_maps(spark, sf_dir):
    return small_images(spark, sf_dir).withColumn("v", F.when(F.col("v") > 0.1, 2).when(F.col("v") > 0, 1).otherwise(0))


def as_long(rows):
    return rows.select("image", *(F.col(c).cast("long").alias(c) for c in ("y", "x", "v")))


@registered(f"WITH {LABELS} SELECT image || '_mask.npy' AS image, y, x, CASE WHEN v > 0 THEN 1 ELSE 0 END AS v FROM lm")
def npy_round_trip(spark, sf_dir):
    """Label maps written as arrays, beside files of other names, and read as predictions: any label is foreground."""
    path = shared_folder(spark)
    write_files(as_arrays(label_maps(spark, sf_dir)), path)
    write_files(spark.createDataFrame([("other.npy", b"x"), ("notes.txt", b"y")], "file string, content binary"), path)
    return as_long(read_arrays(spark, path, pattern="*_mask.npy", recursive=True))


@registered(f"WITH {LABELS} SELECT image || '_stack.npy' AS image, y, x, CASE WHEN CASE WHEN image % 2 = 0 THEN floor(0.299 * 60 * v + 0.114 * 100 * v + 0.5) ELSE 20 * v END > 30 THEN 1 ELSE 0 END AS v FROM lm")
def stacked_arrays(spark, sf_dir):
    """Arrays of three dimensions: of three channels the luma counts, of two the first."""

    def stack(channels):
        def encode(a):
            out = io.BytesIO()
            np.save(out, np.stack([a * c for c in channels], axis=2).astype(np.uint8))
            return out.getvalue()

        return encode

    path, maps = shared_folder(spark), label_maps(spark, sf_dir)
    write_files(encoded(maps.where("image % 2 = 0"), stack((60, 0, 100)), "_stack.npy"), path)
    write_files(encoded(maps.where("image % 2 = 1"), stack((20, 90)), "_stack.npy"), path)
    return as_long(read_arrays(spark, path, above=30.0))


@registered(f"WITH {LABELS}, t AS (SELECT *, max(v) OVER (PARTITION BY image) AS top FROM lm) SELECT image || '_mask.png' AS image, y, x, CASE WHEN top > 0 THEN v * 255 // top ELSE v END AS v FROM t")
def png_round_trip(spark, sf_dir):
    """Label maps written as grey pictures, stretched to 255, and read as grey values."""
    path = shared_folder(spark)
    write_files(png.as_pictures(label_maps(spark, sf_dir)), path)
    return as_long(png.read_pictures(spark, path))


@registered(f"""WITH {LABELS}, t AS (SELECT *, max(v) OVER (PARTITION BY image) AS top FROM lm)
SELECT image || CASE WHEN image % 2 = 0 THEN '_mask.npy' ELSE '_mask.png' END AS image, y, x, CASE WHEN image % 2 = 0 THEN CASE WHEN v > 0 THEN 1 ELSE 0 END WHEN top > 0 AND v * 255 // top > 127 THEN 1 ELSE 0 END AS v FROM t""")
def prediction_dispatch(spark, sf_dir):
    """Predictions of both kinds in folders of one folder: arrays count above 0, pictures above 127."""
    path, maps = shared_folder(spark), label_maps(spark, sf_dir)
    write_files(as_arrays(maps.where("image % 2 = 0")), f"{path}/arrays")
    write_files(png.as_pictures(maps.where("image % 2 = 1")), f"{path}/pictures")
    return as_long(png.read_predictions(spark, path, recursive=True))


@registered(f"WITH {GREY} SELECT image || '_mask.png' AS image, y, x, g AS b, g AS g, g AS r FROM gr")
def colour_scan(spark, sf_dir):
    """Grey pictures, of which each holds 255, read as three equal channels."""
    path = shared_folder(spark)
    grey_maps = grey(spark, sf_dir).select("image", "y", "x", F.col("g").alias("v"))
    plain = encoded(grey_maps, png.encode, "_mask.png")
    write_files(plain, path)
    return png.read_colours(spark, path).select("image", *(F.col(c).cast("long").alias(c) for c in ("y", "x", "b", "g", "r")))


LISTED = """nf AS (SELECT DISTINCT page_id % 400 AS n FROM pages), fl AS (SELECT n, n || ['.png', '.jpg', '.JPEG', '.txt', '_mask.npy', '.bmp'][n % 6 + 1] AS file, n % 3 = 0 AS deep FROM nf)"""


def folder_of_files(spark, sf_dir):
    """Files of many endings, a third of them in a folder of the folder."""
    path = shared_folder(spark)
    n = spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") % 400).alias("n")).distinct()
    endings = F.array(*map(F.lit, (".png", ".jpg", ".JPEG", ".txt", "_mask.npy", ".bmp")))
    files = written(n.select("n", F.concat(F.col("n").cast("string"), F.get(endings, (F.col("n") % 6).cast("int"))).alias("file"), F.lit(b"x").alias("content")), f"{path}-names")
    write_files(files.where("n % 3 = 0"), f"{path}/deep")
    write_files(files.where("n % 3 <> 0"), path)
    return path


@registered(f"WITH {LISTED} SELECT file, 'all' AS kind FROM fl WHERE n % 6 IN (0, 1, 2, 5) UNION ALL SELECT file, 'flat' FROM fl WHERE NOT deep AND n % 6 IN (0, 1, 2, 5) UNION ALL SELECT file, 'mask' FROM fl WHERE n % 6 = 4 UNION ALL SELECT file, 'exact' FROM fl WHERE NOT deep AND n % 6 = 1")
def file_listing(spark, sf_dir):
    """Listings: pictures at any depth or in the folder alone, masks of predictions, and endings in lower case only."""
    path = folder_of_files(spark, sf_dir)
    kinds = {
        "all": list_files(spark, path, recursive=True), "flat": list_files(spark, path), "mask": list_files(spark, path, ("npy",), recursive=True),
        "exact": list_files(spark, path, ("jpg", "jpeg"), any_case=False),
    }
    parts = [rows.select("file", F.lit(kind).alias("kind")) for kind, rows in kinds.items()]
    return reduce(DataFrame.unionAll, parts)


@registered("""WITH t AS (SELECT DISTINCT page_id % 400 AS n FROM pages),
    f AS (SELECT 'a' || CAST(n // 3 AS VARCHAR) AS stem, ['jpeg', 'jpg', 'png', 'PNG'][n % 4 + 1] AS ending FROM t WHERE n % 5 <> 0),
    p AS (SELECT DISTINCT stem || '.' || ending AS file, stem, CASE ending WHEN 'jpg' THEN 0 WHEN 'png' THEN 1 ELSE 2 END AS priority FROM f WHERE ending <> 'PNG')
    SELECT file, stem, CAST(priority AS INTEGER) AS priority, CAST(row_number() OVER (PARTITION BY stem ORDER BY priority, file) AS INTEGER) AS place FROM p""")
def truth_listing(spark, sf_dir):
    """Annotated images of a folder by ending, and the place of each among those of its stem; a fifth lie in a folder below and don't count."""
    path = shared_folder(spark)
    n = spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") % 400).alias("n")).distinct()
    ending = F.get(F.array(*map(F.lit, ("jpeg", "jpg", "png", "PNG"))), (F.col("n") % 4).cast("int"))
    files = n.select("n", F.concat(F.lit("a"), F.expr("n DIV 3").cast("string"), F.lit("."), ending).alias("file"), F.lit(b"x").alias("content"))
    files = written(files, f"{path}-names")
    write_files(files.where("n % 5 = 0"), f"{path}/deep")
    write_files(files.where("n % 5 <> 0"), path)
    own = Window.partitionBy("stem").orderBy("priority", "file")
    return list_truths(spark, path).select("file", "stem", "priority", F.row_number().over(own).alias("place"))


@registered(f"WITH {POINTS} SELECT CAST(id AS VARCHAR) AS image, list_transform([label - 1, label // 2, label + 3, 5], lambda x: CAST(x AS BIGINT)) AS corners FROM p WHERE id % 3 <> 0")
def json_round_trip(spark, sf_dir):
    """Detection metadata written as JSON lines and read with its schema; boxes have whole corners."""
    path = shared_folder(spark)
    p = vectors(spark, sf_dir).where("id % 3 <> 0").select(F.col("id").cast("string").alias("filename"), "label")
    box = F.array(F.col("label") - 1.0, F.floor(F.col("label") / 2) + 0.75, F.col("label") + 3.25, F.lit(5.0))
    write_json(p.select("filename", F.array(F.lit(8), F.lit(8)).alias("image_shape"), F.lit(1).alias("num_detections"), F.array(box).alias("bboxes"), F.lit(1).alias("segmentation_labels")), path)
    rows = boxes_of(spark.read.schema(DETECTIONS).json(path))
    return rows.select("image", F.array(*(F.col(c).cast("long") for c in ("x1", "y1", "x2", "y2"))).alias("corners"))


@registered(f"WITH {MASKS}, {metrics_sql('mk', 'image')} SELECT image, round(iou, 6) AS iou, round(dice, 6) AS dice FROM a")
def csv_round_trip(spark, sf_dir):
    """Detailed results written as CSV and read again."""
    path = shared_folder(spark)
    write_csv(mask_metrics(spark, sf_dir).select("image", "iou", "dice"), path)
    return spark.read.schema("image long, iou double, dice double").csv(path, header=True)


# Whole paths of the reference

@registered(f"""WITH RECURSIVE {{outlines}}, {{flat}} SELECT a.image, tp, fp, fn, tn, {ROUNDED}, h.hausdorff, h.surface FROM a JOIN ({{ends}}) h USING (image) WHERE tp + fp > 0 AND tp + fn > 0""".format(outlines=OUTLINES, flat=metrics_sql("mk", "image"), ends=DISTANCES))
def all_metrics(spark, sf_dir):
    """The nine metrics in one call; images with an empty mask on either side are left out."""
    rows = metrics.all_metrics(masks(spark, sf_dir), F.col("v") > 0.3, F.col("truth"))
    return rounded_metrics(rows, "image", *(rounded(c).alias(c) for c in ("hausdorff", "surface")))


@registered()
def segment(spark, sf_dir):
    """Inclusions found in every image, by brightness and by clusters of regions, with the default settings; images are enlarged to 32 x 32 pixels."""
    sizes = vectors(spark, sf_dir).select(F.col("id").alias("image"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    wide = raster.resized(small_images(spark, sf_dir), sizes, 32, 32)
    bright = F.greatest(F.col("v"), F.lit(0.0)) / 0.3
    value = F.floor(F.least(F.lit(255.0), bright * bright * 255))
    return segmentation.segment(wide.select("image", "y", "x", value.alias("v"), (F.col("v") > -1).alias("inside")))


@registered()
def cluster_images(spark, sf_dir):
    """Images clustered by mean value and texture, in two clusters, after two rounds of moves."""
    table = clustering.image_features(small_images(spark, sf_dir), F.col("v") > 0)
    return clustering.cluster_images(table, 2, rounds=2)


@registered(f"""WITH RECURSIVE {POINTS}, all_p AS (SELECT * FROM p), pt AS (SELECT 'test' AS part UNION ALL SELECT 'train'),
d AS (SELECT part, a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM pt, all_p a, all_p b WHERE (a.id % 5 = 0) = (part = 'test') AND (b.id % 5 = 0) = (part = 'test')),
k AS (SELECT part, i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) - 1 AS r FROM d), q AS (SELECT part, i AS id, 1 / (avg(d) + 1e-9) AS raw FROM k WHERE r BETWEEN 1 AND 5 GROUP BY part, i),
m AS (SELECT part, id, raw / sum(raw) OVER (PARTITION BY part) AS m FROM q),
h AS (SELECT d.part, d.i AS id, d.j AS parent, d.d FROM d JOIN m a ON a.id = d.i JOIN m b ON b.id = d.j WHERE b.m > a.m QUALIFY row_number() OVER (PARTITION BY d.i ORDER BY d.d, d.j) = 1),
f AS (SELECT d.part, quantile_cont(a.m * b.m / (d.d * d.d + 1e-9), 0.5) AS mid FROM d JOIN m a ON a.id = d.i JOIN m b ON b.id = d.j GROUP BY d.part),
t AS (SELECT h.part, h.id, parent FROM h JOIN m a ON a.id = h.id JOIN m b ON b.id = parent JOIN f ON f.part = h.part WHERE a.m * b.m / (d * d + 1e-9) <= mid),
u AS (SELECT m.part, m.id, t.parent FROM m LEFT JOIN t ON t.id = m.id),
w AS (SELECT part, id, id AS a FROM u UNION ALL SELECT w.part, w.id, u.parent FROM w JOIN u ON u.id = w.a WHERE u.parent IS NOT NULL),
l AS (SELECT part, a AS id, min(id) AS least FROM w GROUP BY part, a), r AS (SELECT l.part, p.label AS truth, l.least AS found FROM l JOIN all_p p USING (id)),
o AS (SELECT part, truth, found, count(*) AS k FROM r GROUP BY ALL), s1 AS (SELECT part, truth, sum(k) AS k FROM o GROUP BY ALL), s2 AS (SELECT part, found, sum(k) AS k FROM o GROUP BY ALL),
g AS (SELECT part, sum(k) AS n, sum(k * (k - 1) / 2) AS i FROM o GROUP BY part),
y AS (SELECT g.part, n, i, (SELECT sum(k * (k - 1) / 2) FROM s1 WHERE s1.part = g.part) AS a, (SELECT sum(k * (k - 1) / 2) FROM s2 WHERE s2.part = g.part) AS b,
  (SELECT -sum(k / n * ln(k / n)) FROM s1 WHERE s1.part = g.part) AS h1, (SELECT -sum(k / n * ln(k / n)) FROM s2 WHERE s2.part = g.part) AS h2,
  (SELECT sum(o.k / n * ln(n * o.k / (s1.k * s2.k))) FROM o JOIN s1 ON s1.part = o.part AND s1.truth = o.truth JOIN s2 ON s2.part = o.part AND s2.found = o.found WHERE o.part = g.part) AS mi FROM g)
SELECT part, CAST(n AS BIGINT) AS n, round((i - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) + 0.0 AS ari, round(mi / ((h1 + h2) / 2), 6) + 0.0 AS nmi FROM y""")
def train_and_evaluate(spark, sf_dir):
    """A fifth of the points and the others, each clustered on its own by links to the nearest heavier point below the median, and held against the labels."""
    rows = vectors(spark, sf_dir)
    found = clustering.train_and_evaluate({"train": rows.where("id % 5 <> 0"), "test": rows.where("id % 5 = 0")})
    return found.select("part", "n", rounded("ari").alias("ari"), rounded("nmi").alias("nmi"))
