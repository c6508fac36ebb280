"""Connected components of links, and dense numbers within groups, for any number of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from gyrolith.sources.tables import removed, shared_folder, written


def least_linked(links: DataFrame, *group: str) -> DataFrame:
    """(*group, id, root) for links (*group, a, b): the smallest id that each linked node reaches.

    A node takes the least of its neighbours' roots, and then its root's root; such jumps double, so rounds are few even for
    long chains. Rounds are written and the one before is removed.
    """
    spark, folder, keys = links.sparkSession, shared_folder(links.sparkSession), list(group)
    both = written(links.select(*keys, "a", "b").unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/links")
    state = written(both.select(*keys, F.col("a").alias("id")).distinct().withColumn("root", F.col("id")), f"{folder}/roots-0")
    step = 0
    while True:
        step += 1
        near = both.join(state.select(*keys, F.col("id").alias("b"), "root"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("root").alias("least"))
        new = state.join(near, [*keys, "id"]).select(*keys, "id", F.col("root").alias("old"), F.least("root", "least").alias("mid"))
        jump = new.select(*keys, F.col("id").alias("mid"), F.col("mid").alias("root"))
        seen = Observation()
        rows = new.join(jump, [*keys, "mid"]).observe(seen, F.count_if(F.col("root") != F.col("old")).alias("changed"))
        state = written(rows.select(*keys, "id", "root"), f"{folder}/roots-{step}")
        removed(spark, f"{folder}/roots-{step - 1}")
        if not seen.get["changed"]:
            return state


def numbered_within(rows: DataFrame, group: str, column: str) -> DataFrame:
    """The rows (group, column), each distinct, with `number` from 1 in order within their group; ranges are numbered apart and then shifted."""
    ranged = written(rows.select(group, column).repartitionByRange(group, column).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "__part").agg(F.count("*").alias("n"))  # a row for each group and partition it touches
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__part", group).orderBy(column))
    return ranged.withColumn("__own", own).join(sizes.select(group, "__part", before.alias("__before")), [group, "__part"]).select(group, column, (F.col("__own") + F.col("__before")).alias("number"))
