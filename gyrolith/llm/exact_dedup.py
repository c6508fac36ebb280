"""Exact duplicates by a tree of merged digest runs; DataFrame functions alone.

Every partition of the table is a run: a row for each digest that it holds, with the number of its documents and the one
that stays. In each round WIDTH neighbouring runs (a binomial tree of as many runs) exchange their rows by digest and are
merged into one, until one run is left. So a text that stands in a third of all documents is a row of each run, and no task ever gets more than
WIDTH rows of it for each task of the round before. Runs are sorted by a short digest; a merge joins rows only if
their SHA-256 agrees too, so documents are never put together by a collision of the short one.

Documents then get their group. Groups of at least 1 / HELD of all documents, which can't be more than HELD, are broadcast; each of the others
is too small to make its partition hot and meets its documents in a join. Texts are read once and never shuffled.

Defined results: a null text is an empty one; of equal texts the row with the most code points stays, then the one of the
smallest id, and a row without id comes last; of rows with all this alike exactly one stays; an empty table gives no rows;
columns other than the text and the id are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.llm.common import free_names, removed, shared_folder, written

#: Characters that don't count.
SPACES = " \t\n\x0b\x0c\r"
#: Runs that are merged into one, and groups that every task may hold.
WIDTH, HELD = 16, 50_000
DIGEST = ["h", "sha"]


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def place(n, key, row):
    """What orders equal texts: the first is the one that stays."""
    return F.struct((-n).alias("less"), key.isNull().alias("none"), key.alias("id"), row.alias("row"))


def digested(docs: DataFrame, text: str, key: str, short=F.xxhash64, row: str | None = None) -> DataFrame:
    """(row, run, id, n, h, sha): each row with a number of its own, the run it belongs to, its code points and digests."""
    body = F.col(f"`{text}`")
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col(f"`{key}`").alias("id"), F.coalesce(F.length(body), F.lit(0)).alias("n"), normalised(body).alias("t"))
    return rows.select("row", F.spark_partition_id().alias("run"), "id", "n", short(F.col("t")).alias("h"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"))


def merged(runs: DataFrame, width: int) -> DataFrame:
    """One round: each `width` neighbouring runs as one, in order of their digests."""
    together = F.floor(F.col("run") / width).cast("int").alias("run")
    rows = runs.groupBy(together, *DIGEST).agg(F.sum("size").alias("size"), F.min("first").alias("first"))
    return rows.sortWithinPartitions("run", *DIGEST)


def groups(rows: DataFrame, folder: str, width: int = WIDTH) -> DataFrame:
    """(h, sha, size, first) of every text, after as many rounds as the runs need to become one."""
    spark, count = rows.sparkSession, (rows.agg(F.max("run")).first()[0] or 0) + 1
    runs, step = rows.select("run", *DIGEST, F.lit(1).cast("long").alias("size"), place(F.col("n"), F.col("id"), F.col("row")).alias("first")), 0
    while step == 0 or count > 1:
        step, count = step + 1, -(-count // width)
        runs = written(merged(runs, width), f"{folder}/runs-{step}")
        if step > 1:
            removed(spark, f"{folder}/runs-{step - 1}")
    return runs.drop("run")


def with_groups(rows: DataFrame, found: DataFrame, held: int) -> DataFrame:
    """The rows with the size and first row of their text's group; null for a text that stands alone."""
    several = found.where("size > 1").withColumnRenamed("h", "h2").withColumnRenamed("sha", "sha2")
    least = max(2, rows.count() / held)
    same = [F.col("h") == F.col("h2"), F.col("sha") == F.col("sha2")]
    hot = several.where(F.col("size") >= least)  # at most `held` groups, as each has that share of the rows
    rows = rows.join(F.broadcast(hot), same, "left").drop("h2", "sha2")
    rest = rows.where("size IS NULL").drop("size", "first")
    return rows.where("size IS NOT NULL").unionByName(rest.join(several.where(F.col("size") < least), same, "left").drop("h2", "sha2"))


def grouped(rows: DataFrame, folder: str, width: int, held: int) -> DataFrame:
    """The digested rows with (keep_id, group_size, kept)."""
    found = with_groups(rows, groups(rows, folder, width), held)
    alone = F.col("size").isNull()
    return found.select(
        "row", "id", "sha", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
    )


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, held: int = HELD, short=F.xxhash64) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row: equal texts form a group, and one row of it is kept."""
    folder = shared_folder(docs.sparkSession)
    rows = written(digested(docs, text, key, short), f"{folder}/digests")
    found = grouped(rows, folder, width, held)
    return found.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, held: int = HELD) -> DataFrame:
    """The rows that stay, with all their columns; for this the table is written once with numbers for its rows."""
    folder, (row,) = shared_folder(docs.sparkSession), free_names(docs.columns, "__row")
    table = written(docs.withColumn(row, F.monotonically_increasing_id()), f"{folder}/rows")
    rows = written(digested(table, text, key, row=row), f"{folder}/digests")
    kept = grouped(rows, folder, width, held).where("kept").select(F.col("row").alias(row))
    return table.join(kept, row, "left_semi").drop(row)


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The group of every document, and whether it stays."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS k FROM documents),
g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY k) AS group_size, first_value(doc_id) OVER (PARTITION BY k ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g"""
