"""Lines that many documents share, dropped by levelled sorted runs of line hashes; DataFrame functions alone.

Documents come in batches. A batch counts its line keys, merge-anti-joins the runs for their settled keys (those that already
reached the threshold need no more counting) and writes what is left as a sorted run of level 0. As soon as a
level holds two runs they are merged by a full outer join into one of the next level, where counts add up. A last merge
over all levels gives every count. Then the lines whose key is settled leave their documents.

A key is held as two 64-bit hashes. Runs are bucketed and sorted by it, so joins between runs need no exchange. A batch
counts within its tasks before it shuffles, so a line that stands in a third of all documents is one row for each
task; a condition on the count keeps the optimizer from moving the anti-join below it, where raw lines would be shuffled.

Which lines to drop is found by a broadcast of the settled keys where they are few. Where they are more, only keys of
at least 1 / HELD of all line rows are broadcast, which can't be more than HELD; each of the others holds too
small a share to make its partition hot, so they meet their lines in a join. Texts are shuffled once, by a hash of
their row; only lines to be dropped are gathered by document.

Defined results: a null text is one empty line and stays null unless changed; repeated rows count as documents
of their own and lose the same lines; a document that loses every line becomes empty.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolith.llm.common import ascii_lower, free_names, removed, shared_folder, written

SPACES = " \t\n\x0b\x0c\r"
#: Documents from which on a line is dropped, batches a table is read in, and keys that every task may hold.
MIN_DOCS, BATCHES, HELD = 10, 4, 200_000
KEY = ["__h1", "__h2"]


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(text):
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))


def hashed(key):
    return F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit(1), key).alias("__h2")


class LineRuns:
    """Runs of (hash, documents with the line), bucketed and sorted by hash, as tables in the shared folder.

    Buckets need a catalog entry; entries last until `finish`.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS):
        self.spark, self.min_docs = spark, min_docs
        self.folder, self.name = shared_folder(spark), f"gyrolith_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []
        self.made = 0

    def _write(self, run: DataFrame) -> str:
        name, self.made = f"{self.name}_{self.made}", self.made + 1
        run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        removed(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[str]:
        return [name for name in self.levels if name]

    def unsettled(self, keys: DataFrame) -> DataFrame:
        """A batch's keys, counted, without those that are settled; `keys` has a row for each document and distinct line key."""
        run = keys.groupBy(*KEY).agg(F.count("*").alias("__n")).alias("run")
        for name in self.runs():
            known = self.spark.table(name).where(F.col("__n") >= self.min_docs).hint("merge").alias("known")
            same = [F.col(f"run.{k}") == F.col(f"known.{k}") for k in KEY]
            run = run.join(known, [*same, F.col("run.__n") > 0], "left_anti").alias("run")
        return run

    def add(self, keys: DataFrame) -> None:
        name, level = self._write(self.unsettled(keys)), 0
        while level < len(self.levels) and self.levels[level]:
            name, self.levels[level] = self._merged(self.levels[level], name), None
            level += 1
        self.levels[level : level + 1] = [name]

    def both(self, a: str, b: str) -> DataFrame:
        """The keys of two runs with their counts added."""
        n = F.coalesce(F.col("a.__n"), F.lit(0)) + F.coalesce(F.col("b.__n"), F.lit(0))
        sides = self.spark.table(a).hint("merge").alias("a").join(self.spark.table(b).alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY], "full")
        return sides.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEY), n.alias("__n"))

    def _merged(self, a: str, b: str) -> str:
        name = self._write(self.both(a, b))
        self._drop(a)
        self._drop(b)
        return name

    def finish(self) -> DataFrame:
        """All keys at the threshold. Only the last run's files stay, without a catalog's entry."""
        self.levels = [reduce(self._merged, rest)] if (rest := self.runs()) else []
        found = self.spark.createDataFrame([], "__h1 long, __h2 long, __n long")
        if self.levels:
            self.spark.sql(f"DROP TABLE {self.levels[0]}")
            found = self.spark.read.schema(found.schema).parquet(f"{self.folder}/{self.levels[0]}")
        return found.where(F.col("__n") >= self.min_docs).select(*KEY)


def in_batches(docs: DataFrame, text: str, n: int) -> list[DataFrame]:
    """The rows in n parts: by the files they come from, so that each part reads its own, or where these are too few by a hash of the text."""
    try:
        by_file = len(docs.inputFiles()) >= 2 * n
        parts = [docs.where(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(n)) == k) for k in range(n)] if by_file else []
    except AnalysisException:  # rows that come from no files
        parts = []
    return parts or [docs.where(F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(n)) == k) for k in range(n)]


def line_keys(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    keys = docs.select(F.explode(F.array_distinct(keys_of(F.col(f"`{text}`")))).alias("__key"))
    return keys.where(F.length("__key") >= min_chars).select(*hashed(F.col("__key")))


def common_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """Hashes (__h1, __h2) of the line keys that stand in at least `min_docs` documents."""
    runs = LineRuns(docs.sparkSession, min_docs)
    for part in in_batches(docs, text, batches):
        runs.add(line_keys(part, text, min_chars))
    return runs.finish()


def dropped_places(places: DataFrame, keys: DataFrame, common: DataFrame, held: int) -> DataFrame:
    """The places whose key is common; `keys` has a row for each document and distinct line key."""
    if common.count() <= held:
        return places.join(F.broadcast(common), KEY, "left_semi")
    counts = written(keys.groupBy(*KEY).agg(F.count("*").alias("__n")).join(common, KEY, "left_semi"), f"{shared_folder(places.sparkSession)}/counts")
    least = (keys.count() or 1) / held
    hot = counts.where(F.col("__n") >= least).select(*KEY)  # at most `held` keys, as each has that share of the rows
    own = places.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), KEY, "left")
    cold = own.where("__hot IS NULL").drop("__hot").join(counts.where(F.col("__n") < least).select(*KEY), KEY, "left_semi")
    return own.where("__hot").drop("__hot").unionByName(cold)


def drop_common_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int = BATCHES, held: int = HELD) -> DataFrame:
    """The rows with the text's other lines, and n_lines and n_dropped, which replace columns of those names."""
    common = common_lines(docs, text, min_docs, min_chars, batches)
    r1, r2, drop = free_names(docs.columns, "__r1", "__r2", "__drop")
    body, row = F.col(f"`{text}`"), F.col(f"`{key}`")
    ids = (F.xxhash64(row, body).alias(r1), F.xxhash64(F.lit(1), body, row).alias(r2))
    places = docs.select(*ids, F.posexplode(keys_of(body)).alias("__at", "__key")).select(r1, r2, "__at", *hashed(F.col("__key")))
    drops = dropped_places(places, line_keys(docs, text, min_chars), common, held)
    drops = drops.groupBy(r1, r2).agg(F.sort_array(F.collect_set("__at")).alias(drop))

    made = ("n_lines", "n_dropped")
    keep = [c for c in docs.columns if c.lower() not in made]
    lines = lines_of(body)
    starts = F.concat(F.array(F.lit(0)), F.transform(drop, lambda x: x + 1))
    ends = F.concat(F.col(drop), F.array(F.size(lines)))
    runs = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"]))
    kept = F.when(F.col(drop).isNull(), body).otherwise(F.array_join(F.flatten(runs), "\n"))
    found = docs.select(*(F.col(f"`{c}`") for c in keep), *ids).join(drops, [r1, r2], "left")
    return found.select(
        *(kept.alias(c) if c == text else F.col(f"`{c}`") for c in keep),
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and a digest of the kept text, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = drop_common_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = f"""
WITH l AS (SELECT doc_id, rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents)),
k AS (SELECT *, trim(translate(line, '{UPPER}', '{UPPER.lower()}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= {MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON c.key = k.key GROUP BY rid"""
