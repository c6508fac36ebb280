import hashlib
import re

from oracle import compare
from pyspark.sql import functions as F

from gyrolith.llm import exact_dedup

WHITE = re.compile("[\x20\x09-\x0d]")


def plain(rows):
    """{row place: (id, keep_id, size, kept, digest)} of rows (id, text)."""
    texts = [t or "" for _, t in rows]
    keys = [WHITE.sub("", t) for t in texts]
    order = sorted(range(len(rows)), key=lambda k: (-len(texts[k]), rows[k][0] is None, rows[k][0] or 0, k))
    first = {}
    for k in order:
        first.setdefault(keys[k], k)
    return [(rows[k][0], rows[first[keys[k]]][0], keys.count(keys[k]), hashlib.sha256(keys[k].encode()).hexdigest()) for k in range(len(rows))], {rows[k][0] for k in first.values()}, len(first)


def found(df):
    return sorted(((r[0], r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_query_against_sql(spark):
    compare(exact_dedup.op13_exact_dedup(spark, "/root/testdata/sf0.01"), exact_dedup.SQL, "/root/testdata/sf0.01")


TEXTS = [None, "", " \n", "a b", "ab", "a  b", "A b", "é x", "éx ", "éx ", "x" * 1_500_000, "x" * 1_500_000 + "\t", "ab", "a b", " ", "a  b", "only"]


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    rows = [(k if k not in (5, 8) else None, t) for k, t in enumerate(TEXTS)] + [(3, "a b"), (15, "a  b"), (20, "ab   "), (19, "ab   ")]
    want, kept, n = plain(rows)
    names = ("h", "sha", "row", "run", "n", "id", "size", "first", "keep_id", "kept", "__sha", "several", "most")
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("own").alias(c) for c in names)).repartition(7)
    for width, held in ((2, 50_000), (16, 50_000), (3, 1), (2, 4)):
        got = exact_dedup.exact_duplicates(docs, width=width, held=held)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert found(got) == sorted(want, key=str)
        stay = [r for r in got.collect() if r.kept]
        assert len(stay) == n == len({r.text_sha256 for r in stay}) and all(r.doc_id == r.keep_id for r in stay)
    left = exact_dedup.drop_exact_duplicates(docs)
    texts = [r.text for r in left.collect()]
    assert left.columns == docs.columns and len(texts) == n and {r["size"] for r in left.collect()} == {"own"}
    keys = {}
    for _, t in rows:
        keys[WHITE.sub("", t or "")] = max(keys.get(WHITE.sub("", t or ""), 0), len(t or ""))
    assert {(WHITE.sub("", t or ""), len(t or "")) for t in texts} == set(keys.items())
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0 == exact_dedup.drop_exact_duplicates(docs.limit(0)).count()


def test_a_collision_of_the_short_digest_joins_nothing(spark):
    rows = [(k, f"t {k % 11}" + " " * (k % 3)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = exact_dedup.exact_duplicates(docs, width=2, short=lambda t: F.lit(7).cast("long"))
    assert found(got) == sorted(plain(rows)[0], key=str)


def test_a_third_of_all_documents_alike_is_a_row_of_each_run(spark, tmp_path):
    rows = [(k, "the same  text" if k % 3 == 0 else f"text {k // 2}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    table = exact_dedup.written(exact_dedup.digested(docs, "text", "doc_id"), str(tmp_path / "d"))
    runs = table.select("run", "h", "sha", F.lit(1).cast("long").alias("size"), exact_dedup.place(F.col("n"), F.col("id"), F.col("row")).alias("first"))
    one = exact_dedup.merged(runs, 16)
    hot = one.where("size > 100").collect()
    assert len(hot) == 3 and sum(r["size"] for r in hot) == 1000  # 40 runs became 3
    text = one._jdf.queryExecution().executedPlan().toString()
    below = text[text.index("Exchange hashpartitioning") :]
    assert "partial_sum" in below and "partial_min" in below
    sizes = {r.keep_id: r.group_size for r in exact_dedup.exact_duplicates(docs).collect()}
    assert sizes[0] == 1000
