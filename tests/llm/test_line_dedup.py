import re

from oracle import compare

from gyrolith.llm import line_dedup


def plain(texts, least):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(" \t\n\x0b\x0c\r")
    from collections import Counter

    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), t if len(kept) == len(lines) else "\n".join(kept)))
    return out


def test_query_against_sql(spark):
    compare(line_dedup.op1_line_dedup(spark, "/root/testdata/sf0.01"), line_dedup.SQL, "/root/testdata/sf0.01")


TEXTS = [None, "", "A\nb", "a \n\tB\r\nc", " a\n\n\na", "É\nx", "é\nx", "a\nb\nlong " + "z" * 100_000, "b\n", "b\n", "\n\n"]


def test_brute_force_with_nulls_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(k // 2 or None, t, 9, "x", "y", "z") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_lines int, __r1 string, __R2 string, __drop string")
    for least in (1, 3, 100):
        for held in (line_dedup.HELD, 2):
            found = line_dedup.drop_common_lines(docs, min_docs=least, held=held)
            rows = found.collect()
            assert sorted(map(str, ((r.n_lines, r.n_dropped, r.text) for r in rows))) == sorted(map(str, plain(TEXTS, least)))
            assert found.columns == ["doc_id", "text", "__r1", "__R2", "__drop", "n_lines", "n_dropped"] and {(r["__r1"], r["__drop"]) for r in rows} == {("x", "z")}
    assert line_dedup.drop_common_lines(docs.limit(0)).count() == 0


def test_runs_settle_over_batches_and_levels(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"x{k % 7}\ny{k}\nz{k % 40}\nz{k % 13}") for k in range(200)], "doc_id long, text string")
    docs.repartition(9).write.parquet(str(tmp_path / "many"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, plain(list(texts.values()), 10), strict=True))
    for name in ("many", "one"):
        table = spark.read.parquet(str(tmp_path / name))
        assert len(line_dedup.in_batches(table, "text", 4)) == 4
        assert sum(p.count() for p in line_dedup.in_batches(table, "text", 4)) == 200
        for batches, held in ((1, 2), (4, line_dedup.HELD), (7, 2)):
            rows = line_dedup.drop_common_lines(table, min_docs=10, batches=batches, held=held).collect()
            assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in rows} == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gyrolith")]


def test_counts_come_before_the_exchange_and_runs_need_none(spark):
    """With settled runs, the one exchange of a batch carries counts; a merge of two runs has none."""
    docs = spark.createDataFrame([(k, "same\nother\n" + str(k)) for k in range(60)], "doc_id long, text string")
    runs, keys = line_dedup.LineRuns(spark), line_dedup.line_keys(docs, "text", 1)
    runs.add(keys)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    text = plan(runs.unsettled(keys))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "SortMergeJoin" in text
    below = text[text.index("Exchange hashpartitioning") :]
    assert "partial_count" in below and "SortMergeJoin" not in below
    other = runs._write(runs.unsettled(keys))
    merge = plan(runs.both(runs.levels[0], other))
    assert "SortMergeJoin" in merge and "Exchange" not in merge
    runs._drop(other)
    assert runs.finish().count() == 2
