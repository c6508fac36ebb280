import re

from oracle import compare

from gyrolith.llm import licenses


def places(text, phrase):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    p = phrase.split()
    return [k for k in range(len(w)) if w[k : k + len(p)] == p], len(w)


def test_query_against_sql(spark, sf):
    compare(licenses.op5_licenses(spark, sf), licenses.sql(), sf)


def test_cases(spark):
    texts = [None, "", "CC BY cc-by", "All  rights. RESERVED all rights", "GNU General Public License, version 3.", "K license", "cc", "by cc", "Licensed under CC BY-NC 4.0.",
             "MIT License", "released under the MIT License", "x " * 30000 + "all rights reserved"]
    docs = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], "doc_id long, text string, labels string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for k, t in enumerate(texts):
        want = sorted(x for p in ("cc by", "general public license", "all rights reserved") for x in places(t or "", p)[0])
        assert (rows[k].n_base, rows[k].first_word, rows[k].last_word) == (len(want), want[0] if want else None, want[-1] if want else None)
        assert rows[k].n_words == places(t or "", "x")[1]
    assert rows[4].labels == "gpl,gpl-3.0" and rows[8].labels == "cc-by,cc-by-nc" and rows[9].labels == "mit"
    assert rows[9].score < rows[10].score == 1.0
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    twice = licenses.scan_licenses(docs.unionAll(docs)).groupBy("doc_id", "n_words", "n_base", "first_word", "base_labels").count().collect()
    assert len(twice) == len(texts) and all(r["count"] == 2 and r.n_base == rows[r.doc_id].n_base for r in twice)
