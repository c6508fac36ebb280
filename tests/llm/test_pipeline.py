from collections import defaultdict

import corpus_pipeline
import numpy as np
import test_line_dedup
import test_near_dup
import test_toxicity

from gyrolith.llm import pii, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_does_its_work_on_what_it_gets(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == COLUMNS and all(r.n_chars == len(r.text or "") for r in kept[name][1])

    before, after = kept["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    own = model.evidence
    known = dict(zip(words := sorted({w for r in before for w in toxicity.words_in(r.text)}), own.of(words), strict=True))
    scores = model.score(np.array([test_toxicity.plain_features(known.__getitem__, model.held, r.text) for r in before]))
    assert {r.doc_id for r in after} == {r.doc_id for r, s in zip(before, scores, strict=True) if s < 0.5}
    assert 0.8 * len(before) < len(after) < len(before)

    before, after = kept["line_dedup"]
    assert {r.doc_id: r.text for r in after} == {r.doc_id: x[2] for r, x in zip(before, test_line_dedup.plain([r.text for r in before], 10), strict=True)}

    before, after = kept["near_dedup"]
    assert {r.doc_id for r in after} == {d for d, _, _, keep in test_near_dup.plain([(r.doc_id, r.text) for r in before]) if keep}
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}

    before, after = kept["pii"]
    texts = {r.doc_id: r.text for r in after}
    anchors = pii.automaton()
    for r in before:
        assert texts[r.doc_id] == pii.redacted(r.text, pii.spans_of(r.text, anchors)) and not [s for s in pii.spans_of(texts[r.doc_id], anchors) if s[1] == 0]

    before, after = kept["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    sizes = defaultdict(int)
    for r in after:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 1024


def test_run_and_odd_rows(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    odd = [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "no id", "en", None, 5), (902, "same", "en", "s", 4), (902, "same", "en", "s", 4)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert {900, 901, None, 902} <= set(ids) and ids.count(902) == 1
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "empty" / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "empty" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
