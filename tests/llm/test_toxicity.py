import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from gyrolith.llm import toxicity


def plain_evidence(words, toxic, ordinary, order, d):
    """The two models with dictionaries, one character at a time."""
    frames = [f"\x02{w}\x03" for w in words]
    grams, suffixes = [Counter(), Counter()], set()
    for s, t, o in zip(frames, toxic, ordinary, strict=True):
        for i in range(1, len(s)):
            g = s[max(0, i + 1 - order) : i + 1]
            grams[0][g] += t
            grams[1][g] += o
            suffixes |= {g[k:] for k in range(len(g))}
    low = Counter(x[1:] for x in suffixes if len(x) > 1 and len(x) <= order)
    total, kinds = Counter(), Counter()
    for x, n in low.items():
        if len(x) < order:
            total[x[:-1]] += n
            kinds[x[:-1]] += 1
    base = 1 / max(100, len({g[-1] for g in grams[0]}))

    def shared(x):
        p = base
        for k in range(1, len(x) + 1):
            h = x[len(x) - k :]
            if total[h[:-1]] and low[h]:
                p = (max(low[h] - d, 0) + d * kinds[h[:-1]] * p) / total[h[:-1]]
        return p

    sums = [defaultdict(float), defaultdict(float)]
    types = [Counter(), Counter()]
    for c in (0, 1):
        for g, n in grams[c].items():
            sums[c][g[:-1]] += n
            types[c][g[:-1]] += n > 0

    def evidence(w):
        s, out = f"\x02{w}\x03", 0.0
        for i in range(1, len(s)):
            g = s[max(0, i + 1 - order) : i + 1]
            p = []
            for c in (0, 1):
                m = sums[c][g[:-1]]
                rest = min(1, d * types[c][g[:-1]] / m) if m else 1.0
                p.append((max(grams[c][g] - d, 0) / m if m else 0) + rest * (shared(g[1:]) if g in grams[0] else 1.0))
            if sums[0][g[:-1]] + sums[1][g[:-1]] >= toxicity.CONTEXT_LEAST:
                out += math.log(p[0] / p[1])
        return out

    return evidence


def test_tables_give_the_models_probabilities():
    words, toxic, ordinary = ["abab", "abc", "bad", "badly", "cab"], [0, 1, 5, 2, 0], [3, 4, 0, 1, 2]
    for order in (3, 4, 6):
        got = toxicity.Evidence(words, np.array(toxic), np.array(ordinary), order)
        want = plain_evidence(words, toxic, ordinary, order, toxicity.DISCOUNT)
        for w in [*words, "bade", "ab", "zzz", "b"]:
            assert abs(got.of([w])[0] - want(w)) < 1e-4, (order, w)


def test_frequent_ends_of_contexts_are_split(spark, tmp_path, monkeypatch):
    """Ends with many places are dealt by more characters, to the same table."""
    words = ["interesting", "resting", "nesting", "testing", "tested", "ring", "singing", "stringing", "restingly", "ingot", "strings"]
    rows = [(w, k % 3, (5 * k) % 4) for k, w in enumerate(words)]
    want = plain_evidence(*zip(*rows, strict=True), toxicity.ORDER, toxicity.DISCOUNT)
    table = spark.createDataFrame(rows, "w string, toxic long, ordinary long").repartition(3)
    for most, split in ((2_000_000, 0), (4, 3), (1, 4)):
        monkeypatch.setattr(toxicity, "SUFFIX_PLACES", most)
        assert len({len(h) for h in toxicity.short_strings(table, f"{tmp_path}/strings-{most}")[1]}) >= split
        got = toxicity.Evidence.gathered(toxicity.context_table(table, f"{tmp_path}/{most}"))
        for w in [*words, "wresting", "zzz", "sting"]:
            assert abs(got.of([w])[0] - want(w)) < 1e-4, (most, w)


def plain_gains(texts, least, d):
    """What a word before adds to the evidence of a word, from lists of words with their class (0 toxic)."""
    n, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for ws, c in texts:
        n[c].update(ws)
    able = {w for w in set(n[0]) | set(n[1]) if n[0][w] + n[1][w] >= least}
    for ws, c in texts:
        pairs[c].update(p for p in zip(ws, ws[1:], strict=False) if p[0] in able and p[1] in able)
    every = set(pairs[0]) | set(pairs[1])
    left = Counter(w for _, w in every)
    kept = [p for p in every if pairs[0][p] + pairs[1][p] >= least]

    def share(p, c):
        return max(pairs[c][p] - d, 0) / n[c][p[0]] if n[c][p[0]] else 0.0

    out = {}
    for p in kept:
        log = []
        for c in (0, 1):
            total = sum(n[c].values())
            alone = max(n[c][p[1]] - d, 0) / total + d * len(n[c]) / total * left[p[1]] / len(every)
            back = 1 - sum(share(q, c) for q in kept if q[0] == p[0])
            log.append(math.log((share(p, c) + back * alone) / alone))
        out[p] = log[0] - log[1]
    return out


def plain_features(evidence, gains, text):
    """The mean length-normalised difference of the three most toxic words."""
    ws = regex.findall(r"[\p{L}\p{M}\p{N}]{1,40}", (text or "").lower())
    e = [(evidence(w) + gains.get((v, w), 0.0)) / (len(w) + 1 + toxicity.PRIOR) for v, w in zip([None, *ws], ws, strict=False)]
    return [sum(sorted(e)[-3:]) / 3]


def plain_model(rows):
    """(evidence of a word, gains of pairs) learned from rows (id, text, toxic)."""
    texts = [(regex.findall(r"[\p{L}\p{M}\p{N}]{1,40}", (t or "").lower()), 1 - y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    n = [Counter(), Counter()]
    for ws, c in texts:
        n[c].update(ws)
    words = sorted(set(n[0]) | set(n[1]))
    table = toxicity.Evidence(words, *(np.array([n[c][w] for w in words], float) for c in (0, 1)))
    return (lambda w: table.of([w])[0]), plain_gains(texts, toxicity.PAIR_LEAST, toxicity.DISCOUNT), table


def area(scores, labels):
    """The share of pairs of a toxic and an ordinary document that the scores order rightly."""
    t, o = ([s for s, y in zip(scores, labels, strict=True) if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in t for b in o) / (len(t) * len(o))


def test_held_out_recall_precision_and_area(spark):
    """On the larger table: far better than a constant, whose recall is 0 and whose area is a half."""
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(rows) == 10_000
    held = [r for r in rows if r.held_out and r.toxic is not None]
    found, toxic = sum(r.predicted == 1 for r in held), sum(r.toxic == 1 for r in held)
    both = sum(r.predicted == 1 and r.toxic == 1 for r in held)
    assert both >= 0.85 * toxic and both >= 0.85 * found
    assert area([r.score for r in held], [r.toxic for r in held]) >= 0.95


def test_the_length_normalised_difference_decides(spark):
    """One feature, of positive weight; scores are its logistic."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"))
    print(model.weights)
    assert len(model.weights) == 2 and model.weights[0] > 0


def test_nulls_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "bad word"), (3, "x" * 50_000), (3, "x" * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None
    assert [r.toxicity for r in toxicity.score_documents(docs, None).collect()] == [0.0] * 5
    made = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words here and "), F.when(F.col("id") % 2 == 0, F.concat(F.lit("awful"), F.col("id") % 9)).otherwise("fine")).alias("text"))
    model = toxicity.fit(made, made.select("doc_id", (1 - F.col("doc_id") % 2).alias("toxic")))
    rows = toxicity.score_documents(docs.withColumn("toxicity", F.lit("clash")), model).collect()
    assert len(rows) == 5 and all(0 <= r.toxicity <= 1 for r in rows) and rows[0].toxicity == rows[1].toxicity
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    right = toxicity.score_documents(made, model).where((F.col("toxicity") >= 0.5) == (F.col("doc_id") % 2 == 0)).count()
    assert right >= 390


def test_combining_marks_stay_in_words(spark):
    """Counting and scoring split alike: a word is known by the evidence that it was counted with."""
    texts = ["हिन्दी नमस्ते दुनिया" if k % 2 else "हिन्दी धन्यवाद दुनिया" for k in range(300)]
    assert toxicity.words_in(texts[1]) == texts[1].split()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    evidence, gains, _ = plain_model([(k, t, k % 2) for k, t in enumerate(texts)])
    assert set(r.w for r in model.pairs.collect()) <= {w for t in texts for w in t.split()}
    assert evidence("नमस्ते") > 3 and evidence("धन्यवाद") < -3
    rows = toxicity.score_documents(docs, model).collect()
    assert all((r.toxicity >= 0.5) == (r.doc_id % 2 == 1) for r in rows)


def test_order_of_words(spark):
    """Two classes with equal words in another order."""
    rng = np.random.default_rng(3)
    kinds = [["you", "are", "bad", "not"], ["are", "you", "not", "bad"]]
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 30, 5)), *kinds[k % 2], *(f"w{x}" for x in rng.integers(0, 30, 5))]) for k in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    rows = [r for r in toxicity.score_documents(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.toxicity >= 0.5) == (r.doc_id % 2 == 1) for r in rows) >= 0.9 * len(rows)


def test_scores_against_plain_ones_and_bounds_of_memory(spark, monkeypatch):
    """Bounds hold for the regression's rows and for what a task remembers, with few places for an end; counts, pairs and features come from all."""
    word = F.translate(F.lpad((F.col("id") * 7919 % 100_000).cast("string"), 5, "0"), "0123456789", "abcdefghij")
    made = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and "), word, F.when(F.col("id") % 2 == 0, F.lit(" awful words")).otherwise(F.lit(" fine fine words and")), F.lit(" some words")).alias("text"))
    labels = made.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    evidence, gains, table = plain_model([(r.doc_id, r.text, 1 - r.doc_id % 2) for r in made.collect()])
    found = []
    for memory, contexts in ((toxicity.MEMORY, toxicity.CONTEXTS), (3, 12)):
        monkeypatch.setattr(toxicity, "MEMORY", memory)
        monkeypatch.setattr(toxicity, "CONTEXTS", contexts)
        monkeypatch.setattr(toxicity, "SUFFIX_PLACES", 10 * memory)
        model = toxicity.fit(made, labels, rows=(15, 15))
        assert set(model.evidence.contexts.tolist()) == set(table.contexts.tolist())
        assert model.all_pairs == model.all_contexts == (memory > 3)
        got = {(r.v, r.w): r.e for r in model.pairs.collect()}
        assert got.keys() == gains.keys() and len(got) >= 5 and all(abs(got[p] - gains[p]) < 1e-9 for p in got)
        rows = toxicity.score_documents(made.unionAll(made.limit(1)).withColumn("__r1", F.lit("x")), model).collect()
        assert len(rows) == 601 and rows[0]["__r1"] == "x"
        plain = model.score(np.array([plain_features(evidence, gains, r.text) for r in rows]))
        assert max(abs(r.toxicity - p) for r, p in zip(rows, plain, strict=True)) < 1e-4
        found.append(model.weights)
    assert np.abs(found[0] - found[1]).max() < 1e-3


def test_long_texts_through_the_model(spark):
    made = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words here "), F.when(F.col("id") % 2 == 0, "awful").otherwise("fine")).alias("text"))
    model = toxicity.fit(made, made.select("doc_id", (1 - F.col("doc_id") % 2).alias("toxic")))
    long = spark.createDataFrame([(1, "some words here " * 200_000), (2, "x" * 3_000_000), (3, "awful " * 300_000), (4, "some words here awful")], "doc_id long, text string")
    rows = {r.doc_id: r.toxicity for r in toxicity.score_documents(long, model).collect()}
    assert len(rows) == 4 and rows[3] >= 0.5 and rows[4] >= 0.5 and rows[1] < 0.5


def test_pairs_grow_with_the_input(spark, tmp_path):
    """More words, more pairs: the count that a pair needs grows with the root of all words only."""
    rng = np.random.default_rng(5)
    drawn = [[f"w{min(int(x), 400)}" for x in rng.zipf(1.3, 300)] for _ in range(1_600)]
    found = []
    for n in (100, 400, 1_600):
        texts = spark.createDataFrame([(k % 2, " ".join(ws)) for k, ws in enumerate(drawn[:n])], "__y int, __text string")
        words = toxicity.tallies(texts, lambda ws: ((w,) for w in ws), "w string")
        found.append(toxicity.pair_table(texts, words, f"{tmp_path}/{n}", least=2).count())
    assert found[1] >= 1.4 * found[0] and found[2] >= 1.4 * found[1]


def test_pairs_that_are_not_held_are_told_by_their_bits(spark):
    pairs = [(f"a{k}", f"b{k % 7}") for k in range(300)]
    bits = toxicity.pair_bits(spark.createDataFrame(pairs, "v string, w string"), 1 << 16)
    scorer = toxicity.Scorer(toxicity.Evidence(["a"], np.array([1]), np.array([1])), 0.0, {pairs[0]: 1.0}, bits)
    flat = [w for p in pairs for w in p] + ["b1", "b2"]
    codes, first = scorer.codes(flat), np.array([0])
    gain, held = scorer.gain(codes, first)
    asked = scorer.elsewhere(codes, first, held)
    assert gain[1] == 1.0 and held[1] and not asked[1] and asked[3:600:2].all() and asked[2:602:2].mean() < 0.05


def test_pairs_do_not_depend_on_how_much_else_there_is(spark, tmp_path, monkeypatch):
    """A pair that occurs often enough in a small table is one of a large table too; however often workers hand on their counts."""
    rows, found = [(k % 2, "alpha beta gamma") for k in range(toxicity.PAIR_LEAST)], []
    for n, places in ((10, None), (1_000_000, None), (10, 3)):
        if places:
            monkeypatch.setattr(toxicity, "PAIR_PLACES", places)
            monkeypatch.setattr(toxicity, "PAIR_ROWS", 1)
        texts = spark.createDataFrame([*rows, (0, "other " * n + "once only")], "__y int, __text string").coalesce(1)
        words = toxicity.tallies(texts, lambda ws: ((w,) for w in ws), "w string")
        found.append({(r.v, r.w): r.n for r in toxicity.pair_table(texts, words, f"{tmp_path}/{n}-{places}").collect()})
        assert {p: found[-1].get(p) for p in (("alpha", "beta"), ("beta", "gamma"))} == {("alpha", "beta"): toxicity.PAIR_LEAST, ("beta", "gamma"): toxicity.PAIR_LEAST}
    assert found[1][("other", "other")] == 999_999 and len(found[0]) == len(found[2]) == 2


def test_largest_gains_of_slots_bound_every_pair(spark):
    """A slot's level stands for at least the gain of each of its pairs."""
    pairs = [(f"a{k}", f"b{k % 7}", (k - 150) / 7.3) for k in range(300)]
    tops = toxicity.pair_tops(spark.createDataFrame(pairs, "v string, w string, e double"), toxicity.PIECE)
    scorer = toxicity.Scorer(toxicity.Evidence(["a"], np.array([1]), np.array([1])), 0.0, {}, bytes(1 << 13), tops)
    codes = scorer.codes([w for p in pairs for w in p[:2]])
    most = scorer.most(codes, np.arange(1, 600, 2))
    e = np.array([p[2] for p in pairs])
    assert (most >= e).all() and np.median(most - np.maximum(e, 0)) <= toxicity.LEVEL


def test_texts_without_a_label_are_left_out_before_the_join(spark):
    docs = spark.createDataFrame([(k, f"word{k}") for k in range(500)] + [(None, "none")], "__key long, __text string")
    known = toxicity.labelled(spark.createDataFrame([(k, k % 2) for k in range(0, 500, 5)], "id long, toxic int"), "id", "toxic")
    rows = toxicity.counting_texts(docs, known)
    found = rows.hint("merge").collect()
    some = {r["__key"] for r in known.where(f"__fold <> {toxicity.CALIBRATE}").collect()}
    assert sorted(r["__text"] for r in found) == sorted(f"word{k}" for k in some)
    before = rows._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "PythonUDF" in before or "ArrowEvalPython" in before


def test_memory_of_scoring_does_not_follow_the_batch():
    words = [f"w{k:x}" for k in range(3_000)]
    scorer = toxicity.Scorer(toxicity.Evidence(words, np.ones(3_000), np.ones(3_000)), 0.0, {}, None)
    peaks = []
    for rows in (150, 900):
        texts = pa.array([" ".join(words[k % 7 :: 2]) for k in range(rows)])
        batch = pa.RecordBatch.from_arrays([texts, pa.array(range(rows)), pa.array(range(rows))], names=["t", "a", "b"])
        scorer.forget()
        tracemalloc.start()
        assert sum(len(b) for b in toxicity.text_parts([batch], scorer)) == rows
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]
