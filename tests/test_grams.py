import random

import pytest
from pyspark.sql import functions as F

from gyrolith.functions import grams


@pytest.mark.parametrize("alphabet, part", [("ab", 64), ("aé€𝄞 ", 50), ("abcdefgh", 1 << 20)])
def test_random_needles(spark, monkeypatch, alphabet, part):
    rng = random.Random(len(alphabet))
    monkeypatch.setattr(grams, "PART", part)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [word(rng.randint(0, 120)) for _ in range(120)] + [None, ""]
    needles = [word(n) for n in range(13) for _ in range(3)] + [t[3:40] for t in texts[:20] if t] + [None, "zz", texts[0], texts[0]]
    a = spark.createDataFrame(list(enumerate(needles)), "item long, n string")
    b = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "doc string, t string").repartition(3)
    got = sorted((r["item"], r.doc) for r in grams.containing(a, b).collect())
    assert got == sorted((i, f"d{k}") for i, n in enumerate(needles) for k, t in enumerate(texts) if n is not None and t is not None and n in t)
    assert grams.containing(a.limit(0), b).count() == 0 == grams.containing(a, b.limit(0)).count()


def test_rows_after_the_scan_are_near_the_hits(spark):
    """Passages that share most of their grams with all texts: the key is one that few hold."""
    texts = [(k, f"the common words of every text stand here and number {k * 7919} is rare, as the common words go on " * 3) for k in range(400)]
    docs = spark.createDataFrame(texts, "doc long, t string")
    needles = spark.createDataFrame([(k, f"the common words of every text stand here and number {k * 7919} is rare") for k in range(0, 400, 20)], "item long, n string")
    keys = grams.keys_of(needles, docs)
    rows = grams.scanned(docs, grams.SIZE, grams.bloom(keys.select("gram"))).count()
    hits = grams.containing(needles, docs).count()
    assert hits == 20 and rows <= 4 * hits


def test_the_filter_has_all_its_keys(spark):
    rows = spark.range(5000).select((F.xxhash64("id")).alias("gram"))
    held = grams.bloom(rows)
    import numpy as np

    keys = np.array([r.gram for r in rows.collect()]).view(np.uint64)
    assert held.has(keys).all() and held.has(keys + np.uint64(1)).mean() < 0.1
