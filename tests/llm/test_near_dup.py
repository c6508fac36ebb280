import random

import numpy as np
import pytest
from oracle import compare

from gyrolith.llm import near_dup


def plain(rows):
    """Components by comparing all pairs; rows: (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for k, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    seen = set()
    for own in by.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        parent[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root(k)] = min(d, least.get(root(k), d))
    return sorted((d, len(sets[k]), least[root(k)], least[root(k)] == d) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, sf):
    sf = f"/root/testdata/{sf}"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in near_dup.op7_near_dup(spark, sf).collect()) == plain(texts)


def test_large_group_of_near_copies_and_shared_passages(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    base, passage = rng.choices(vocabulary, k=120), rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    rows += [" ".join([*passage, *rng.choices(vocabulary, k=rng.randint(5, 90))]) for _ in range(150)]
    rows += [" ".join(base)] * 40 + ["", None, "one two", "ONE  two", " \n", "x"]
    rng.shuffle(rows)
    rows = list(enumerate(rows, 10))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == plain(rows)


def test_repeats_null_ids_and_empty_table(spark):
    text = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (4, text + " x"), (9, None), (None, None)], "doc_id long, text string")
    got = sorted(map(str, near_dup.near_duplicates(docs).collect()))
    want = ["Row(doc_id=4, n_shingles=37, component_id=4, kept=True)", "Row(doc_id=5, n_shingles=36, component_id=4, kept=False)", "Row(doc_id=5, n_shingles=36, component_id=4, kept=False)",
            "Row(doc_id=9, n_shingles=0, component_id=9, kept=True)", "Row(doc_id=None, n_shingles=0, component_id=None, kept=True)", "Row(doc_id=None, n_shingles=36, component_id=None, kept=True)"]
    assert got == want
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(3)
    for j in (0.2, 0.5, 0.75, 0.95):
        found = []
        for _ in range(60):
            u = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            both = int(1000 * j)
            x, y = u[: both + (1000 - both) // 3], np.concatenate([u[:both], u[both + (1000 - both) // 3 :]])
            a, b = near_dup.registers(near_dup.mixed(x)), near_dup.registers(near_dup.mixed(y))
            found.append(near_dup.estimates(a[None], b[None], np.array([len(x)]), np.array([len(y)]))[0])
            merged = near_dup.registers(near_dup.mixed(np.union1d(x, y)))
            assert (np.maximum(a, b) == merged).all()
        assert abs(np.mean(found) - j) < 0.03 and np.std(found) < 0.07


def test_query_against_sql(spark):
    compare(near_dup.op7_near_dup(spark, "/root/testdata/sf0.01"), near_dup.SQL, "/root/testdata/sf0.01")
