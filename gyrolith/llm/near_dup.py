"""Near-duplicate documents by SetSketch registers over word shingles.

A register is the truncated, exponentially spaced logarithm of a minimum over the document's hashed shingles; sketches
merge by maximum and agree in about the Jaccard share of their registers. Documents with equal sets become one
class. Bands of registers put classes into buckets. In each bucket every class is paired with the most
central one only (the one that meets the most others over all its bands). Each pair's similarity is estimated from its
registers by maximum likelihood, and what is not far below the threshold is verified on the full sets. Verified
links give components; a bucket whose classes fell into one component is done.

What is left in other buckets goes through the pairs of different components that sizes allow. In large buckets,
shingles that occur in only one of their documents bound what a pair can share: of n shingles a document has m that
occur elsewhere, so x and y have at most min(m(x), m(y)) in common and at least n(x) + n(y) less that in their
union. Documents that by this bound can reach the threshold with no size of partner in their bucket are left
out, so unrelated texts that share a passage, or copies with many changes, do not meet pair by pair. The others
are held against the larger components of their buckets, block by block, on full sets.

Sets are built a second time, for the documents of some pair only; a bitmap over their ids, of 32 MB at most, tells
tasks which ones, so texts are never shuffled.

Defined results: a text without words, or null, has no shingles and links with nothing; fewer words than a shingle
are one shingle; repeated rows share a class; a row without doc_id takes no part, has no component and is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.llm.common import bitmap, bitmap_bits, shared_folder, slices, tidied, written

#: Words of a shingle; links have at least PERCENT per hundred of their union in common.
WORDS, PERCENT = 5, 75
#: Registers by band and bands: a pair at the threshold shares no bucket with a probability of 2.4e-5.
ROWS, BANDS = 4, 28
REGISTERS = ROWS * BANDS
#: SetSketch parameters: base, rate and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Estimates below this are no candidates (6 standard deviations below the threshold).
LEAST_ESTIMATE = 0.5
#: Buckets up to this size compare all pairs of their components.
SMALL = 32
#: Documents and members of a block, about, where documents meet whole components.
ASKING, MEMBERS = 256, 512
MEMORY = 400_000
#: Hashes that a task counts before it passes them on.
PART = 1 << 20

_seed = np.random.default_rng(20240607)
XOR = _seed.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]
ODD = (_seed.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1))[:, None]
PRIME = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, memory: Words, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z alone, and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    if len(memory) > MEMORY:
        memory.clear()
    w = np.array([memory[x] for x in words], np.uint64)
    width = min(size, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * PRIME + w[k : len(w) - width + 1 + k]
            h ^= h >> np.uint64(32)
    return np.unique(mixed(h))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set that is not empty."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    for at in range(0, low.shape[1], 4096):
        least = np.minimum(least, ((low[:, at : at + 4096] ^ XOR) * ODD).min(axis=1))
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of register values."""
    parts = sketch.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * PRIME
    for k in range(ROWS):
        key = mixed(key ^ parts[:, k] + np.uint64(k << 20))
    return key.view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each pair of sketches (rows), by maximum likelihood given the sizes of the sets."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = REGISTERS - more - less
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    score = more * log(up) + less * log(down) + same * log(1 - up - down)
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, bands): size, 128-bit digest and band keys of every document's set."""

    def run(batches):
        memory = Words()
        for batch in slices(batches, 1):
            n, s1, s2, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, memory)
                n.append(len(own))
                whole = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                s1.append(int(whole[0]))
                s2.append(int(whole[1]))
                bands.append(band_keys(registers(own)) if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, sketch, hashes) of the documents among `ids`, and of a few others whose bit is set too."""
    size = bitmap_bits(ids.count())
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.pmod(F.xxhash64("id"), F.lit(size)).alias("p")), size))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size))

    def run(batches):
        memory, marked = Words(), np.frombuffer(bits.value, np.uint8)
        for batch in slices(batches, 1):
            at = batch.column(2).to_numpy(zero_copy_only=False)
            own = pa.array((marked[at >> 3] >> (at & 7) & 1).astype(bool))
            batch = batch.filter(own)
            sets = [shingles(t, memory) for t in batch.column(1).to_pylist()]
            keep = [k for k, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep, pa.int64())), pa.array([len(sets[k]) for k in keep], pa.int64()),
                pa.array([registers(sets[k]).tobytes() for k in keep], pa.binary()), pa.array([sets[k].tobytes() for k in keep], pa.binary()),
            ], names=["id", "n", "sketch", "hashes"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", place.alias("at")).mapInArrow(run, "id long, n long, sketch binary, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, with the sizes of their intersection and union."""

    def run(batches):
        for batch in slices(batches, "ha"):
            rows = batch.to_pydict()
            na, nb = np.array(rows["na"], float), np.array(rows["nb"], float)
            out = ([], [], [], [])
            if len(na):
                sketch = lambda c: np.frombuffer(b"".join(rows[c]), np.uint16).reshape(-1, REGISTERS)
                likely = estimates(sketch("ka"), sketch("kb"), na, nb) >= LEAST_ESTIMATE
                for k in np.flatnonzero(likely):
                    x, y = np.frombuffer(rows["ha"][k], np.uint64), np.frombuffer(rows["hb"][k], np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    union = len(x) + len(y) - both
                    if 100 * both >= PERCENT * union:
                        for c, v in zip(out, (rows["a"][k], rows["b"][k], both, union), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "both", "either"])

    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"k{c}"), F.col("hashes").alias(f"h{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, both long, either long")


def components(links: DataFrame, folder: str) -> DataFrame:
    """(id, c): every linked id with the smallest id it reaches, by minima over neighbours and doubled jumps."""
    both = written(links.select("a", "b").unionAll(links.select("b", "a")).toDF("a", "b"), f"{folder}/links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "id"), f"{folder}/labels-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("c").alias("was"), F.least("c", "near").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("c").alias("far"))
        new = written(written(least, f"{folder}/near-{step}").join(jump, "c").select("id", "was", F.least("c", "far").alias("c")), f"{folder}/labels-{step}")
        labels = new.select("id", "c")
        if not new.where("c <> was").limit(1).count():
            return labels


def star_pairs(buckets: DataFrame, folder: str) -> DataFrame:
    """Each class with the most central one of each of its buckets: (a, b), a < b."""
    central = written(buckets.groupBy("id").agg(F.sum("size").alias("met")), f"{folder}/central")
    hubs = written(buckets.join(central, "id").groupBy("key").agg(F.max(F.struct("met", -F.col("id"))).alias("best")).select("key", (-F.col("best.col2")).alias("hub")), f"{folder}/hubs")
    pairs = buckets.join(hubs, "key").where("id <> hub")
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def open_buckets(rows: DataFrame, folder: str) -> DataFrame:
    """The rows of buckets with more than one component c."""
    many = rows.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
    return rows.join(written(many, folder), "key", "left_semi")


def pairs_within(rows: DataFrame) -> DataFrame:
    """Pairs of different components within each bucket, (a, b), a < b; rows (key, id, c, n, m), with at most m shingles in common with others."""
    side = lambda x, cx: rows.select("key", F.col("id").alias(x), F.col("c").alias(cx), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}"))
    pairs = side("a", "ca").join(side("b", "cb"), "key").where("a < b AND ca <> cb").where(enough("ma", "mb", "na", "nb"))
    return pairs.select("a", "b").distinct()


def enough(ma: str, mb: str, na: str, nb: str):
    """Whether two sets of na and nb with at most ma and mb in common with others can reach the threshold."""
    return (100 + PERCENT) * F.least(ma, mb) >= PERCENT * (F.col(na) + F.col(nb))


def hash_counts(sets: DataFrame) -> DataFrame:
    """(h, k, id): hashes with the number of sets that hold them, and one of these; counted within parts of tasks, to be summed by hash."""

    def run(batches):
        def counted(ids, parts):
            h, first, k = np.unique(np.concatenate(parts), return_index=True, return_counts=True)
            owner = np.repeat(np.array(ids, np.int64), list(map(len, parts)))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(k.astype(np.int64)), pa.array(owner[first])], names=["h", "k", "id"])

        ids, parts, size = [], [], 0
        for batch in slices(batches, 1):
            for one, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(one)
                parts.append(np.frombuffer(hashes, np.int64))
                size += len(parts[-1])
                if size >= PART:
                    yield counted(ids, parts)
                    ids, parts, size = [], [], 0
        if parts:
            yield counted(ids, parts)

    return sets.select("id", "hashes").mapInArrow(run, "h long, k long, id long")


def may_link(rows: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """The rows of large buckets, with n and m, without the documents that the bound shows to have no link there."""
    own = sets.join(rows.select("id").distinct(), "id", "left_semi")
    single = hash_counts(own).groupBy("h").agg(F.sum("k").alias("k"), F.min("id").alias("id")).where("k = 1").groupBy("id").agg(F.count("*").alias("u"))
    bound = written(own.select("id", "n").join(single, "id", "left").select("id", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("m")), f"{folder}/bound")
    rows = written(rows.join(bound, "id"), f"{folder}/bounded")
    kinds = written(rows.groupBy("key", F.col("n").alias("other")).agg(F.max("m").alias("most")), f"{folder}/kinds")  # few sizes in each bucket
    left = rows.join(kinds.withColumnRenamed("key", "there"), (F.col("key") == F.col("there")) & enough("m", "most", "n", "other"), "left_semi")
    return open_buckets(written(left, f"{folder}/left"), f"{folder}/still")


def cross_links(rows: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) between components that share a large bucket: at least one for any two components that have some.

    A document is held against whole components that are larger than its own, in blocks: a component's members by
    hash, and the documents that ask for it by hash. A document that meets a member reports the first one only.
    """
    members = written(rows.select("id", "c").distinct(), f"{folder}/members")
    sizes = members.groupBy("c").agg(F.count("*").alias("s"))
    own = written(rows.join(sizes, "c").withColumn("u", F.col("n") - F.col("m")), f"{folder}/sized")
    kinds = own.groupBy(F.col("key").alias("there"), F.col("c").alias("to"), F.col("s").alias("s2")).agg(F.max("m").alias("m2"), F.min("n").alias("n2"), F.min("u").alias("u2"))
    larger = (F.col("s2") > F.col("s")) | ((F.col("s2") == F.col("s")) & (F.col("to") < F.col("c")))
    apart = (100 - PERCENT) * F.least("m", "m2") >= PERCENT * (F.col("u") + F.col("u2"))
    asked = own.join(kinds, (F.col("key") == F.col("there")) & larger & enough("m", "m2", "n", "n2") & apart).select("id", "to").distinct()
    asked = written(asked, f"{folder}/asked")
    blocks = asked.groupBy("to").agg(F.ceil(F.count("*") / F.lit(ASKING)).cast("int").alias("x")).join(sizes.select(F.col("c").alias("to"), F.ceil(F.col("s") / F.lit(MEMBERS)).cast("int").alias("y")), "to")
    blocks = written(blocks, f"{folder}/blocks")
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = sets.select("id", "hashes")
    left = asked.join(blocks, "to").select("to", "id", spread("x").alias("i"), every("y").alias("j")).join(whole, "id").select("to", "i", "j", "id", "hashes")
    right = members.withColumnRenamed("c", "to").join(blocks, "to").select("to", "id", every("x").alias("i"), spread("y").alias("j")).join(whole, "id")
    right = right.select(*(F.col(c).alias(f"{c}2") for c in ("to", "i", "j", "id", "hashes")))  # the sides of a cogroup must not share columns

    def compare(asking, held):
        out = []
        if len(asking) and len(held):
            parts = [np.frombuffer(h, np.uint64) for h in held["hashes2"]]
            ids, sizes = held["id2"].to_numpy(), np.array(list(map(len, parts)))
            everything, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
            for one, h in zip(asking["id"], asking["hashes"], strict=True):
                x = np.frombuffer(h, np.uint64)
                k = np.minimum(np.searchsorted(x, everything), len(x) - 1)
                both = np.bincount(owner[x[k] == everything], minlength=len(parts))
                hit = np.flatnonzero(100 * both >= PERCENT * (len(x) + sizes - both))
                if len(hit):
                    out.append((one, int(ids[hit].min())))
        return pd.DataFrame(out, columns=["a", "b"])

    return left.groupBy("to", "i", "j").cogroup(right.groupBy("to2", "i2", "j2")).applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reached by links) and kept, for every row."""
    kept = shared_folder(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    with tidied():  # all but two tables go at the end
        folder = shared_folder(docs.sparkSession)
        table = written(sketches(docs), f"{kept}/sketches")
        classes = table.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n", "bands")).alias("r"))
        classes = written(classes.select("s1", "s2", F.col("r.doc_id").alias("id"), F.col("r.n").alias("n"), F.col("r.bands").alias("bands")), f"{folder}/classes")

        rows = classes.select("id", "n", F.explode("bands").alias("key"))
        sizes = written(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), f"{folder}/sizes")
        buckets = written(rows.join(sizes, "key").select("key", "id", "n", "size"), f"{folder}/buckets")

        pairs = written(star_pairs(buckets, folder), f"{folder}/stars")
        sets = written(full_sets(docs, buckets.select("id").distinct()), f"{folder}/sets")
        links = written(verified(pairs, sets), f"{folder}/star-links")
        labels = components(links, f"{folder}/first")

        own = written(buckets.join(labels, "id", "left").select("key", "id", "n", "size", F.coalesce("c", "id").alias("c")), f"{folder}/own")
        rest = open_buckets(own, f"{folder}/open")
        small, large = rest.where(f"size <= {SMALL}"), written(rest.where(f"size > {SMALL}").select("key", "id", "c"), f"{folder}/large")
        more = written(pairs_within(small.withColumn("m", F.col("n"))).join(pairs, ["a", "b"], "left_anti"), f"{folder}/rest")
        found = [links.select("a", "b"), verified(more, sets).select("a", "b"), cross_links(may_link(large, sets, folder), sets, folder)]
        links = written(found[0].unionAll(found[1]).unionAll(found[2]), f"{folder}/all-links")
        labels = components(links, f"{folder}/second")

        found = written(classes.select("s1", "s2", "id").join(labels, "id", "left").select("s1", "s2", F.coalesce("c", "id").alias("c")), f"{kept}/found")
    out = table.select("doc_id", "n", "s1", "s2").join(found, ["s1", "s2"], "left")
    part = F.when(F.col("n") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    part = F.when(F.col("doc_id").isNotNull(), part)
    return out.select("doc_id", F.col("n").alias("n_shingles"), part.alias("component_id"), F.coalesce(part == F.col("doc_id"), F.lit(True)).alias("kept"))


def op7_near_dup(spark, sf_dir: str) -> DataFrame:
    """Shingles, component and whether it is kept, of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same rows in DuckDB: every two documents that share a shingle are compared.
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(0, len(w) - {WORDS - 1}), lambda i: array_to_string(w[i + 1:i + {WORDS}], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, min(r.c) = n.doc_id AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n"""
