"""Which texts contain which needles, found by one gram a needle.

A gram is eight bytes of UTF-8, which fit a long, so grams are compared exactly; a needle lies in a text if and only if its bytes do. Of
each needle's grams the one that the texts hold least often is its key. Texts are scanned in their Arrow buffers, all their grams at once, and
a Bloom filter of the keys is tested before any row is made; its size is bounded, and a full one only lets more rows through. What
passes meets the keys in a join, and the pairs found are verified. A needle of less than eight bytes is a gram
by itself, and what its scan finds needs no verification but the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.sources.tables import written

#: Bytes of a gram, bytes of text that are looked at together, and bytes of a piece of the filter.
SIZE, PART, PIECE = 8, 1 << 20, 1 << 16
#: Bits of a filter: 16 for each key, a power of two up to this.
MOST_BITS = 28
ODD = np.uint64(0x9E3779B97F4A7C15)


def windows(data: np.ndarray, size: int) -> np.ndarray:
    """Each run of `size` bytes as one number."""
    n = max(0, len(data) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def places(grams: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (grams ^ (grams >> np.uint64(29))) * ODD >> np.uint64(64 - bits)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a column of strings; null ones are empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]


def grams_of(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places in their texts, grams) of all runs of `size` bytes that lie within a text, part by part."""
    offsets, data = buffers(column)
    for start in range(0, len(data), PART):
        found = windows(data[start : start + PART + size - 1], size)
        at = np.arange(start, start + len(found))
        rows = np.searchsorted(offsets, at, "right") - 1
        whole = at + size <= offsets[rows + 1]
        yield rows[whole], (at - offsets[rows])[whole], found[whole]


class Bloom:
    """A filter of grams in the bytes of a bitmap."""

    def __init__(self, data: bytes, bits: int):
        self.data, self.bits = np.frombuffer(data, np.uint8), bits

    def has(self, grams: np.ndarray) -> np.ndarray:
        at = places(grams, self.bits)
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bloom(grams: DataFrame) -> Bloom:
    """A filter of the grams (gram), put together here from pieces that Spark makes: 32 MB at most."""
    bits = min(MOST_BITS, max(19, (16 * grams.count()).bit_length()))

    def pieces(batches):
        held = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = places(batch.column("gram").to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        parts = held.reshape(-1, PIECE)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_pydict({"piece": pa.array(some, pa.int32()), "bits": pa.array([parts[k].tobytes() for k in some], pa.binary())})

    def together(table: pa.Table) -> pa.Table:
        both = reduce(np.bitwise_or, (np.frombuffer(x.as_py(), np.uint8) for x in table["bits"]))
        return pa.table({"piece": table["piece"].slice(0, 1), "bits": pa.array([both.tobytes()], pa.binary())})

    out = bytearray(1 << (bits - 3))
    for r in grams.select("gram").mapInArrow(pieces, "piece int, bits binary").groupBy("piece").applyInArrow(together, "piece int, bits binary").collect():
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = r["bits"]
    return Bloom(bytes(out), bits)


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def all_grams(needles: DataFrame) -> DataFrame:
    """(item, gram, at) of all grams of needles (item, n)."""

    def run(batches):
        for batch in batches:
            for rows, at, grams in grams_of(batch.column("n"), SIZE):
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(rows)), pa.array(grams.view(np.int64)), pa.array(at, pa.int64())], ["item", "gram", "at"])

    return needles.mapInArrow(run, f"item {kind(needles, 'item')}, gram long, at long")


def counted(texts: DataFrame, known: Bloom) -> DataFrame:
    """(gram, n): how often the texts (doc, t) hold each gram that the filter lets through; counted within tasks first."""

    def run(batches):
        for batch in batches:
            for _, _, grams in grams_of(batch.column("t"), SIZE):
                gram, n = np.unique(grams[known.has(grams)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def keys_of(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(item, gram): of each needle (item, n) of at least SIZE bytes the gram that the texts hold least often. A needle with a gram that none holds has no row."""
    grams = all_grams(needles)
    seen = counted(texts, bloom(grams.select("gram").distinct()))
    own = grams.groupBy("item", "gram").agg(F.count("*").alias("k"))
    best = own.join(seen, "gram", "left").groupBy("item").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("b"))
    return best.where("b.n > 0").select("item", "b.gram")


def scanned(texts: DataFrame, size: int, keys: Bloom) -> DataFrame:
    """(doc, gram): the grams of texts (doc, t) that the filter lets through, each once for a text."""

    def run(batches):
        for batch in batches:
            found = [(rows[hit], grams[hit]) for rows, _, grams in grams_of(batch.column("t"), size) for hit in [keys.has(grams)] if hit.any()]
            if found:
                both = np.unique(np.stack([np.concatenate([r for r, _ in found]).astype(np.uint64), np.concatenate([g for _, g in found])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(both[:, 0].astype(np.int64))), pa.array(both[:, 1].view(np.int64))], ["doc", "gram"])

    return texts.mapInArrow(run, f"doc {kind(texts, 'doc')}, gram long")


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(item, doc), each once, where the text (doc, t) contains the needle (item, n); an empty needle is in every text, null is in none and holds none."""
    needles, texts = needles.where("n IS NOT NULL"), texts.where("t IS NOT NULL")
    sizes = {r["s"] for r in needles.select(F.least(F.octet_length("n"), F.lit(SIZE)).alias("s")).distinct().collect()}  # at most nine
    found = []
    for size in sorted(sizes):
        some = needles.where(F.octet_length("n") == size) if size < SIZE else needles.where(F.octet_length("n") >= SIZE)
        if size == 0:
            found.append(some.select("item", F.lit(0).alias("one")).join(texts.select("doc", F.lit(0).alias("one")), "one").select("item", "doc"))
        elif size < SIZE:
            whole = lambda batches, size=size: (pa.RecordBatch.from_arrays([b.column("item").take(pa.array(r)), pa.array(g.view(np.int64))], ["item", "gram"]) for b in batches for r, _, g in grams_of(b.column("n"), size))
            keys = some.mapInArrow(whole, f"item {kind(needles, 'item')}, gram long")
            found.append(scanned(texts, size, bloom(keys.select("gram").distinct())).join(keys, "gram").select("item", "doc"))
        else:
            keys = written(keys_of(some, texts))
            hits = scanned(texts, SIZE, bloom(keys.select("gram").distinct())).join(keys, "gram").select("item", "doc").distinct()
            found.append(hits.join(texts, "doc").join(some, "item").where(F.contains("t", "n")).select("item", "doc"))
    rows = reduce(DataFrame.unionByName, found) if found else needles.select("item").join(texts.select("doc"), F.lit(False))
    return rows.distinct()
