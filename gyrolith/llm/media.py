"""Payload columns in a store of content-defined chunks.

A rolling gear hash cuts each payload where its last 32 bytes say so, so equal passages of some length fall into equal
chunks wherever they stand. A first pass counts chunk digests. Documents none of whose chunks occurs elsewhere
keep their chunks in their own row and are never shuffled; the others keep an ordered list of digests, and their
chunks are stored once, deduplicated by digest. To tell both apart each task gets a bitmap, sized by the number of
digests that occur more than once and 32 MB at most; where it errs, a chunk goes to the store that need not.

Reading rebuilds the bytes: rows with their own chunks directly, the others by a join of distinct lists with the store. Each
chunk is verified against its digest and each payload against its own.

Defined results: a null text is an empty one, whose payload is 192 spaces; repeated rows and equal texts get equal
values, whatever their ids; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.llm.common import bitmap, bitmap_bits, shared_folder, written

#: Payloads are filled up with spaces to a multiple of this many samples.
BLOCK = 192
#: Bytes of a chunk: least, most, and the bits that must be 0 at a cut (one place in 2048).
LEAST, MOST, CUT_BITS = 512, 16_384, np.uint32(0x7FF << 21)
SEGMENT, WINDOW = 1 << 20, 32

RECIPE = "doc_id long, n_bytes long, payload_bytes long, payload binary, digests array<binary>, chunks array<binary>, apart boolean"


def gear_table() -> np.ndarray:
    """256 fixed random words, by a rule."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)


def candidates(data: bytes, gear: np.ndarray) -> list[int]:
    """Ends of possible chunks: places after whose last 32 bytes the rolling hash has zeros in CUT_BITS."""
    found = []
    for at in range(0, len(data), SEGMENT):
        lead = min(at, WINDOW - 1)
        h = gear[np.frombuffer(data, np.uint8, min(len(data) - at, SEGMENT) + lead, at - lead)]
        for s in (1, 2, 4, 8, 16):  # the hash of 2s bytes from two hashes of s bytes
            longer = h.copy()
            longer[s:] += h[:-s] << np.uint32(s)
            h = longer
        found += (np.flatnonzero((h[lead:] & CUT_BITS) == 0) + at + 1).tolist()
    return found


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % BLOCK or (BLOCK if not raw else 0)), len(raw)


def chunks_of(payloads: list[bytes], gear: np.ndarray) -> list[list[bytes]]:
    """The chunks of each payload. All are hashed in one go: a cut needs LEAST bytes, more than the hash looks back."""
    ends, start, out = candidates(b"".join(payloads), gear), 0, []
    for data in payloads:
        own, at, n = [], 0, len(data)
        while at < n:
            k = bisect_left(ends, start + at + LEAST)
            cut = min(ends[k] - start if k < len(ends) else n, at + MOST, n)
            own.append(data[at:cut])
            at = cut
        out.append(own)
        start += n
    return out


def split_batches(batches, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, int]]]]:
    """Parts of the batches of a few megabytes, with their payloads."""
    for batch in batches:
        texts, at = batch.column(column), 0
        while at < batch.num_rows:
            made, total = [], 0
            while at + len(made) < batch.num_rows and total < 4 << 20:
                made.append(payload_of(texts[at + len(made)].as_py()))
                total += len(made[-1][0])
            yield batch.slice(at, len(made)), made
            at += len(made)


def digest_of(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


@dataclass(frozen=True)
class MediaStore:
    """Recipes: a row for each document, with its own chunks or with digests. Chunks: digest and compressed bytes, once each."""

    recipes: DataFrame
    chunks: DataFrame
    folder: str


def chunk_digests(docs: DataFrame) -> DataFrame:
    def run(batches):
        gear = gear_table()
        for _, made in split_batches(batches):
            found = [digest_of(c) for own in chunks_of([p for p, _ in made], gear) for c in own]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["digest"])

    return docs.mapInArrow(run, "digest binary")


def repeated_bitmap(docs: DataFrame, folder: str) -> bytes:
    """Bit k is set if a chunk whose digest starts with a number that is k modulo the bits occurs more than once."""
    many = written(chunk_digests(docs).groupBy("digest").count().where("count > 1").select("digest"), f"{folder}/repeated")
    bits = bitmap_bits(many.count())
    start = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return bitmap(many.select((start % bits).alias("p")), bits)


def store_payloads(docs: DataFrame, key: str = "doc_id", text: str = "text") -> MediaStore:
    """Stores the payload of every row in a new folder below the shared one."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    folder = shared_folder(spark)
    marked = spark.sparkContext.broadcast(repeated_bitmap(docs, folder))

    def repeated(digest: bytes) -> int:
        held = marked.value
        k = int.from_bytes(digest[:4], "big") % (8 * len(held))
        return held[k >> 3] >> (k & 7) & 1

    def recipes(batches):
        gear, pack = gear_table(), zstandard.ZstdCompressor(level=3).compress
        for batch, made in split_batches(batches):
            cut = chunks_of([p for p, _ in made], gear)
            digests = [[digest_of(c) for c in own] for own in cut]
            apart = [any(map(repeated, own)) for own in digests]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([len(p) for p, _ in made], pa.int64()), pa.array([digest_of(p) for p, _ in made], pa.binary()),
                pa.array(digests, pa.list_(pa.binary())), pa.array([[] if a else list(map(pack, own)) for a, own in zip(apart, cut, strict=True)], pa.list_(pa.binary())), pa.array(apart, pa.bool_()),
            ], names=["doc_id", "n_bytes", "payload_bytes", "payload", "digests", "chunks", "apart"])

    def shared(batches):
        gear, pack = gear_table(), zstandard.ZstdCompressor(level=3).compress
        for _, made in split_batches(batches):
            found = {}
            for own in chunks_of([p for p, _ in made], gear):
                digests = [digest_of(c) for c in own]
                if any(map(repeated, digests)):
                    found |= zip(digests, own, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(map(pack, found.values())), pa.binary())], names=["digest", "data"])

    own = written(docs.mapInArrow(recipes, RECIPE), f"{folder}/recipes")
    once = docs.mapInArrow(shared, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"))
    return MediaStore(own, written(once, f"{folder}/chunks"), folder)


def rebuilt(digests: list[bytes], data: list[bytes], payload: bytes) -> tuple[bytes, bytes]:
    """(payload, stored form), verified; the stored form is each compressed chunk after its length in four bytes."""
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [unpack(x) for x in data]
    whole = b"".join(raw)
    if list(map(digest_of, raw)) != digests or digest_of(whole) != payload:
        raise ValueError("stored bytes do not match their digests")
    return whole, b"".join(len(x).to_bytes(4, "big") + x for x in data)


def read_payloads(store: MediaStore, function: Callable[[bytes, bytes], dict], fields: str) -> DataFrame:
    """doc_id, n_bytes and `function`(payload, stored form), a dict of `fields`, for every stored row."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches, keys):
        for batch in batches:
            rows = batch.to_pylist()
            found = [function(*rebuilt(r["digests"], r["chunks"], r["payload"])) for r in rows]
            made = pa.RecordBatch.from_pylist(found) if found else None
            if made is not None:
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(k)) for k in keys), *(made.column(made.schema.names.index(n)) for n in names)], names=[*keys, *names])

    alone = store.recipes.where("NOT apart").select("doc_id", "n_bytes", "payload", "digests", "chunks")
    direct = alone.mapInArrow(lambda b: run(b, ["doc_id", "n_bytes"]), f"doc_id long, n_bytes long, {fields}")
    # Every payload once, whatever its copies; its list by a join that may split a chunk that many payloads share.
    lists = store.recipes.where("apart").select("payload", F.posexplode("digests").alias("at", "digest")).distinct()
    parts = lists.join(store.chunks, "digest")
    whole = parts.groupBy("payload").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "data"))).alias("c"))
    whole = whole.select("payload", F.col("c.digest").alias("digests"), F.col("c.data").alias("chunks"))
    once = written(whole.mapInArrow(lambda b: run(b, ["payload"]), f"payload binary, {fields}"), f"{store.folder}/features")
    joined = store.recipes.where("apart").select("doc_id", "n_bytes", "payload").join(once, "payload", "left").select("doc_id", "n_bytes", *names)
    return direct.unionByName(joined)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(payload: bytes, stored: bytes) -> dict:
    """Digests of both forms, and mean and deviation of the samples by channel, read as rows of 64 pixels of 3 samples."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, 3).astype(np.int64)
    mean = samples.sum(0) / len(samples)
    deviation = np.sqrt(np.maximum((samples**2).sum(0) / len(samples) - mean**2, 0))
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(stored),
        "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": " ".join(f"{x:.4f}" for x in (*mean, *deviation)),
    }


def op3_media(spark, sf_dir: str) -> DataFrame:
    """Digests and features of every document's payload, read back from the chunk store."""
    store = store_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return read_payloads(store, features, FEATURES)
