"""Byte-level BPE in two tiers.

Tier one: a minimal perfect hash over the vocabulary turns a whole pre-token that is a token into its id with
one probe. Tier two: a pre-token that is not one starts as linked single bytes, and a heap of mergeable
neighbours, lowest rank first, merges them. Encoding is a map over partitions; each pre-token that a worker
has met is remembered up to a fixed number, as prose repeats its words.

Defined results: a null text encodes like an empty one, to no ids; repeated rows encode alike.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyrolith.llm.common import slices

#: Pre-tokens that a worker remembers; beyond it the memory starts anew.
MEMORY = 400_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a rank file."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash of n keys: a displacement for each bucket of about four sends its keys to n slots.

    slots[place(key)] is the only id that the key can have; the caller compares the bytes.
    """

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.buckets = self.n // 4 + 1
        self.shift = np.zeros(self.buckets, np.int64)
        self.slots = np.full(self.n, -1, np.int64)
        members: dict[int, list[tuple[int, int]]] = {}
        for k, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            members.setdefault(h % self.buckets, []).append((h, k))
        free = np.ones(self.n, bool)
        ordered = sorted(members.items(), key=lambda x: (-len(x[1]), x[0]))
        tries = np.arange(1, 257, dtype=np.uint64)
        for bucket, own in ordered:
            if len(own) == 1:
                break
            base = np.array([h for h, _ in own], np.uint64)
            start = np.uint64(0)
            while True:
                places = self._mixed(base[:, None], (start + tries)[None, :])
                fits = free[places].all(axis=0)
                if len(own) > 1:
                    s = np.sort(places, axis=0)
                    fits &= (s[1:] != s[:-1]).all(axis=0)
                if fits.any():
                    best = int(np.argmax(fits))
                    self.shift[bucket] = int(start) + best + 1
                    free[places[:, best]] = False
                    self.slots[places[:, best]] = [k for _, k in own]
                    break
                start += np.uint64(256)
        left = iter(np.flatnonzero(free).tolist())
        for bucket, own in ordered:  # a lone key takes any free slot: a negative displacement names it
            if len(own) == 1:
                place = next(left)
                self.shift[bucket] = -place - 1
                self.slots[place] = own[0][1]

    def _mixed(self, h, d):
        with np.errstate(over="ignore"):
            x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            return ((x >> np.uint64(16)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The only possible id of each key."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        place = np.where(d < 0, -d - 1, self._mixed(h, np.maximum(d, 0).astype(np.uint64)))
        return self.slots[place]


class Vocabulary:
    """The rank table with its perfect hash and its table of merges; its size is that of the vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.known = [k for k, t in enumerate(tokens) if t]
        self.hash = PerfectHash([tokens[k] for k in self.known])
        self.merges: dict[int, int] | None = None

    def prepare(self) -> None:
        """Every split of a token into two tokens, as (left, right) -> token; built in the worker."""
        if self.merges is None:
            ids = {t: k for k, t in enumerate(self.tokens) if t}
            self.bytes = [ids[bytes([b])] for b in range(256)]
            self.merges = {}
            for t, k in ids.items():
                for cut in range(1, len(t)):
                    left, right = ids.get(t[:cut]), ids.get(t[cut:])
                    if left is not None and right is not None:
                        self.merges[left << 32 | right] = k

    def whole(self, pieces: list[bytes]) -> list[int]:
        """The id of each piece that is a token, else -1."""
        if not pieces:
            return []
        slots = self.hash.find(pieces).tolist()
        return [self.known[s] if s >= 0 and self.tokens[self.known[s]] == p else -1 for s, p in zip(slots, pieces, strict=True)]

    def merged(self, piece: bytes) -> list[int]:
        """Linked bytes, merged by a heap: lowest rank first, leftmost among equals."""
        ids = [self.bytes[b] for b in piece]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := merges.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            right = after[k]
            if ids[k] < 0 or right >= n or merges.get(ids[k] << 32 | ids[right]) != rank:
                continue
            ids[k], ids[right] = rank, -1
            after[k] = far = after[right]
            if far < n:
                before[far] = k
                if (r := merges.get(rank << 32 | ids[far])) is not None:
                    heappush(heap, (r, k))
            if (near := before[k]) >= 0 and (r := merges.get(ids[near] << 32 | rank)) is not None:
                heappush(heap, (r, near))
        return [x for x in ids if x >= 0]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        vocabulary.prepare()
        self.vocabulary = vocabulary
        # White space as Unicode defines it, without the four separators that Python's own class adds.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.seen: dict[str, str] = {}

    def encode(self, texts: list[str | None]) -> list[str]:
        """Decimal ids joined by commas, for each text."""
        pieces = [self.split(t) if t else [] for t in texts]
        seen = self.seen
        if len(seen) > MEMORY:
            seen.clear()
        new = list({p for x in pieces for p in x if p not in seen})
        raw = [p.encode() for p in new]
        for p, b, whole in zip(new, raw, self.vocabulary.whole(raw), strict=True):
            seen[p] = str(whole) if whole >= 0 else ",".join(map(str, self.vocabulary.merged(b)))
        return [",".join([seen[p] for p in x]) for x in pieces]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.token = {str(k): t for k, t in enumerate(vocabulary.tokens) if t}

    def decode(self, ids: str) -> bytes:
        token = self.token
        return b"".join([token[x] for x in ids.split(",")]) if ids else b""


def encode_documents(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", digests: bool = False) -> DataFrame:
    """The rows with their token ids, array<int>, in a column that replaces any of that name.

    With `digests`, columns n_tokens, ids_sha256 and decoded_sha256 come in place of the ids: the digests of the
    comma-joined ids and of the bytes that those ids decode to.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks)))
    added = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {ids: T.ArrayType(T.IntegerType())}
    rest = [c for c in docs.columns if c.lower() not in {a.lower() for a in added} and not (digests and c == text)]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(c, kind) for c, kind in added.items()])

    def run(batches):
        encoder = Encoder(vocabulary.value, pattern)
        decoder = Decoder(vocabulary.value)
        for batch in slices(batches, text):
            names = batch.schema.names
            found = encoder.encode(batch.column(names.index(text)).to_pylist())
            columns = [batch.column(names.index(c)) for c in rest]
            if digests:
                columns += [pa.array([x.count(",") + 1 if x else 0 for x in found], pa.int64())]
                columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in found])]
                columns += [pa.array([hashlib.sha256(decoder.decode(x)).hexdigest() for x in found])]
            else:
                columns.append(pa.array([list(map(int, x.split(","))) if x else [] for x in found], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(n, c.type) for n, c in zip([*rest, *added], columns, strict=True)]))

    keep = dict.fromkeys([*rest, text])
    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)


def decode_documents(rows: DataFrame, ranks: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the bytes that their ids stand for; a null list decodes to no bytes."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks)))
    rest = [c for c in rows.columns if c.lower() != text.lower()]
    schema = T.StructType([rows.schema[c] for c in rest] + [T.StructField(text, T.BinaryType())])

    def run(batches):
        token = vocabulary.value.tokens
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids)).to_pylist()
            columns = [batch.column(batch.schema.names.index(c)) for c in rest] + [pa.array([b"".join(token[k] for k in x or ()) for x in lists], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, text])

    return rows.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them, for every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
