"""Best-fit packing of token sequences in bounded space.

Each task packs the documents of its own partition as they come. A fixed number of sequences is open; a bitset
keyed by free space finds the fullest one that a piece fits into with two bit operations. When no open
sequence fits and all places are taken, the fullest closes. So a task holds a few hundred open sequences,
whatever it reads, and packing needs no shuffle.

Defined results: a null text is an empty one, whose document is the end mark alone; every row is a document of
its own, repeated or not.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.llm.common import slices

#: Tokens of a sequence, the id that ends a document, and how many sequences a task keeps open.
LENGTH, END, OPEN = 1024, 2, 512

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Open sequences by free space; bit f of `bits` is set if one has f places free."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.count, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        own = self.bins[free]
        found = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of `size`."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            found, free = self.made, self.length
            self.made += 1
        if left := free - size:
            self.bins[left].append(found)
            self.bits |= 1 << left
            self.count += 1
        return found, self.length - free


class Tokens:
    """Ids as the tokenizer file gives them.

    The rank file of the same vocabulary encodes the same ids several times faster; it serves texts of letters
    that every Unicode version classes alike, and the tokenizer itself all others.
    """

    SIMPLE = re.compile("[\x00-ɏ‐-‧€]*")
    MARK = "<|endoftext|>"

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.fast = None
        if ranks:
            import tiktoken

            from gyrolith.llm.bpe import read_ranks

            ids = {t: k for k, t in enumerate(read_ranks(ranks)) if t}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ids, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast and self.MARK not in text and self.SIMPLE.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, opened: int = OPEN) -> DataFrame:
    """One row for each piece: its place in its document and its sequence, and a checksum of its ids.

    A document longer than a sequence is cut from its end into whole sequences, so only its first piece, the
    rest, competes for space.
    """
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        tokens, bins = Tokens(tokenizer, ranks, pattern), OpenBins(length, opened)
        first = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1):
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(tokens.encode(body), np.uint32(end)).astype("<u4")
                n, piece, start = len(ids), 0, 0
                while start < n:
                    size = (n - start) % length or length
                    sequence, offset = bins.place(size)
                    rows.append((doc, piece, start, size, zlib.crc32(ids[start : start + size].tobytes()), first + sequence, offset))
                    piece, start = piece + 1, start + size
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return docs.mapInArrow(run, SCHEMA)


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
