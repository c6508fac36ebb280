import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from gyrolith.llm import packing

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 5))
def test_bins_hold_what_fits_without_gaps(sizes, most):
    bins, at = packing.OpenBins(20, most), defaultdict(int)
    for s in sizes:
        k, offset = bins.place(s)
        assert offset == at[k] and offset + s <= 20 and bins.count <= most
        at[k] += s


def test_fast_ids_are_the_tokenizers():
    t = packing.Tokens(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in ("", "it's  naïve\n\n x", "a<|endoftext|>b", "漢字 ȩ ½ \x1c\x85 z", "Ünï 12³ ª"):
        assert t.encode(text).tolist() == t.slow.encode(text, add_special_tokens=False).ids


def test_sequences_are_few(spark):
    """At most 3 % more than the tokens could fill, on a table whose every task packs some hundred documents."""
    rows = packing.op6_packing(spark, "/root/testdata/sf0.1").select("sequence_id", "length").collect()
    assert len({r.sequence_id for r in rows}) <= 1.03 * sum(r.length for r in rows) / 1024


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op6_packing(spark, sf).collect()
    t = packing.Tokens(P.path("byte_bpe_50k.json"), None, None)
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == texts.keys()
    total = 0
    for doc, own in by.items():
        ids, at = np.append(t.encode(texts[doc]), 2).astype("<u4"), 0
        total += len(ids)
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert len(ids) > 1024 or r.length == len(ids)
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 1024


def test_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert len(rows) == 3 and all(r.length == 1 for r in rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0
