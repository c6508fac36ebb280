import base64
import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gyrolith.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENC = bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(PATH)), P.PATTERN)


def ids(text):
    x = ENC.encode([text])[0]
    return list(map(int, x.split(","))) if x else []


def test_perfect_hash_finds_every_token_and_nothing_else():
    v = ENC.vocabulary
    assert sorted(v.hash.slots.tolist()) == list(range(len(v.known)))
    assert v.whole([v.tokens[k] for k in v.known]) == v.known
    assert v.whole([b"\x00\x01no such token"]) == [-1]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abcdeé 's\n\t\x1c\x85　😀12%", max_size=60)))
def test_same_ids_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == LIB.encode_ordinary(text)


def test_long_pieces():
    for text in ("a" * 20000, " " * 5000 + "x", "ab" * 3000 + "é" * 500):
        assert ids(text) == LIB.encode_ordinary(text)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op4_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = LIB.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_round_trip_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "naïve  tokens\n", 7), (3, "naïve  tokens\n", 7)], "doc_id long, text string, ids int")
    coded = bpe.encode_documents(docs, PATH, P.PATTERN)
    back = bpe.decode_documents(coded, PATH).collect()
    assert [bytes(r.decoded).decode() for r in back] == ["", "", "naïve  tokens\n", "naïve  tokens\n"]
    assert bpe.encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0
