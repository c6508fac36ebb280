"""Very long texts, and columns whose names the operators use themselves."""

import hashlib
import os

import corpus_pipeline
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from test_near_dup import plain

from gyrolith.llm import bpe, common, licenses, media, near_dup, neighbours, packing, pii

LONG = "some words of a long text, mail a@b.cd and all rights reserved\n" * 40_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG), (2, LONG + "one more"), (3, "x" * 2_000_000), (4, "short"), (5, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("__w", "__hits", "__r1", "id", "n", "s1", "bands", "component_id", "piece", "digest", "payload", "at", "apart", "pii_spans", "labels", "sketch", "c", "key", "size")
    return table.select("*", *(F.lit(f"own {n}").alias(n) for n in names))


def test_media(docs):
    rows = {r.doc_id: r for r in media.read_payloads(media.store_payloads(docs), media.features, media.FEATURES).collect()}
    assert len(rows) == 5 and rows[1].payload_bytes % 192 == 0 and rows[3].n_bytes == 2_000_000 and rows[5].n_bytes == 0
    pad = "x" * 2_000_000
    assert rows[3].payload_sha256 == hashlib.sha256((pad + " " * (-len(pad) % 192)).encode()).hexdigest()


def test_bpe(docs):
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: k for k, t in enumerate(bpe.read_ranks(path("byte_bpe_multi_50k.tiktoken"))) if t}, special_tokens={})
    rows = {r.doc_id: r for r in bpe.encode_documents(docs, path("byte_bpe_multi_50k.tiktoken"), PATTERN, digests=True).collect()}
    assert rows[1].n_tokens == len(lib.encode_ordinary(LONG)) and rows[1]["__w"] == "own __w" and rows[5].n_tokens == 0
    assert rows[3].decoded_sha256 == hashlib.sha256(b"x" * 2_000_000).hexdigest()  # one pre-token


def test_licenses(docs):
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert rows[1].n_base == 40_000 and rows[1]["__w"] == "own __w" and rows[1].labels == "reserved" and rows[3].n_words == 1


def test_packing(docs):
    rows = packing.pack_documents(docs).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5} and max(r.length for r in rows) == 1024
    assert sum(r.length for r in rows if r.doc_id == 4) == 2


def test_near_dup(docs):
    assert sorted(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_near_dup_in_a_bucket_of_documents_that_are_not_near(spark):
    """One passage in all documents, and one of some tails in each: similar below the threshold, in many of the same buckets."""
    body = " ".join(f"t{k}" for k in range(80))
    rows = [(k, f"{body} " + " ".join(f"a{k % 60}x{j}" for j in range(14)) + " " + " ".join(f"b{k}x{j}" for j in range(4 + k % 5))) for k in range(400)]
    got = sorted(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain(rows)


def test_pii(docs):
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(rows[1].pii_spans) == 40_000 and rows[1]["__w"] == "own __w" and rows[3].pii_spans == []


def test_neighbours(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(12)], "vec_id long, embedding array<double>")
    rows = rows.select("*", *(F.lit(1).alias(n) for n in ("id", "v", "dim", "block", "part", "score", "rank", "at")))
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(rows, k=2).collect()] == [(0, 1, 1), (0, 2, 2)]


def test_pipeline(spark, docs, tmp_path):
    own = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit("extra").alias("__r1"))
    own.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    root = os.path.dirname(common.shared_folder(spark).removeprefix("file://"))
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = set(os.listdir(root)) - before
    assert {r.doc_id for r in rows} == {1, 3, 4, 5}
    assert len(left) == 1  # what the last stage reads; all other tables are gone
