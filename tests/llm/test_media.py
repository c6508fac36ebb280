import hashlib
import random
import statistics
import zlib

import zstandard

from gyrolith.llm import media


def test_chunks_join_to_the_payload_and_follow_the_content():
    rng, gear = random.Random(1), media.gear_table()
    body = rng.randbytes(200_000)
    texts = [b"", b"a" * 100_000, body, rng.randbytes(777) + body[1000:], b" " * 192]
    cut = media.chunks_of(texts, gear)
    for data, own in zip(texts, cut, strict=True):
        assert b"".join(own) == data and all(len(c) <= media.MOST for c in own) and all(len(c) >= media.LEAST for c in own[:-1])
    assert len(set(cut[2]) & set(cut[3])) > 0.9 * len(cut[2])
    assert [media.chunks_of([t], gear)[0] for t in texts] == cut
    big = rng.randbytes(media.SEGMENT + 50_000)

    def slow(data):
        h, out = 0, []
        for k, b in enumerate(data):
            h = (h * 2 + int(gear[b])) & 0xFFFFFFFF
            if h & int(media.CUT_BITS) == 0:
                out.append(k + 1)
        return out

    assert [x for x in media.candidates(big, gear) if x > 32] == [x for x in slow(big) if x > 32]


def plain_stored(data):
    """Chunks cut byte by byte, each compressed and after its length."""
    gear, out, start, h = [int(x) for x in media.gear_table()], b"", 0, 0
    for k, b in enumerate(data, 1):
        h = (2 * h + gear[b]) & 0xFFFFFFFF
        size = k - start
        if k == len(data) or size == media.MOST or (size >= media.LEAST and not h & int(media.CUT_BITS)):
            packed = zstandard.ZstdCompressor(level=3).compress(data[start:k])
            out += len(packed).to_bytes(4, "big") + packed
            start = k
    return out


def check(rows, texts):
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        pad = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(pad))
        assert r.payload_sha256 == hashlib.sha256(pad).hexdigest() and r.tail_crc32 == zlib.crc32(pad[-16:])
        stored = plain_stored(pad)
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        planes = [pad[c::3] for c in range(3)]
        want = [statistics.fmean(p) for p in planes] + [statistics.pstdev(p) for p in planes]
        assert all(abs(float(x) - y) <= 1e-4 for x, y in zip(r.feature.split(), want, strict=True))


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = media.op3_media(spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    by = {}
    for r in rows:
        assert by.setdefault(texts[r.doc_id], r[2:]) == r[2:]


def test_nulls_repeats_shared_chunks_and_empty_table(spark):
    rng = random.Random(2)
    word = lambda n: " ".join(rng.choices("alpha beta gamma delta épsilon".split(), k=n))
    long = word(9000)
    texts = [None, "", long, long, word(50) + long, long + word(20), word(10)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(2, long)], "doc_id long, text string")
    store = media.store_payloads(docs)
    assert store.recipes.where("apart").count() >= 5 and store.chunks.groupBy("digest").count().where("count > 1").count() == 0
    rows = media.read_payloads(store, media.features, media.FEATURES).collect()
    assert len(rows) == 8
    check(rows, texts)
    assert media.read_payloads(media.store_payloads(docs.limit(0)), media.features, media.FEATURES).count() == 0
