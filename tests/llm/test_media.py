import hashlib
import zlib

import numpy as np
import pytest

from vicinage.llm import media as M
from vicinage.llm.kernel import series


def slow_cuts(data):
    """The cuts by a hash that is rolled byte by byte."""
    gear = [int(x) & 0xFFFFFFFF for x in series(256, 31)]
    ends, begin, rolled = [], 0, 0
    for k, byte in enumerate(data):
        rolled = ((rolled << 1) + gear[byte]) & 0xFFFFFFFF
        size = k + 1 - begin
        if (size > M.LEAST - 1 and rolled < (1 << 32) // M.MEAN and size >= M.LEAST) or size == M.MOST:
            ends.append(k + 1)
            begin = k + 1
        if len(data) - begin <= M.LEAST:
            break
    return ends if ends and ends[-1] == len(data) else [*ends, len(data)]


@pytest.mark.parametrize("size", [0, 1, 2048, 2049, 30_000, 200_000])
def test_cuts_follow_the_rolling_hash(size):
    data = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8).tobytes()
    ends = M.cuts(data)
    assert ends[-1] == size and ends == sorted(set(ends))
    sizes = np.diff([0, *ends])
    assert (sizes <= M.MOST).all() and (sizes[:-1] >= M.LEAST).all()
    assert ends == slow_cuts(data)


def test_one_long_run_of_a_byte_is_cut_too():
    assert max(np.diff([0, *M.cuts(b"a" * 300_000)])) <= M.MOST


def test_an_insertion_changes_few_chunks():
    data = np.random.default_rng(9).integers(0, 256, 400_000).astype(np.uint8).tobytes()
    parts = lambda d: {d[a:b] for a, b in zip([0, *M.cuts(d)], M.cuts(d), strict=False)}
    one, two = parts(data), parts(b"some bytes more" + data)
    assert len(one & two) >= len(one) - 2


def check(rows, docs):
    assert len(rows) == len(docs)
    texts = {}
    for doc_id, text in docs:
        texts[doc_id] = text
    for row in rows:
        raw = (texts[row["doc_id"]] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = M.wave(payload)
        assert M.samples(stored) == payload
        assert row["n_bytes"] == len(raw) and row["payload_bytes"] == len(payload)
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-64:])
        assert row["media_bytes"] == len(stored) and row["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert row["feature"] == M.feature(payload)


def test_every_document_is_read_back(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check(M.op4_media(spark, small).collect(), docs)


def test_odd_rows(spark, odd_with_null_id, none):
    docs = [tuple(r) for r in odd_with_null_id.select("doc_id", "text").collect()]
    check(M.media_columns(odd_with_null_id).withColumnRenamed("id", "doc_id").collect(), docs)
    assert M.media_columns(none).collect() == []


def test_chunks_are_stored_once(spark):
    text = "".join(chr(97 + int(x)) for x in np.random.default_rng(4).integers(0, 26, 90_000))
    docs = spark.createDataFrame([(k, text + str(k % 3)) for k in range(12)], "id long, text string")
    store = M.chunk_store(docs)
    lists = M.recipes(docs).collect()
    assert store.count() == store.select("digest").distinct().count() == len({bytes(d) for r in lists for d in r["digests"]})
    assert store.count() < 2 * len(lists[0]["digests"])


def test_a_damaged_chunk_is_noticed(spark):
    docs = spark.createDataFrame([(1, "some text")], "id long, text string")
    lists = M.recipes(docs).select("media", "digests")
    import zstandard

    other = bytes(zstandard.ZstdCompressor().compress(b"other bytes"))
    store = M.chunk_store(docs).rdd.map(lambda r: (r[0], bytearray(other))).toDF("digest binary, bytes binary")
    with pytest.raises(Exception, match="don't give that file"):
        M.read_back(lists, store).collect()
