import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vicinage.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, docs, tokenizer, least_full):
    """Every id of every document (id, text) is in one piece; sequences are gapless and within the limit."""
    ids = {}
    for doc_id, text in docs:
        own = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert ids.setdefault(doc_id, own) == own
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        own = ids[row["doc_id"]]
        assert row["doc_tokens"] == len(own)
        piece = own[row["start"] : row["start"] + row["length"]]
        assert len(piece) == row["length"] > 0
        assert row["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        by_doc[row["doc_id"]].append((row["start"], row["length"]))
        by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
    copies = defaultdict(int)
    for doc_id, _ in docs:
        copies[doc_id] += 1
    for doc_id, own in ids.items():
        held = sorted(k for start, n in by_doc[doc_id] for k in range(start, start + n))
        assert held == sorted(list(range(len(own))) * copies[doc_id])
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    tokens = sum(len(ids[doc_id]) for doc_id, _ in docs)
    assert tokens >= least_full * 1024 * len(by_sequence)


def test_all_documents_are_packed(spark, medium, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()]
    check(P.op3_packing(spark, medium).collect(), docs, tokenizer, 0.98)


def test_odd_rows(spark, odd, none, tokenizer):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check(P.packing_stage(spark, odd, "").collect(), docs, tokenizer, 0.9)
    assert P.packing_stage(spark, none, "").collect() == []


def test_null_and_large_ids_stay_apart(spark, odd_with_null_id, tokenizer):
    """Ids above 2 ** 53, which a double can't hold, beside a null one in one group."""
    large = [(9_007_199_254_740_993, "one two"), (9_007_199_254_740_992, "three"), (None, "no id here"), (3, "four five six")]
    check(P.packing_stage(spark, spark.createDataFrame(large, "doc_id long, text string"), "").collect(), large, tokenizer, 0.01)
    docs = [tuple(r) for r in odd_with_null_id.select("doc_id", "text").collect()]
    check(P.packing_stage(spark, odd_with_null_id, "").collect(), docs, tokenizer, 0.9)


def test_special_strings_are_what_the_tokenizer_says(spark, tokenizer):
    docs = [(1, "before <|endoftext|> after"), (2, "<|endoftext|>"), (3, "<|")]
    check(P.packing_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect(), docs, tokenizer, 0)


def test_pieces_carry_their_ids(spark, tokenizer):
    docs = spark.createDataFrame([(1, "some words and more of them " * 900)], "doc_id long, text string")
    rows = P.pieces(docs, with_ids=True).orderBy("start").collect()
    assert sum((r["ids"] for r in rows), []) == [*tokenizer.encode(docs.first()["text"], add_special_tokens=False).ids, 0]


def test_no_limit_is_passed():
    demand = np.random.default_rng(3).integers(1, 60, (500, 3))
    limits = np.array([100, 90, 80])
    of, bins = P.place(demand, limits)
    assert sorted(sum(bins, [])) == list(range(500))
    for k, rows in enumerate(bins):
        assert (of[rows] == k).all() and (demand[rows].sum(axis=0) <= limits).all()
    with pytest.raises(ValueError):
        P.place(np.array([[101, 1, 1]]), limits)


def plain_place(demand, limits):
    """Bins by the dot-product heuristic, row by row; of equal demands any row."""
    left, bins = [tuple(map(int, d)) for d in demand], []
    while left:
        room, own = list(map(float, limits)), []
        while True:
            fits = sorted({d for d in left if all(x <= r for x, r in zip(d, room, strict=True))})
            if not fits:
                break
            dot = lambda d: sum((x / m) * (r / m) for x, r, m in zip(d, room, limits, strict=True))  # noqa: B023, E731
            best = max(fits, key=lambda d: (round(dot(d), 9), [-x for x in d]))
            left.remove(best)
            own.append(best)
            room = [r - x for r, x in zip(room, best, strict=True)]
        bins.append(sorted(own))
    return bins


def test_placing_equals_plain_heuristic():
    pick = np.random.default_rng(3)
    for limits in ([100, 8, 60], [64, 4, 20]):
        length = pick.integers(1, 50, 120)
        demand = np.stack([length, np.ones(120, int), np.minimum(pick.integers(0, 50, 120), np.minimum(length, limits[2]))], axis=1)
        of, bins = P.place(demand, np.array(limits))
        assert [sorted(tuple(map(int, demand[k])) for k in rows) for rows in bins] == plain_place(demand, limits)
        assert all((demand[rows].sum(axis=0) <= limits).all() for rows in bins)


def test_loss_limit_binds(spark):
    """Half of each document is prompt; sequences take no more than 300 loss tokens though 1024 tokens fit."""
    docs = spark.createDataFrame([(k, "word " * (40 + k % 700), 20 + k % 350) for k in range(300)], "doc_id long, text string, prompt_tokens long")
    cut = P.pieces(docs, max_loss=300).cache()
    packed = P.pack(cut, max_loss=300)
    joined = packed.join(cut.select("doc_id", "start", "loss_tokens"), ["doc_id", "start"])
    sums = joined.groupBy("sequence_id").agg({"loss_tokens": "sum", "length": "sum"}).collect()
    assert max(r["sum(loss_tokens)"] for r in sums) > 290 and all(r["sum(loss_tokens)"] <= 300 and r["sum(length)"] <= 1024 for r in sums)
    whole = cut.groupBy("doc_id", "doc_tokens").agg({"length": "sum", "loss_tokens": "sum"}).collect()
    asked = {k: 20 + k % 350 for k in range(300)}
    assert all(r["sum(length)"] == r["doc_tokens"] and r["sum(loss_tokens)"] == r["doc_tokens"] - 1 - asked[r["doc_id"]] for r in whole)


def test_ids_equal_the_tokenizers_file():
    """Every text of the larger table gives the ids of the file that the contract names."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    files = P.tokenizer_files()
    encode, exact = P._encoder(*files), Tokenizer.from_file(files[0])
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()]
    for text, found in zip(texts, exact.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert encode(text) == found.ids
