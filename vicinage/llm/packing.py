"""Packing documents into fixed-length training sequences by vector bin packing.

A sequence has three limits: tokens, segments and loss-bearing tokens; where documents say how many of their tokens are
a prompt, these bear no loss. Documents longer than a sequence are cut into full pieces and a rest; rests are placed by the dot-product heuristic: an open sequence takes the piece that fits and
whose demand, as a vector of shares of the limits, has the largest dot product with what the sequence has left.
Pieces are dealt at random over groups of bounded size, each packed by one task.
"""

from __future__ import annotations

import array
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm.common import cut, documents

#: Pieces, about, that one group of the packing holds.
GROUP = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def _encoder(vocabulary: str, ranks: str):
    """text -> list of ids, as the tokenizers file gives them.

    The same vocabulary as ranks encodes several times faster; the few texts that hold the string of a special token
    go to the tokenizers file itself, which knows them.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    exact = Tokenizer.from_file(vocabulary)
    special = [t["content"] for t in json.loads(exact.to_str()).get("added_tokens", [])]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return exact.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def ends_of(n: int, prompt: int, max_tokens: int, max_loss: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, loss tokens) of the pieces of n ids: none over either limit. The first ``prompt`` ids and the last one bear no loss."""
    start = 0
    while start < n:
        free = max(prompt - start, 0)  # ids of the prompt that are left
        end = min(n, start + max_tokens, start + free + max_loss)
        if end == n - 1 and end - start < max_tokens:
            end = n  # the separator bears none
        yield start, end, max(end - max(start, prompt), 0) - (end == n and n > prompt)
        start = end


def pieces(docs: DataFrame, files: tuple[str, str] | None = None, max_tokens: int = 1024, separator: int = 0, with_ids: bool = False, max_loss: int = 1024) -> DataFrame:
    """Cut each document's ids, with the separator behind them, into pieces of ``max_tokens`` or ``max_loss`` loss tokens and a rest.

    ``docs`` has doc_id (long) and text, and may have prompt_tokens (long): so many ids at the beginning, as an
    instruction's, bear no loss (null: none). A null text is empty and gives the separator alone. The separator bears
    no loss. Repeated rows give repeated pieces; empty input gives none. ``with_ids`` adds the ids of each piece.
    """
    prompt = F.coalesce(F.col("prompt_tokens").cast("long"), F.lit(0)) if "prompt_tokens" in docs.columns else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*(files or tokenizer_files()))
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = array.array("I", encode(text.as_py() or "") if text.is_valid else [])
                ids.append(separator)
                raw = memoryview(ids).cast("B")
                for start, end, loss in ends_of(len(ids), asked, max_tokens, max_loss):
                    row = (doc_id, start, end - start, zlib.crc32(raw[4 * start : 4 * end]), len(ids), loss, ids[start:end].tolist() if with_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())]
            names = [*(c.split()[0] for c in PIECES.split(", ")), "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(out, kinds, strict=True))[: 6 + with_ids]], names[: 6 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), F.col("text"), prompt.alias("prompt")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def place(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Bins of the rows of ``demand`` (n, dimensions), none over ``limits``: the bin of each row, and the rows of each bin.

    Equal demands are one class with a count, so a step looks at the distinct demands only.
    """
    if (demand > limits).any():
        raise ValueError("a piece is over the limits by itself")
    kinds, which = np.unique(demand, axis=0, return_inverse=True)
    members = [[] for _ in kinds]
    for row, kind in enumerate(which.reshape(-1)):
        members[kind].append(row)
    left = np.array([len(m) for m in members])
    shares = kinds / limits
    bins: list[list[int]] = []
    of = np.empty(len(demand), np.int64)
    while left.any():
        room, own = limits.astype(float).copy(), []
        while True:
            fits = (left > 0) & (kinds <= room).all(axis=1)
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, shares @ (room / limits), -1.0)))
            row = members[best].pop()
            left[best] -= 1
            room -= kinds[best]
            of[row] = len(bins)
            own.append(row)
        bins.append(own)
    return of, bins


def pack(cut_pieces: DataFrame, max_tokens: int = 1024, max_segments: int = 128, max_loss: int = 1024) -> DataFrame:
    """Place the pieces of :func:`pieces`: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``cut_pieces`` must be materialised: pieces are dealt over the groups by their place in it, so that repeated
    documents spread as well as others. Each group leaves about one sequence short of full. Null ids stay null. Empty
    input: no rows.
    """
    count = cut_pieces.count()
    groups = max(1, -(-count // GROUP))
    limits = np.array([max_tokens, max_segments, max_loss])
    names = [c.split()[0] for c in PLACED.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start"], kind="stable").reset_index(drop=True)
        demand = np.stack([group["length"].to_numpy(), np.ones(len(group), np.int64), group["loss_tokens"].to_numpy()], axis=1)
        of, bins = place(demand, limits)
        length, offset = group["length"].to_numpy(), np.zeros(len(group), np.int64)
        for rows in bins:
            offset[rows] = np.cumsum(length[rows]) - length[rows]
        group["sequence_id"] = (int(group["_group"].iloc[0]) << 24) | of
        group["offset"] = offset
        return group[[*names, "_named"]]

    # A null among a group's longs would make them doubles, which can't tell large ids apart.
    named = {"_named": F.col("doc_id").isNotNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))}
    dealt = cut_pieces.withColumns({"_group": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)), **named})
    found = dealt.groupBy("_group").applyInPandas(run, PLACED + ", _named boolean")
    return found.select(F.when(F.col("_named"), F.col("doc_id")).alias("doc_id"), *names[1:])


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(pieces(documents(spark, sf_dir))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(cut(pieces(docs)))
