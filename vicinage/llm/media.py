"""Media columns: payloads in content-defined chunks, deduplicated, read back and verified.

A text becomes a sound file of 8-bit samples. A rolling gear hash cuts the file where its content says so, so that
equal stretches of different files give equal chunks. Chunks are stored once each; a file is its ordered chunk list.
Reading back joins the lists with the store, puts each file together and checks it against its digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm.common import cut, documents
from vicinage.llm.kernel import series

UNIT = 64
RATE = 8000
HEADER = 44
#: Chunks have at least LEAST and at most MOST bytes; behind the least a cut comes once in MEAN bytes.
LEAST, MEAN, MOST = 2048, 8192, 65536
#: Bytes before a place that decide whether it is a cut.
REACH = 32


def wave(payload: bytes) -> bytes:
    """A mono sound file of 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(stored: bytes) -> bytes:
    """The samples of a file made by :func:`wave`."""
    size = struct.unpack_from("<I", stored, HEADER - 4)[0]
    return stored[HEADER : HEADER + size]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a file.

    The gear hash at a place is the sum of a random number of each byte, shifted by its distance; its 32 bits hold the
    last 32 bytes, so it is made for all places at once by doubling the reach.
    """
    if len(data) <= LEAST:
        return [len(data)]
    gear = (series(256, 31) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[np.frombuffer(data, np.uint8)]
    reach = 1
    while reach < REACH:
        gear[reach:] = gear[reach:] + (gear[:-reach] << np.uint32(reach))
        reach *= 2
    found = np.flatnonzero(gear < np.uint32((1 << 32) // MEAN)) + 1
    ends, at = [], 0
    while len(data) - at > LEAST:
        k = int(np.searchsorted(found, at + LEAST))
        end = min(int(found[k]) if k < len(found) else len(data), at + MOST, len(data))
        ends.append(end)
        at = end
    return ends if at == len(data) else [*ends, len(data)]


def feature(payload: bytes) -> str:
    """Mean, root mean square, zero crossings, peak and used values of the samples around their middle (128)."""
    wave_form = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((wave_form[1:] < 0) != (wave_form[:-1] < 0)).sum())
    used = int((np.bincount(wave_form + 128, minlength=256) > 0).sum())
    return f"mean={wave_form.mean():.4f};rms={np.sqrt((wave_form**2).mean()):.4f};crossings={crossings};peak={int(np.abs(wave_form).max())};values={used}"


RECIPE = "id {kind}, n_bytes long, media binary, digests array<binary>"
MEASURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def _parts(text: str | None) -> tuple[bytes, int, list[bytes]]:
    payload, size = payload_of(text)
    stored = wave(payload)
    ends = cuts(stored)
    return stored, size, [stored[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def recipes(docs: DataFrame) -> DataFrame:
    """id, n_bytes, media (digest of the file) and the digests of its chunks in order, of each row of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, lists = [], [], []
            for text in batch.column(1):
                stored, size, parts = _parts(text.as_py())
                sizes.append(size)
                names.append(hashlib.sha256(stored).digest())
                lists.append([hashlib.sha256(part).digest() for part in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["id", "n_bytes", "media", "digests"])

    return docs.select("id", "text").mapInArrow(run, RECIPE.format(kind=dict(docs.dtypes)["id"]))


def chunk_store(docs: DataFrame) -> DataFrame:
    """digest and compressed bytes of each distinct chunk of the files of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=9, write_checksum=False)
        for batch in batches:
            seen: dict[bytes, bytes] = {}  # of one batch: copies of a text mostly stand apart
            for text in batch.column(0):
                for part in _parts(text.as_py())[2]:
                    digest = hashlib.sha256(part).digest()
                    if digest not in seen:
                        seen[digest] = squeeze.compress(part)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], ["digest", "bytes"])

    return docs.select("text").mapInArrow(run, "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes"))


def _measured(name: bytes, stored: bytes) -> tuple:
    if hashlib.sha256(stored).digest() != name:
        raise ValueError(f"the chunks of {name.hex()} don't give that file")
    payload = samples(stored)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), feature(payload)


_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
_NAMES = [c.split()[0] for c in MEASURES.split(", ")]


def read_back(lists: DataFrame, store: DataFrame) -> DataFrame:
    """Files put together from their chunk lists (media, digests; one row a file) and the store, checked and measured.

    A file of one chunk is done where its chunk is; only those of several chunks are moved once more. A file whose
    bytes don't have the digest that names it ends the query with an error.
    """
    places = lists.select("media", F.size("digests").alias("n"), F.posexplode("digests").alias("place", "digest"))
    joined = places.join(store, "digest").select("media", "n", "place", "bytes")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            parts, found = batch.column(3).to_pylist(), []
            for k, (name, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found.append((None,) * 5 if n > 1 else _measured(name, expand.decompress(parts[k])))
                parts[k] = parts[k] if n > 1 else None
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(parts, pa.binary()), *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))], ["media", "place", "bytes", *_NAMES])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            found = []
            for name, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first = rows[0]
                if first["bytes"].is_valid:
                    found.append(_measured(name, b"".join(expand.decompress(row["bytes"].as_py()) for row in rows)))
                else:
                    found.append(tuple(first[c].as_py() for c in _NAMES))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))], ["media", *_NAMES])

    single = joined.mapInArrow(alone, f"media binary, place int, bytes binary, {MEASURES}")
    whole = single.groupBy("media").agg(F.sort_array(F.collect_list(F.struct("place", "bytes", *_NAMES))).alias("rows"))  # of one file
    return whole.mapInArrow(together, f"media binary, {MEASURES}")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null texts are empty; an empty payload is padded to 64 zero bytes. Equal texts are one file, which is put together
    and measured once; repeated rows get its values each. Empty input: no rows. Other columns don't matter.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    listed = cut(recipes(plain))
    lists = listed.groupBy("media").agg(F.first("digests").alias("digests"))
    measured = read_back(lists, chunk_store(plain))
    return listed.select("id", "n_bytes", "media").join(measured, "media").select("id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
