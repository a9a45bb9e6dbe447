"""Vector codes by Elkan's Lloyd iterations over codebooks of every part position.

A vector's integer components are cut into parts; each part is coded by the nearest entry of its position's codebook.
The first assignment measures all distances and keeps, of each part, an upper bound of the distance to its entry and a
lower bound of the distance to every entry. They are stored with the vectors. When entries move, the bounds are shifted
by as much, and an entry is measured again only where neither its lower bound nor the triangle inequality over the
distances between entries rules it out. Bounds are rounded outwards and an entry is ruled out only if it is strictly
farther, so that ties are always settled by integer distances, for the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm.common import cut, few

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: A double's square root, made smaller and larger than the true one by this share.
SLACK = 1e-12


def integers(rows: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """vec_id, label, v (integer components) of the usable rows, and the number of components of a part.

    The most frequent length (of equally frequent ones the longest) is that of the table; vectors of other lengths are
    left out, as those that are null or hold nulls, NaN or infinities. Zeros are added up to a multiple of ``parts``.
    Components saturate where distances of vectors would not fit a long.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("x").isNotNull() & finite)
    common = rows.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    length = common["n"] if common else 0
    width = -(-length // parts)
    most = float(int((2**62 / max(1, width * parts)) ** 0.5) // 2)
    scaled = F.transform("x", lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(most)), F.lit(-most)).cast("long"))
    padding = F.array_repeat(F.lit(0).cast("long"), width * parts - length)
    return rows.filter(F.size("x") == length).select("vec_id", "label", F.concat(scaled, padding).alias("v")), width


def _bytes(values: np.ndarray) -> pa.Array:
    """One binary value a row."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    edges = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(raw.tobytes())])


def _rows(column: pa.Array, dtype: type, *shape: int) -> np.ndarray:
    """What _bytes() packed."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    return raw.view(dtype).reshape(len(column), *shape).copy()


def _vectors(column: pa.Array, parts: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), parts, width)


def _below(squares: np.ndarray) -> np.ndarray:
    return np.floor(np.sqrt(squares.astype(np.float64)) * (1 - SLACK)).astype(np.int64)


def _above(squares: np.ndarray) -> np.ndarray:
    return np.ceil(np.sqrt(squares.astype(np.float64)) * (1 + SLACK)).astype(np.int64)


class Codebooks:
    """Entries (part, entry, component) and what is known of them: units of lower bounds, movement, distances.

    Lower bounds are stored as one byte each, in units of a hundredth of the widest distance between a part's first
    entries; the units stay the same in all rounds.
    """

    def __init__(self, entries: np.ndarray, before: Codebooks | None = None):
        self.entries = entries
        between = ((entries[:, :, None] - entries[:, None]) ** 2).sum(3)
        self.between = _below(between)
        self.between[:, np.arange(entries.shape[1]), np.arange(entries.shape[1])] = np.iinfo(np.int64).max
        self.unit = before.unit if before else np.maximum(1, _above(between).max((1, 2), initial=0) // 100)
        moved = _above(((entries - before.entries) ** 2).sum(2)) if before else np.zeros(entries.shape[:2], np.int64)
        #: What an entry's movement takes off its lower bounds and adds to the upper bounds of its own parts.
        self.falls, self.rises = -(-moved // self.unit[:, None]), moved

    def stored(self, distances: np.ndarray, part: int) -> np.ndarray:
        return np.minimum(distances // self.unit[part], 255).astype(np.uint8)


def _first(v: np.ndarray, books: Codebooks) -> tuple:
    """code, upper and lower bounds of every part, by all distances."""
    n, parts, _ = v.shape
    code, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64), np.zeros((n, parts, books.entries.shape[1]), np.uint8)
    for p in range(parts):
        squares = np.stack([((v[:, p] - entry) ** 2).sum(1) for entry in books.entries[p]], 1)
        code[:, p] = squares.argmin(1)  # the lowest of equal ones
        upper[:, p] = _above(squares.min(1))
        lower[:, p] = books.stored(_below(squares), p)
    return code, upper, lower


def _again(v: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Codebooks) -> int:
    """Bring code and bounds, in place, to entries that moved; the number of distances that were measured."""
    measured = 0
    for p in range(v.shape[1]):
        entries, own = books.entries[p], code[:, p].astype(np.int64)
        upper[:, p] += books.rises[p][own]
        bounds = np.maximum(lower[:, p].astype(np.int64) - books.falls[p], 0)
        open_ = np.flatnonzero(books.between[p].min(1)[own] <= 2 * upper[:, p])
        if len(open_):
            mine, at = own[open_], v[open_, p]
            best = ((at - entries[mine]) ** 2).sum(1)
            ceiling = _above(best)
            bounds[open_, mine] = _below(best) // books.unit[p]
            near = (bounds[open_] * books.unit[p] <= ceiling[:, None]) & (books.between[p][mine] <= 2 * ceiling[:, None])
            row, entry = np.nonzero(near)  # the own entry is infinitely far from itself, so it isn't among them
            squares = ((at[row] - entries[entry]) ** 2).sum(1)
            bounds[open_[row], entry] = _below(squares) // books.unit[p]
            measured += len(open_) + len(row)
            row, entry, squares = np.append(row, np.arange(len(open_))), np.append(entry, mine), np.append(squares, best)
            order = np.lexsort((entry, squares, row))
            first = order[np.searchsorted(row[order], np.arange(len(open_)))]
            code[open_, p], upper[open_, p] = entry[first], _above(squares[first])
        lower[:, p] = np.minimum(bounds, 255).astype(np.uint8)
    return measured


STATE = "code binary, upper binary, lower binary, measured long"


def assigned(rows: DataFrame, books: Codebooks, width: int, bounded: bool) -> DataFrame:
    """vec_id, label, v, code, upper, lower and the number of distances measured; bounded: the rows have bounds already."""
    parts, entries = books.entries.shape[:2]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, v = batch.num_rows, _vectors(batch.column(2), parts, width)
            if not n:
                continue
            if bounded:
                code, upper, lower = _rows(batch.column(3), np.uint8, parts), _rows(batch.column(4), np.int64, parts), _rows(batch.column(5), np.uint8, parts, entries)
                measured = _again(v, code, upper, lower, books)
            else:
                (code, upper, lower), measured = _first(v, books), n * parts * entries
            share = np.full(n, measured // n)
            share[: measured % n] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _bytes(code), _bytes(upper), _bytes(lower), pa.array(share)], [*batch.schema.names[:3], "code", "upper", "lower", "measured"])

    return rows.mapInArrow(run, f"vec_id long, label {kinds['label']}, v array<long>, {STATE}")


def moved(state: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """The codebooks after each entry went to the floored mean of its parts; unused entries stay.

    A task adds up its rows, so what is shuffled and brought to the driver is one row an entry.
    """
    parts, entries = books.entries.shape[:2]
    sums = [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            slot = (_rows(batch.column(1), np.uint8, parts) + np.arange(parts) * entries).reshape(-1)
            np.add.at(total, slot, _vectors(batch.column(0), parts, width).reshape(-1, width))
            count += np.bincount(slot, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *[pa.array(total[used, k]) for k in range(width)]], ["slot", "n", *sums])

    found = state.select("v", "code").mapInArrow(run, "slot long, n long, " + ", ".join(f"{s} long" for s in sums))
    found = found.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in sums])
    after = books.entries.copy()
    for row in found.collect():  # PARTS * ENTRIES rows at most
        after[divmod(row["slot"], entries)] = [int(row[s]) // row["n"] for s in sums]
    return Codebooks(after, books)


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code, error and measured of each usable row (see integers()), and the codebooks.

    The codebooks start as the parts of the vectors of the smallest ids (of equal ids in order of their vectors; rows
    without id are coded, but start none; where there are fewer than ``entries``, so many) and move ``rounds`` times.
    No such row at all: no rows and no codebook. Nulls in label and repeated rows don't matter.
    """
    usable, width = integers(rows, id_col, vector_col, label_col, parts)
    start = usable.filter(F.col("vec_id").isNotNull()).orderBy("vec_id", "v").select("v").limit(entries).collect()
    if not start or not width:
        empty = usable.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("measured"))
        return empty, Codebooks(np.zeros((parts, 0, 0), np.int64))
    books = Codebooks(np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy())
    state = cut(assigned(usable, books, width, False))
    for _ in range(rounds):
        books = moved(state, books, width)
        state = cut(assigned(state.drop("measured"), books, width, True))
    kind, entries_now = state.schema["label"].dataType.simpleString(), books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _rows(batch.column(3), np.uint8, parts)
            squares = ((_vectors(batch.column(2), parts, width) - entries_now[np.arange(parts), code]) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(squares), batch.column(6)], ["vec_id", "label", "code", "error", "measured"])

    return state.mapInArrow(run, f"vec_id long, label {kind}, code string, error long, measured long"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = cut(coded)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.entries.reshape(-1).tolist())).encode()).hexdigest()
    return coded.join(few(cut(sums)), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql_round(k: int, final: bool = False) -> str:
    near = f"""a{k} AS (
  SELECT x.row, x.part, arg_min(c.entry, (x.d0 - c.c0) ** 2 + (x.d1 - c.c1) ** 2 + (x.d2 - c.c2) ** 2 + (x.d3 - c.c3) ** 2 + c.entry / 1024) AS entry,
         min((x.d0 - c.c0) ** 2 + (x.d1 - c.c1) ** 2 + (x.d2 - c.c2) ** 2 + (x.d3 - c.c3) ** 2) AS square
  FROM cut x JOIN c{k} c ON x.part = c.part GROUP BY ALL)"""
    means = ", ".join(f"coalesce(CAST(floor(sum(x.d{i}) / count(x.row)) AS BIGINT), any_value(c.c{i})) AS c{i}" for i in range(4))
    after = f"""c{k + 1} AS (
  SELECT c.part, c.entry, {means} FROM c{k} c LEFT JOIN (SELECT * FROM a{k} JOIN cut USING (row, part)) x ON x.part = c.part AND x.entry = c.entry GROUP BY c.part, c.entry)"""
    return near if final else f"{near},\n{after}"


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v, row_number() OVER (ORDER BY vec_id, embedding) AS row
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
cut AS (SELECT row, part, v[4 * part + 1] AS d0, v[4 * part + 2] AS d1, v[4 * part + 3] AS d2, v[4 * part + 4] AS d3 FROM kept, range({PARTS}) t(part)),
c0 AS (SELECT part, row - 1 AS entry, d0 AS c0, d1 AS c1, d2 AS c2, d3 AS c3 FROM cut WHERE row <= {ENTRIES}),
{_sql_round(0)},
{_sql_round(1)},
{_sql_round(2, True)},
coded AS (SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(square) AS BIGINT) AS error FROM a2 GROUP BY row),
digest AS (SELECT sha256(string_agg(c0 || ',' || c1 || ',' || c2 || ',' || c3, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), digest
"""
