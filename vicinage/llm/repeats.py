"""Repeated passages by sparse suffix arrays.

A corpus position starts a suffix. Only suffixes at content-selected positions are kept: in every run of SELECT
positions the one whose word run hashes lowest, so that two copies of a passage keep the same ones. Suffixes are sorted
by (digest of) their first words, and neighbours in that order are compared: a suffix whose beginning equals its
neighbour's is a match. A match is extended left over the positions up to the suffix kept before it and right to the
full length: every window of the passage length that has this suffix as its first kept one, so many words before it
and the rest behind, gets a digest of its own words, these are sorted, and a window that equals its neighbour repeats
it. Hits are joined into passages.

Sorting is by range over (digest, document, position), so that occurrences of one frequent passage are dealt over many
tasks; where a passage's first occurrence lies before a task's range, it comes from a table with one row a task.
Digests of windows and of whole texts have 128 bits, and decide; those of suffixes, which have 64, only choose what is
compared. Equal texts are one document here: of later copies all is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinage.llm.common import cut, documents, few, n_words
from vicinage.llm.kernel import U, Words, blocks, mixed, series

LENGTH = 50
SELECT = 24
#: Words of the runs that select suffixes.
GRAM = 4


def _window_hash(words: Words, width: int, salt: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on; of no use where they leave the text. Prefix sums with inverse powers, then spread."""
    n = len(words.hash)
    if n < width:
        return np.zeros(n, U)
    base = int(series(1, salt)[0]) | 1
    inverse = pow(base, -1, 1 << 64)
    power, back = np.full(n, base, U), np.full(n, inverse, U)
    power[0] = back[0] = 1
    power, back = np.cumprod(power, dtype=U), np.cumprod(back, dtype=U)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mixed(words.hash ^ U(salt)) * power, dtype=U)])
    out = np.zeros(n, U)
    out[: n - width + 1] = (total[width:] - total[:-width]) * back[: n - width + 1]
    return mixed(out)


def selected(words: Words, length: int, select: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` words in one text, by their first word, and the kept suffix that each one has."""
    n = len(words.hash)
    if n < max(length, select + GRAM - 1):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = _window_hash(words, GRAM, 21)[: n - GRAM + 1]
    last = n - max(length, select + GRAM - 1)
    end = np.cumsum(words.count)[words.of]
    window = np.flatnonzero(np.arange(last + 1) + length <= end[: last + 1])
    # Minima of runs by doubling: the lowest hash and, among equal ones, the first place.
    least, place, width = order, np.arange(len(order)), 1
    while width < select:
        step = min(width, select - width)
        other, there = least[step:], place[step:]
        m = len(other)
        later = other < least[:m]
        least, place = np.where(later, other, least[:m]), np.where(later, there, place[:m])
        width += step
    return window, place[window]


def _suffixes(docs: DataFrame, length: int, select: int) -> DataFrame:
    """key (digest of a kept suffix's first words), place, copy (digest of the text), doc."""
    reach = length - select + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, copy = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for begin, texts in blocks(batch.column(2).to_pylist()):
                words = Words(texts, fold=False)
                kept = np.unique(selected(words, length, select)[1])
                if not len(kept):
                    continue
                of = words.of[kept]
                place = kept - (np.cumsum(words.count) - words.count)[of]
                arrays = _window_hash(words, reach, 22)[kept].view(np.int64), place, copy[begin + of], doc[begin + of]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["key", "place", "copy", "doc"])

    return docs.select("doc", "copy", "text").mapInArrow(run, "key long, place long, copy long, doc long")


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (key, place, copy, doc) the first of each text and place whose neighbour has its key.

    The first and last one of a task have a neighbour elsewhere and stay; a match found in vain is no harm.
    """
    held, first = None, True
    for batch in batches:
        own = _arrays(batch)
        if held is not None:
            own = [np.concatenate([h, a]) for h, a in zip(held, own, strict=True)]
        if not len(own[0]):
            continue
        key, place, copy, _ = own
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (copy[1:] != copy[:-1])
        own = [a[fresh] for a in own]
        equal = own[0][1:] == own[0][:-1]
        match = np.zeros(len(own[0]), bool)
        match[1:] |= equal
        match[:-1] |= equal
        match[0] |= first
        if held is not None:
            # The held row was not given out yet; whether the row before it has its key was noted with it.
            match[0] |= before
        before, first = bool(match[-1]), len(own[0]) == 1 and first
        held = [a[-1:] for a in own]
        yield pa.RecordBatch.from_arrays([pa.array(a[:-1][match[:-1]], pa.int64()) for a in own], ["key", "place", "copy", "doc"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in held], ["key", "place", "copy", "doc"])


def _windows(docs: DataFrame, length: int, select: int) -> DataFrame:
    """low, high (128-bit digest), doc, start of every window of ``docs`` (doc, text, places) whose kept suffix is at one of the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, places = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            for begin, texts in blocks(batch.column(1).to_pylist()):
                words = Words(texts, fold=False)
                window, suffix = selected(words, length, select)
                if not len(window):
                    continue
                before = np.cumsum(words.count) - words.count
                wanted = np.zeros(len(words.hash), bool)
                for k in range(len(texts)):
                    wanted[before[k] + np.array(places[begin + k], np.int64)] = True
                window = window[wanted[suffix]]
                of = words.of[window]
                arrays = *(_window_hash(words, length, salt)[window].view(np.int64) for salt in (23, 24)), doc[begin + of], window - before[of]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["low", "high", "doc", "start"])

    return docs.select("doc", "text", "places").mapInArrow(run, "low long, high long, doc long, start long")


COMPARED = "kind int, task int, doc long, start long, first_doc long, first_start long, begin_low long, begin_high long, end_low long, end_high long"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (low, high, doc, start) those that repeat an earlier one, with the first one of their digest.

    kind 0: a row whose first one is in this task. kind 1: a row of the task's first digest, which may have begun
    before; its first row, too. kind 2: one row a task with its first and last digest and the first row of the last one.
    """
    from pyspark import TaskContext

    task, held, begun, only = TaskContext.get().partitionId(), None, None, True

    def rows(kind: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(kind, pa.int32()), pa.array(np.full(len(kind), task), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in COMPARED.split(", ")])

    for batch in batches:
        own = _arrays(batch)
        if not len(own[0]):
            continue
        fresh = held is None
        low, high, doc, start = own if fresh else [np.concatenate([h, a]) for h, a in zip(held, own, strict=True)]
        begun = (low[0], high[0]) if fresh else begun
        begin = np.ones(len(low), bool)
        begin[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        at = np.maximum.accumulate(np.where(begin, np.arange(len(low)), 0))
        head = (low == begun[0]) & (high == begun[1]) & only
        only = bool(head[-1])
        given = ~begin | head
        given[0] &= fresh  # the held first row of the last digest was dealt with before
        none = np.zeros(int(given.sum()), np.int64)
        yield rows(np.where(head, 1, 0)[given], doc[given], start[given], doc[at][given], start[at][given], none, none, none, none)
        held = [a[at[-1] : at[-1] + 1] for a in (low, high, doc, start)]
    if held is not None:
        yield rows(np.array([2]), held[2], held[3], held[2], held[3], np.array([begun[0]]), np.array([begun[1]]), held[0], held[1])


def _first_of_all(compared: DataFrame) -> DataFrame:
    """doc, start, first_doc: the windows that repeat an earlier one; heads of tasks get the first row of a task before."""
    spark = compared.sparkSession
    ends = compared.filter(F.col("kind") == 2).select("task", F.struct("begin_low", "begin_high").alias("low"), F.struct("end_low", "end_high").alias("high"), "first_doc", "first_start").orderBy("task").collect()  # one row a task
    carried, known = None, []
    for end in ends:
        low, high = tuple(end["low"]), tuple(end["high"])
        if carried is not None and carried[0] == low:
            known.append((end["task"], carried[1], carried[2]))
            if high == low:
                continue
        carried = (high, end["first_doc"], end["first_start"])
    table = spark.createDataFrame(known, "task int, carried_doc long, carried_start long")
    found = compared.filter(F.col("kind") < 2).join(F.broadcast(table), "task", "left")  # at most one row a task
    from_before = (F.col("kind") == 1) & F.col("carried_doc").isNotNull()
    found = found.withColumn("first_doc", F.when(from_before, F.col("carried_doc")).otherwise(F.col("first_doc"))).withColumn("first_start", F.when(from_before, F.col("carried_start")).otherwise(F.col("first_start")))
    return found.filter((F.col("doc") != F.col("first_doc")) | (F.col("start") != F.col("first_start"))).select("doc", "start", "first_doc")


def _sorted(df: DataFrame, schema: str, compare: Callable, *order: str) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, schema)


def repeated_passages(docs: DataFrame, length: int = LENGTH, select: int = SELECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of ``length`` words or more that the corpus has before: doc_id, start_word, n_words, earlier_doc_id.

    Every window of ``length`` words that equals one of a smaller document id, or an earlier one of the same document,
    is repeated; a passage is a longest run of words that overlapping or adjacent repeated windows cover. Its
    earlier_doc_id holds its first window first (for a later copy of a whole text: the first copy).
    Words are split at spaces and the characters 9 to 13; case counts. Null and shorter texts have none. Rows
    without an id are left out. Of rows with one id and one text, one counts; one id with several texts is taken as
    several documents of that id. No rows in, none out; other columns don't matter.
    """
    plain = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("copy"), F.xxhash64(F.lit("copy"), F.col(text_col)).alias("copy_high"))
    matched = _sorted(_suffixes(plain, length, select), "key long, place long, copy long, doc long", _matched, "key", "place", "copy", "doc").select("doc", "copy", "place")
    places = matched.groupBy("doc", "copy").agg(F.collect_set("place").alias("places"))  # of one text
    found = plain.dropDuplicates(["doc", "copy", "copy_high"]).join(places, ["doc", "copy"])
    windows = _windows(found, length, select)
    compared = cut(_sorted(windows, COMPARED, _compared, "low", "high", "doc", "start"))
    repeated = _first_of_all(compared)
    order = Window.partitionBy("doc").orderBy("start")
    fresh = F.coalesce((F.col("start") > F.lag("start").over(order) + length).cast("int"), F.lit(0))
    islands = repeated.groupBy("doc", "start").agg(F.min("first_doc").alias("first_doc")).withColumn("fresh", fresh)
    islands = islands.withColumn("island", F.sum("fresh").over(order))
    passages = islands.groupBy("doc", "island").agg(F.min("start").alias("start_word"), (F.max("start") - F.min("start") + length).alias("n_words"), F.min_by("first_doc", "start").alias("earlier_doc_id"))
    passages = passages.select(F.col("doc").alias("doc_id"), "start_word", "n_words", "earlier_doc_id")
    # Later copies of a whole text; words are counted in the first one only.
    same = ["copy", "copy_high"]
    first = cut(plain.groupBy(*same).agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n"))
    sized = plain.join(few(first), [*same, "doc"]).groupBy(*same).agg(F.min("doc").alias("first_doc"), F.min(n_words(F.col("text"))).alias("n_words")).filter(F.col("n_words") >= length)
    copies = plain.drop("text").join(few(cut(sized)), same).filter(F.col("doc") > F.col("first_doc"))
    copies = copies.select(F.col("doc").alias("doc_id"), F.lit(0).cast("long").alias("start_word"), "n_words", F.col("first_doc").alias("earlier_doc_id")).distinct()
    return passages.join(copies.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(copies)


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of the passages and the separators behind them; a text that is left blank becomes empty."""
    spans = passages.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("_spans"))
    joined = docs.join(spans, F.col(id_col) == F.col("_doc"), "left").drop("_doc")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for k, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans and texts[k] is not None:
                    begins = [m.start() for m in word.finditer(texts[k])] + [len(texts[k])]
                    parts, at = [], 0
                    for span in sorted(spans, key=lambda s: s["start_word"]):
                        parts.append(texts[k][at : begins[min(span["start_word"], len(begins) - 1)]])
                        at = begins[min(span["start_word"] + span["n_words"], len(begins) - 1)]
                    left = "".join([*parts, texts[k][at:]])
                    texts[k] = left if left.strip(" \t\n\x0b\x0c\r") else ""
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that the corpus has before; a document that is all repeated becomes empty."""
    return without_passages(docs, repeated_passages(docs))
