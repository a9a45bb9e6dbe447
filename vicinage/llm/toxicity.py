"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings, hashed to a fixed number of slots. Besides a weight for each slot the machine
learns a short vector, and the dot product of two slots' vectors scores the pair: an insult together with a mention
of a group counts more than the sum of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vicinage.llm.common import documents
from vicinage.llm.kernel import U, Words, blocks, distinct

SLOTS = 1 << 16
RANK = 4
#: Steps of the fit, at least.
STEPS = 150
#: Bound on the labelled documents that the machine is fitted on, chosen by a hash of the id.
TRAINING_ROWS = 16_000


def terms(texts: list[bytes], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text of every distinct term; words of letters and their first six bytes."""
    words = Words(texts, letters=True, prefix=6)
    long = words.length > 6
    hashed = np.concatenate([words.hash, words.prefix[long]]) & U(slots - 1)
    return distinct(hashed, np.concatenate([words.of, words.of[long]]))


def _ratio(both: np.ndarray, seen: np.ndarray, marked: np.ndarray | float, n: np.ndarray | float) -> np.ndarray:
    """Likelihood-ratio statistic of a term in ``seen`` of ``n`` texts, ``both`` of them among the ``marked`` ones."""
    part = lambda count, total, own: count * np.log(np.maximum(count, 1e-9) / np.maximum(total * own / np.maximum(n, 1), 1e-9))
    return 2 * (part(both, seen, marked) + part(seen - both, seen, n - marked) + part(marked - both, n - seen, marked) + part(n - marked - seen + both, n - seen, n - marked))


def telling(slot: np.ndarray, of: np.ndarray, labels: np.ndarray, slots: int, least: float = 12.0) -> np.ndarray:
    """Slots of three texts or more whose likelihood-ratio statistic against the label is at least ``least``."""
    seen, with_label = np.bincount(slot, minlength=slots), np.bincount(slot, labels[of], slots)
    return (seen >= 3) & (_ratio(with_label, seen, labels.sum(), len(labels)) >= least)


def interacting(slot: np.ndarray, of: np.ndarray, labels: np.ndarray, slots: int, least: float = 12.0) -> np.ndarray:
    """Slots of pairs that tell the label together, whatever each tells alone.

    Of a pair, either term must tell the label among the texts that have the other one: a common word beside a telling
    one doesn't. The statistic grows with the number of pairs that are tried, so that chance alone admits none. Slots
    whose texts are too few, or too much alike in label, to reach it with any other slot are left out beforehand.
    """
    seen, with_label = np.bincount(slot, minlength=slots), np.bincount(slot, labels[of], slots)
    most = _ratio(with_label, with_label, with_label, seen)  # with a slot that goes with the label in all texts
    tried = int(((seen >= 3) & (most >= least)).sum())
    least = max(least, 2 * np.log(max(tried * (tried - 1) / 2, 1)))
    own = np.flatnonzero((seen >= 3) & (most >= least))
    place = np.full(slots, -1)
    place[own] = np.arange(len(own))
    keep = place[slot] >= 0
    term, text = place[slot[keep]], of[keep]  # by text
    begin = np.searchsorted(text, np.arange(len(labels) + 1))
    order = np.argsort(term, kind="stable")
    edge = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(own)))])
    n, marked, found = seen[own].astype(float), with_label[own], np.zeros(len(own), bool)
    hit, term = labels[text[order]] > 0, term.astype(np.int32)

    def beside(at: np.ndarray, k: int) -> np.ndarray:
        """Texts, of those with slot k at these places, that have each slot above k."""
        sizes = begin[text[at] + 1] - at - 1
        rest = np.repeat(at + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.bincount(term[rest], minlength=len(own))[k + 1 :].astype(float)

    for k in range(len(own)):
        at, has = order[edge[k] : edge[k + 1]], hit[edge[k] : edge[k + 1]]
        a = beside(at[has], k)
        together, share = a + beside(at[~has], k), marked[k] / n[k]
        gap = a - together * share
        # Twice Pearson's statistic is a bound of the likelihood ratio's, and fast.
        other = np.flatnonzero(gap * gap * (2 * n[k]) >= (least * share * (1 - share)) * together * (n[k] - together) + 1e-9)
        together, a, other = together[other], a[other], other + k + 1
        pair = (_ratio(a, together, marked[k], n[k]) >= least) & (_ratio(a, together, marked[other], n[other]) >= least)
        found[other[pair]] = True
        found[k] |= pair.any()
    out = np.zeros(slots, bool)
    out[own[found]] = True
    return out


class Machine:
    """score(x) = bias + w.x + sum over pairs of <v_i, v_j> x_i x_j, with x_i = 1 for a term that has a say."""

    def __init__(self, slots: int = SLOTS, rank: int = RANK, seed: int = 5):
        self.bias = np.zeros(1)
        self.w = np.zeros(slots)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (slots, rank))

    def margin(self, slot: np.ndarray, of: np.ndarray, n: int) -> tuple:
        v = self.v[slot]
        sums = np.stack([np.bincount(of, v[:, k], n) for k in range(v.shape[1])], axis=1)
        squares = np.bincount(of, (v * v).sum(axis=1), n)
        return self.bias[0] + np.bincount(of, self.w[slot], n) + 0.5 * ((sums * sums).sum(axis=1) - squares), v, sums

    def fit(self, slot: np.ndarray, of: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.1, decay: float = 1e-3, seed: int = 5, least: float = 12.0) -> Machine:
        """Adaptive gradient descent on the logistic loss. Only slots that go with a label, alone or in a pair, have a say (see :func:`telling` and :func:`interacting`)."""
        n = len(labels)
        told = telling(slot, of, labels, len(self.w), least) | interacting(slot, of, labels, len(self.w), least)
        self.v[~told] = 0
        keep = told[slot]
        slot, of = slot[keep], of[keep]
        begin = np.searchsorted(of, np.arange(n + 1))
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if n else 1e-3
        self.bias[0] = np.log(share / (1 - share))
        epochs = max(epochs, -(-STEPS * batch // max(n, 1))) if n > batch else 100
        order, gone = np.random.default_rng(seed), [np.full_like(a, 1e-6) for a in (self.bias, self.w, self.v)]
        for _ in range(epochs):
            mixed_up = order.permutation(n)
            for k in range(0, n, batch):
                rows = mixed_up[k : k + batch]
                sizes = begin[rows + 1] - begin[rows]
                at = np.repeat(begin[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                own, inside = slot[at], np.repeat(np.arange(len(rows)), sizes)
                margin, v, sums = self.margin(own, inside, len(rows))
                error = (1 / (1 + np.exp(-margin)) - labels[rows]) / len(rows) * 64
                used, where = np.unique(own, return_inverse=True)
                each = error[inside]
                steps = [np.array([error.sum()]), np.bincount(where, each, len(used)) + decay * self.w[used], np.stack([np.bincount(where, each * (sums[inside, r] - v[:, r]), len(used)) for r in range(v.shape[1])], axis=1) + decay * self.v[used]]
                for held, past, step, what in zip((self.bias, self.w, self.v), gone, steps, (slice(None), used, used), strict=True):
                    past[what] += step * step
                    held[what] -= rate * step / np.sqrt(past[what])
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        slot, of = terms(texts, len(self.w))
        return 1 / (1 + np.exp(-np.clip(self.margin(slot, of, len(texts))[0], -30, 30)))

    def dumped(self) -> tuple[bytes, bytes, float]:
        return self.w.astype("<f4").tobytes(), self.v.astype("<f4").tobytes(), float(self.bias[0])

    @classmethod
    def loaded(cls, w: bytes, v: bytes, bias: float) -> Machine:
        found = cls.__new__(cls)
        found.w = np.frombuffer(w, "<f4").astype(float)
        found.v = np.frombuffer(v, "<f4").astype(float).reshape(len(found.w), -1)
        found.bias = np.array([bias])
        return found


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """text and label (double) of at most ``rows`` labelled documents, those of the smallest hash of their id.

    Ids with several labels take the largest, ids with several texts the smallest; null labels and ids are left out.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``rows``
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def fit(sample: DataFrame) -> Machine:
    """Fit the machine on a bounded sample (text, label); its terms go to one task, the fitted weights to the driver.

    A sample without rows gives a machine that scores every text close to 0.
    """

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [b""] * batch.num_rows
            for begin, texts in blocks(batch.column(0).to_pylist()):
                slot, of = terms(texts)
                edges = np.searchsorted(of, np.arange(len(texts) + 1))
                for k in range(len(texts)):
                    own[begin + k] = slot[edges[k] : edges[k + 1]].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column(1).cast(pa.float64())], ["slots", "label"])

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["slots", "label"], kind="stable")  # the same order whatever the partitions
        each = [np.frombuffer(s, "<u4").astype(np.int64) for s in rows["slots"]]
        of = np.repeat(np.arange(len(each)), [len(e) for e in each])
        machine = Machine().fit(np.concatenate([*each, np.empty(0, np.int64)]), of, rows["label"].to_numpy(float))
        return pd.DataFrame([machine.dumped()], columns=["w", "v", "bias"])

    one = sample.mapInArrow(featured, "slots binary, label double").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fitted, "w binary, v binary, bias double").first()
    if one is not None:
        return Machine.loaded(bytes(one["w"]), bytes(one["v"]), one["bias"])
    machine = Machine()
    machine.v[:], machine.bias[0] = 0, np.log(1e-3)
    return machine


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``toxicity`` (0 to 1), which replaces one of that name. Null and empty texts get the machine's bias alone."""
    docs = docs.drop("toxicity")
    place = docs.columns.index(text_col)
    dumped = machine.dumped()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine.loaded(*dumped)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for begin, texts in blocks(batch.column(place).to_pylist()):
                out[begin : begin + len(texts)] = own.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "toxicity"])

    schema = StructType([*docs.schema.fields, StructField("toxicity", DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Machine:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    return fit(labelled_sample(docs, labels, "toxic"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, trained(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine doesn't hold to be toxic."""
    return score(docs, trained(spark, docs, sf_dir)).filter(F.col("toxicity") < 0.5).select(*docs.columns)
