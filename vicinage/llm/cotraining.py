"""Document quality by co-training of two views.

One classifier sees the text alone, one the document's metadata (source, language, length). Both are naive Bayes over
slots, so that a fit is a grouped count of slots and labels. They start from labelled documents; in each round both
score every unlabelled document, and each hands those that it is most sure of, with its label, to the other's counts.
Both are then calibrated on labelled documents that neither was fitted on, and combined with weights of 0 or more.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vicinage.llm.common import cut, documents
from vicinage.llm.kernel import U, Words, blocks, mixed, shingles
from vicinage.llm.toxicity import held_out

#: Bound on the labelled documents that are fitted on, by a hash of the id. Unlabelled ones take part without a bound.
LABELLED = 10_000
#: Rounds; the share of the unlabelled documents that a view hands over in one at most; the calibrated probability it needs.
ROUNDS, SHARE, SURE = 4, 0.1, 0.9
TEXT_FEATURES, META_SLOTS, BINS = 12, 1024, 12


def text_view(texts: list[bytes]) -> np.ndarray:
    """Numbers that describe texts (rows): length, word shape, symbols, capitals, digits, lines and repetition."""
    words = Words(texts, fold=False)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.maximum(np.array([len(t) for t in texts]), 1)
    count = np.maximum(words.count, 1)
    within = lambda mask: np.add.reduceat(mask.astype(np.int64), words.offsets[:-1])
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True
    last = data[words.start + words.length - 1] if len(words.start) else np.empty(0, np.uint8)
    odd_end = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128) | np.isin(last, list(b".,;:")))

    def different(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        key = np.unique(mixed(hashes + of.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)[1]
        return np.bincount(of[key], minlength=len(texts)) / np.maximum(np.bincount(of, minlength=len(texts)), 1)

    tri, tri_of = shingles(words, 3)
    lengths = np.bincount(words.of, words.length, len(texts)) / count
    columns = [
        np.log1p(words.count), lengths, np.sqrt(np.maximum(np.bincount(words.of, words.length**2.0, len(texts)) / count - lengths**2, 0)),
        within(symbols[data]) / sizes, within((data == 33) | (data == 63)) / sizes, within((data >= 65) & (data <= 90)) / sizes,
        within((data >= 48) & (data <= 57)) / sizes, within(data == 10) / sizes, np.bincount(words.of, odd_end, len(texts)) / count,
        different(words.hash, words.of), different(tri, tri_of), within(data >= 128) / sizes,
    ]
    return np.stack(columns, axis=1)


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Slots (rows of three) of source, language and the power of two of the length; nulls have slots of their own."""
    import zlib

    slot = lambda name, value: zlib.crc32(f"{name}={value}".encode("utf-8", "surrogatepass")) % META_SLOTS
    rows = [(slot("source", s), slot("lang", x), slot("size", None if n is None else max(int(n), 0).bit_length())) for s, x, n in zip(source, lang, n_chars, strict=True)]
    return np.array(rows, np.int64).reshape(-1, 3)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def bayes(counts: np.ndarray, features: int) -> np.ndarray:
    """Weight of each slot, and the prior behind them, from counts (2, slots) by label; each row has ``features`` slots."""
    smooth = counts + 1.0
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    rows = counts.sum(axis=1) / features + 1.0
    return np.append(logs[1] - logs[0], np.log(rows[1] / rows[0]))


def margins(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return weights[rows].sum(axis=1) + weights[-1] if len(rows) else np.empty(0)


class Model:
    """Bins of the text view, both views' weights, their calibrations and their combination.

    ``handed`` has the number of documents that each view gave to the other: (round, view, label, n).
    """

    def __init__(self, edges: np.ndarray):
        self.edges, self.weights, self.scales, self.joint, self.handed = edges, [], [], np.array([0.5, 0.5, 0.0]), []

    def binned(self, text: np.ndarray) -> np.ndarray:
        return np.stack([k * BINS + np.searchsorted(self.edges[k], text[:, k], "left") for k in range(TEXT_FEATURES)], axis=1) if len(text) else np.empty((0, TEXT_FEATURES), np.int64)

    def calibrate(self, found: np.ndarray, y: np.ndarray) -> None:
        """Calibrate on margins (rows, views) of labelled documents and fit their combination."""
        self.scales = [_line(found[:, k : k + 1], y) for k in (0, 1)]
        self.joint = _combined(self.calibrated(found), y)

    def calibrated(self, found: np.ndarray) -> np.ndarray:
        return np.stack([found[:, k] * self.scales[k][0] + self.scales[k][-1] for k in (0, 1)], axis=1)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = self.calibrated(np.stack([margins(self.weights[0], self.binned(text)), margins(self.weights[1], meta)], axis=1))
        p = lambda m: 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        return p(both[:, 0]), p(both[:, 1]), p(both @ self.joint[:-1] + self.joint[-1])


def _line(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights and intercept of a logistic regression by damped Newton steps; without rows, the mean of the inputs."""
    w = np.zeros(x.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        w[:-1] = 1 / x.shape[1]
        return w
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (p - y) + 0.1 * w)
    return w


def _combined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As :func:`_line`, with weights of 0 or more: views that would count against themselves are left out."""
    used = np.ones(x.shape[1], bool)
    while True:
        found = _line(x[:, used], y)
        if (found[:-1] >= 0).all() or used.sum() == 1:
            break
        used[np.flatnonzero(used)[np.argmin(found[:-1])]] = False
    out = np.zeros(x.shape[1] + 1)
    out[:-1][used], out[-1] = np.maximum(found[:-1], 0), found[-1]
    return out


VIEWS = "doc_id long, text array<double>, meta array<int>"
SLOTS = (TEXT_FEATURES * BINS, META_SLOTS)


def _views(docs: DataFrame, edges: np.ndarray | None = None) -> DataFrame:
    """doc_id and both views of docs: the text's numbers, or with ``edges`` their slots, and the slots of the metadata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
            text = np.concatenate([text_view(t) for _, t in blocks(own["text"])]) if batch.num_rows else np.empty((0, TEXT_FEATURES))
            meta = meta_view(own["source"], own["lang"], own["n_chars"])
            text = (text if edges is None else Model(edges).binned(text)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(text), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.int32()))], ["doc_id", "text", "meta"])

    return docs.select(F.col("doc_id").cast("long"), "text", "source", "lang", "n_chars").mapInArrow(run, VIEWS)


def _counts(rows: DataFrame, view: str, label: Column, slots: int) -> np.ndarray:
    """Rows with each slot of a view by label (2, slots); null labels don't count. One number a slot and label comes to the driver."""
    found = rows.select(label.alias("label"), F.explode(view).alias("slot")).filter(F.col("label").isNotNull()).groupBy("label", "slot").agg(F.count(F.lit(1)).alias("n"))
    out = np.zeros((2, slots))
    for row in found.collect():
        out[int(row["label"]), int(row["slot"])] = row["n"]
    return out


def _with_margins(rows: DataFrame, weights: list[np.ndarray]) -> DataFrame:
    """``rows`` (doc_id, y, apart, text, meta, given_0, given_1) with the margins m_0 and m_1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [margins(w, np.array(batch.column(k).to_pylist(), np.int64).reshape(batch.num_rows, -1)) for k, w in ((3, weights[0]), (4, weights[1]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=[*batch.schema.names, "m_0", "m_1"])

    rows = rows.select("doc_id", "y", "apart", "text", "meta", "given_0", "given_1")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("m_0", DoubleType()), StructField("m_1", DoubleType())]))


def _weights(rows: DataFrame) -> list[np.ndarray]:
    """Both views' weights: a view is fitted on labels and on what the other handed over, which counts as much as these at most."""
    labelled = F.when(F.col("y").isNotNull() & ~F.col("apart"), F.col("y"))
    out = []
    for k, (view, slots) in enumerate(zip(("text", "meta"), SLOTS, strict=True)):
        own, given = _counts(rows, view, labelled, slots), _counts(rows, view, F.col(f"given_{1 - k}"), slots)
        share = min(1.0, own.sum() / given.sum()) if given.sum() else 0.0
        out.append(bayes(own + share * given, TEXT_FEATURES if k == 0 else 3))
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """The fitted model; None without labels.

    Ids with several labels take the smallest, ids with several rows count by each of these; null ids and labels are
    left out. Bins are quantiles of the labelled sample. A fifth of that is set apart for the calibration. What a view
    hands over is bounded by quantiles of all free documents, and drawn from all of them in every round.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    mine = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    docs = docs.filter(F.col("doc_id").isNotNull())
    sample = _views(docs.join(F.broadcast(mine), "doc_id", "left_semi"))  # bounded
    quantiles = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    edges = sample.agg(*[F.percentile(F.col("text")[k], quantiles).alias(f"q{k}") for k in range(TEXT_FEATURES)]).first()
    if edges is None or edges[0] is None:
        return None
    model = Model(np.array([list(q) for q in edges]))
    every = labels.filter(F.col("quality").isNotNull()).select("doc_id").distinct()
    views = _views(docs, model.edges).join(F.broadcast(mine), "doc_id", "left").join(every.withColumn("told", F.lit(True)), "doc_id", "left")
    # Labelled documents beyond the sample, or held out, are no pool either.
    rows = views.filter(F.col("y").isNotNull() | F.col("told").isNull()).withColumn("apart", F.pmod(F.xxhash64(F.lit("apart"), "doc_id"), F.lit(5)) == 0)
    none = F.lit(None).cast("int")
    rows = cut(rows.select("doc_id", "y", "apart", F.transform("text", lambda x: x.cast("int")).alias("text"), "meta", none.alias("given_0"), none.alias("given_1")))
    for turn in range(ROUNDS + 1):
        model.weights = _weights(rows)
        scored_rows = _with_margins(rows, model.weights)
        apart = scored_rows.filter(F.col("y").isNotNull() & F.col("apart")).select("m_0", "m_1", "y").toPandas()  # a fifth of the sample
        found = apart[["m_0", "m_1"]].to_numpy().reshape(-1, 2)
        model.calibrate(found, apart["y"].to_numpy())
        if turn == ROUNDS:
            return model
        rows = cut(_handed(scored_rows, model))
        totals = rows.filter(F.col("y").isNull()).groupBy("given_0", "given_1").count().collect()
        for k in (0, 1):
            for label in (0, 1):
                model.handed.append((turn, k, label, sum(r["count"] for r in totals if r[f"given_{k}"] == label)))


def _handed(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with what each view is most sure of in given_0 and given_1; both choose from the same free documents."""
    free = [F.col("y").isNull() & F.col(f"given_{k}").isNull() for k in (0, 1)]
    ends = F.array(F.lit(SHARE / 2), F.lit(1 - SHARE / 2))
    limits = rows.agg(*[F.percentile_approx(F.when(free[k], F.col(f"m_{k}")), ends).alias(f"q{k}") for k in (0, 1)]).first()
    given = {}
    for k in (0, 1):
        if limits[k] is None:
            continue
        low, high = limits[k]
        scale, shift = (float(x) for x in model.scales[k])
        logit, sure = F.col(f"m_{k}") * scale + shift, float(np.log(SURE / (1 - SURE)))
        label = F.when((F.col(f"m_{k}") >= high) & (logit >= sure), 1).when((F.col(f"m_{k}") <= low) & (logit <= -sure), 0)
        given[f"given_{k}"] = F.when(free[k], label).otherwise(F.col(f"given_{k}"))
    return rows.withColumns(given)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with text_score, meta_score and quality_score (0 to 1, higher: better); columns of these names are replaced.

    Null text is empty; null metadata are values of their own. Without a model every score is one half.
    """
    model = pickle.dumps(model)
    names = ("text_score", "meta_score", "quality_score")
    docs = docs.drop(*names)
    at = {c: docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(model)
        for batch in batches:
            out = [np.full(batch.num_rows, 0.5)] * 3
            if fitted is not None and batch.num_rows:
                own = {c: batch.column(k).to_pylist() for c, k in at.items()}
                out = fitted.scores(np.concatenate([text_view(t) for _, t in blocks(own["text"])]), meta_view(own["source"], own["lang"], own["n_chars"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(c, DoubleType()) for c in names)]))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang", "n_chars")
    found = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "meta_score", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
