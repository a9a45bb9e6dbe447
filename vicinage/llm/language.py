"""Language of web pages by Bayesian evidence fusion.

Log likelihoods of the page's text (byte trigrams) are added to those of the language that its markup declares and to
a prior of its host. Host priors are counts of the corpus, smoothed towards the host's address suffix and that towards
the whole corpus; the page's own count is taken out of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm.common import cut, documents, few
from vicinage.llm.kernel import blocks

SLOTS = 1 << 15
#: Languages whose counts a task holds before it hands them on.
HELD = 64
#: Hosts or suffixes, at most, whose counts are broadcast.
HELD_ROWS = 100_000
#: Smoothing counts of a host towards its suffix and of a suffix towards the corpus.
HOST, SUFFIX = 4.0, 20.0
#: Trigrams of a text aren't independent: their log likelihood counts as that of so many.
EFFECTIVE = 40.0


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text of every byte trigram, A-Z folded; a text begins and ends with a space, so none reaches into the next."""
    data = np.frombuffer(b"\n" + b"\n\n".join(texts) + b"\n\n", np.uint8).astype(np.uint32)
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    data[data == 10] = 32
    key = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    slot = (key * np.uint32(2654435761)) >> np.uint32(17)
    of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])[: len(key)]
    keep = (data[1:-1] != 32) | (data[:-2] != 32)
    return slot[keep].astype(np.int64), of[keep]


def profiles(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of each slot, from all documents (text, lang) that have both.

    Counts are made by grouped aggregation over (language, slot); languages times slots of them go to the driver.
    Without a document there are no languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], ["lang", "slot", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for begin, texts in blocks(batch.column(1).to_pylist()):
                slot, of = _trigrams(texts)
                names, which = np.unique(langs[begin : begin + len(texts)], return_inverse=True)
                order = np.argsort(which[of], kind="stable")
                edges = np.searchsorted(which[of][order], np.arange(len(names) + 1))
                for k, lang in enumerate(names):
                    held.setdefault(lang, np.zeros(SLOTS, np.int64))
                    held[lang] += np.bincount(slot[order[edges[k] : edges[k + 1]]], minlength=SLOTS)
                    if len(held) > HELD:
                        yield from handed()
        yield from handed()

    counts = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(run, "lang string, slot long, n long")
    counts = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("slot").alias("slot"), F.collect_list("n").alias("n"))  # slots at most a language
    found = {row["lang"]: (row["slot"], row["n"]) for row in counts.collect()}
    langs = sorted(found)
    table = np.full((len(langs), SLOTS), 0.1)
    for k, lang in enumerate(langs):
        table[k, found[lang][0]] += found[lang][1]
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def visible(html: Column) -> Column:
    """Text of a page without scripts, styles, comments, tags and entities. Null: empty."""
    text = F.coalesce(html, F.lit(""))
    for pattern in (r"(?is)<(script|style)\b.*?</\1\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>", r"&#?\w+;"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def identified(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """page_id, host, suffix, declared, text_lang, lang, probability of each row of pages (page_id, url, html).

    A missing url gives an empty host and suffix, which are a host and a suffix like others; a missing declaration or
    one of an unknown language says nothing; an empty text leaves the prior and the declaration to decide. Ties go to
    the language that comes first. Without languages lang is null. Repeated rows are pages of their own.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    rows = pages.select("page_id", host.alias("host"), declared.alias("declared"), visible(F.col("html")).alias("text"))
    rows = rows.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    if not langs:
        return rows.select("page_id", "host", "suffix", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, texts in blocks(batch.column(4).to_pylist()):
                slot, of = _trigrams([b" ".join(t.split()) for t in texts])
                count = np.maximum(np.bincount(of, minlength=len(texts)), 1)
                logs = np.stack([np.bincount(of, table[k, slot], len(texts)) for k in range(len(langs))], axis=1)
                out += (logs / count[:, None] * np.minimum(count, EFFECTIVE)[:, None]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.list_(pa.float64()))], ["page_id", "host", "suffix", "declared", "logs"])

    scored = rows.select("page_id", "host", "suffix", "declared", "text").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, host string, suffix string, declared string, logs array<double>")
    scored = cut(scored.withColumn("soft", _normal(F.col("logs"))))
    n = len(langs)
    soft = [F.col("soft")[k] for k in range(n)]
    sums = lambda name: [F.sum(s).alias(f"{name}{k}") for k, s in enumerate(soft)]
    total = scored.agg(*sums("t")).first()  # one number a language
    total = [(total[k] or 0.0) + 1.0 for k in range(n)]
    by_suffix = scored.groupBy("suffix").agg(F.array(*sums("s")).alias("suffix_n"))
    by_host = scored.groupBy("host").agg(F.array(*sums("h")).alias("host_n"))
    by_declared = scored.filter(F.col("declared").isin(langs)).groupBy("declared").agg(*sums("d")).collect()  # languages at most
    said = {row["declared"]: [row[f"d{k}"] for k in range(n)] for row in by_declared}
    votes = [sum(v[k] for v in said.values()) for k in range(n)]
    tells = lambda d: [float(np.log((said.get(d, [0.0] * n)[k] + 0.5) / (votes[k] + 0.5 * n))) for k in range(n)]
    known = pages.sparkSession.createDataFrame([(d, tells(d)) for d in langs], "declared string, told array<double>")  # languages squared
    nothing = F.array(*[F.lit(0.0)] * n)
    corpus = F.array(*[F.lit(t / sum(total)) for t in total])
    rest = lambda counts: F.zip_with(counts, F.col("soft"), lambda a, own: F.greatest(a - own, F.lit(0.0)))
    smoothed = lambda counts, towards, weight: F.zip_with(counts, towards, lambda a, p: (a + weight * p))
    # Pages without a host are one host of any size: its one row goes to them, not they to it.
    by_host = cut(by_host)
    found = scored.join(few(cut(by_suffix), HELD_ROWS), "suffix")
    named = found.filter(F.col("host") != "").join(few(by_host, HELD_ROWS), "host")
    nameless = found.filter(F.col("host") == "").crossJoin(F.broadcast(by_host.filter(F.col("host") == "").select("host_n")))  # one row
    found = named.unionByName(nameless).join(F.broadcast(known), "declared", "left")
    found = found.withColumn("suffix_p", _share(smoothed(rest(F.col("suffix_n")), corpus, SUFFIX)))
    found = found.withColumn("host_p", _share(smoothed(rest(F.col("host_n")), F.col("suffix_p"), HOST)))
    evidence = F.zip_with(F.zip_with("logs", F.coalesce("told", nothing), lambda a, b: a + b), "host_p", lambda a, p: a + F.log(p))
    found = found.withColumn("posterior", _normal(evidence))
    name = lambda column: F.element_at(F.array(*map(F.lit, langs)), F.array_position(column, F.array_max(column)).cast("int"))
    return found.select("page_id", "host", "suffix", "declared", name(F.col("soft")).alias("text_lang"), name(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"))


def _share(counts: Column) -> Column:
    return F.transform(counts, lambda c: c / F.aggregate(counts, F.lit(0.0), lambda a, x: a + x))


def _normal(logs: Column) -> Column:
    return _share(F.transform(logs, lambda x: F.exp(x - F.array_max(logs))))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, table = profiles(documents(spark, sf_dir))
    return identified(spark.read.parquet(f"{sf_dir}/pages.parquet"), langs, table)
