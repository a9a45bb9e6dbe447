"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

A document is the set of its word shingles. Each signature coordinate digests a few minimum hashes, so that documents
of similarity s share it with probability s ** ROWS. Documents are posted under each coordinate-value pair, collisions
in the lists are counted, and pairs of MATCHES collisions or more are confirmed on their full shingle sets.

* Prefix: a document's coordinates are put in order of their lists' lengths. Pairs of MATCHES collisions meet in a list
  of their COORDINATES - MATCHES + 1 shortest ones, so each document leaves its MATCHES - 1 longest lists.
* Skip: the lists that a document has left are not merged; a pair that met elsewhere is probed in them.

Copies and families of near copies would make a list's pairs quadratic. Documents of equal sets are one class, of which
only the representative is posted. Each list has a hub, its member with the most company over all its lists (of equal
ones that of most copies, as an original is): collisions are counted with hubs first, and each document is confirmed
with the hub that it meets most often. Only lists that then hold several components are merged further, and only pairs
across components. In lists of more than SHORT members these would still be too many: there the members of one hub are
joined on what they have otherwise than the hub (see :mod:`residual`), so no list has a bound beyond which links are lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm.common import cut, documents, few
from vicinage.llm.components import connected, merged
from vicinage.llm.kernel import U, Words, blocks, distinct, mixed, series, shingles
from vicinage.llm.residual import around_hubs, members_of

#: At similarity 0.8 a pair shares 16 of 32 coordinates on average, and fewer than 5 once in 100,000 pairs.
COORDINATES, ROWS, MATCHES = 32, 3, 5
#: Longest list of which all pairs across components are counted; a member has fewer partners in it than a difference has items.
SHORT = 8
SIGNED = "id long, n_shingles long, set_low long, set_high long, signature array<long>"
SETS = "id long, set_low long, set_high long, shingles array<long>"


def _sets_of(texts: list[bytes], width: int) -> tuple:
    """Of each text its distinct shingles (hashes one after the other, and their number) and the 128-bit digest of the set."""
    hashes, of = distinct(*shingles(Words(texts), width))
    count = np.bincount(of, minlength=len(texts))
    low, high = np.zeros(len(texts), U), np.zeros(len(texts), U)
    full = count > 0
    if len(hashes):
        first = (np.cumsum(count) - count)[full]
        low[full] = np.add.reduceat(mixed(hashes), first)
        high[full] = np.add.reduceat(mixed(hashes ^ U(0x5851F42D4C957F2D)), first)
    return hashes, count, low, high


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def signed(docs: DataFrame, width: int) -> DataFrame:
    """id, number of distinct shingles, 128-bit digest of their set and signature of each row of docs (id, text).

    Words are split at spaces and the characters 9 to 13 and A-Z are folded. A text of fewer words is one shingle of
    all of them; without words the set is empty and the signature null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = series(COORDINATES * ROWS, 11) | U(1), series(COORDINATES * ROWS, 12)
        for batch in batches:
            for begin, texts in blocks(batch.column(1).to_pylist()):
                hashes, count, low, high = _sets_of(texts, width)
                full = count > 0
                values = np.zeros((int(full.sum()), COORDINATES), U)
                if len(hashes):
                    first = (np.cumsum(count) - count)[full]
                    for k in range(COORDINATES):
                        for r in range(k * ROWS, (k + 1) * ROWS):
                            # The high bits of a product depend on all bits of the hash.
                            least = np.minimum.reduceat((hashes * factors[r] + shifts[r]) >> U(8), first)
                            values[:, k] = mixed(values[:, k] + least)
                edges = np.concatenate([[0], np.cumsum(full) * COORDINATES]).astype(np.int32)
                signatures = pa.ListArray.from_arrays(pa.array(edges, mask=np.append(~full, False)), _longs(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(count, pa.int64()), _longs(low), _longs(high), signatures], ["id", "n_shingles", "set_low", "set_high", "signature"])

    return docs.select(F.col("id").cast("long"), "text").mapInArrow(run, SIGNED)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """id, digest of the set and its shingles (hashes in order) of each row of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in blocks(batch.column(1).to_pylist()):
                hashes, count, low, high = _sets_of(texts, width)
                edges = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), _longs(low), _longs(high), pa.ListArray.from_arrays(pa.array(edges), _longs(hashes))], ["id", "set_low", "set_high", "shingles"])

    return docs.select(F.col("id").cast("long"), "text").mapInArrow(run, SETS)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (id, shingles) have 100 * intersection >= percent * union.

    The first end's set is joined last, so that what is moved by a frequent second end, as hubs are, is small.
    """
    one, two = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = pairs.select("a", "b").join(two, "b").join(one, "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return both.filter((shared > 0) & (100 * shared >= percent * union)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links, the own one included; kept marks the row of that id (of
    repeated rows, all). Null texts, empty ones and those without words have 0 shingles and are linked with nothing.
    Null ids stay null and are not kept. Rows of one id and different texts go by their own texts; where such an id is
    the smallest one of several classes of equal sets, the links of any of its texts count for all of these.
    Empty input: no rows. Other columns of the input don't matter.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = cut(signed(plain, width))
    classes = rows.filter(F.col("id").isNotNull() & F.col("signature").isNotNull()).groupBy("set_low", "set_high", "n_shingles").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"))
    classes = cut(classes)
    component = _components(classes, plain, width, percent)
    known = classes.join(component, F.col("rep") == F.col("node"), "left").select("set_low", "set_high", F.col("n_shingles").alias("size"), F.coalesce("root", "rep").alias("found"))
    same = [F.col(f"r.{c}") == F.col(f"k.{c}") for c in ("set_low", "set_high")] + [F.col("r.n_shingles") == F.col("k.size"), F.col("r.signature").isNotNull(), F.col("r.id").isNotNull()]
    joined = rows.alias("r").join(known.alias("k"), same, "left")
    component_id = F.coalesce(F.col("k.found"), F.col("r.id"))
    return joined.select(F.col("r.id").alias("id"), F.col("r.n_shingles").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("r.id") == component_id, F.lit(False)).alias("kept"))


LIST = ["coordinate", "value"]


def _posted(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (rep, size, copies, company, coordinate, value) of each representative's prefix, and its shared coordinates.

    Lists of one member are left out, and representatives that share fewer than MATCHES coordinates with any others.
    company is the sum of the logarithms of the lengths of a representative's lists, rounded: the order of sums must not
    tell equal ones apart. The second result (rep, tokens)
    has a hash of each shared coordinate-value pair.
    """
    every = classes.select("rep", F.col("n_shingles").alias("size"), "copies", F.posexplode("signature").alias(*LIST))
    lengths = every.groupBy(*LIST).agg(F.count(F.lit(1)).alias("length")).filter(F.col("length") > 1)
    shared = every.join(lengths, LIST)
    lists = F.sort_array(F.collect_list(F.struct("length", *LIST)))  # COORDINATES at most
    listed = shared.groupBy("rep", "size", "copies").agg(lists.alias("lists"), F.round(F.sum(F.log2("length")), 6).alias("company"))
    listed = cut(listed.filter(F.size("lists") >= MATCHES))
    prefix = F.explode(F.slice("lists", F.lit(1), F.size("lists") - (MATCHES - 1))).alias("l")
    tokens = F.transform("lists", lambda x: F.xxhash64(x["coordinate"], x["value"]))
    return listed.select("rep", "size", "copies", "company", prefix).select("rep", "size", "copies", "company", "l.coordinate", "l.value"), listed.select("rep", tokens.alias("tokens"))


def _components(classes: DataFrame, plain: DataFrame, width: int, percent: int) -> DataFrame:
    """node, root: the component of each representative that has a link."""
    posted, tokens = _posted(classes)
    central = F.struct("company", "copies", (-F.col("rep")).alias("back"))
    lists = posted.groupBy(*LIST).agg(F.max(central).alias("first"), F.count(F.lit(1)).alias("length")).filter(F.col("length") > 1)
    posted = cut(posted.join(lists.select(*LIST, "length", (-F.col("first.back")).alias("hub")), LIST))
    ids = cut(posted.select(F.col("rep").alias("id")).distinct())
    sets = cut(shingle_sets(plain.join(few(ids), "id", "left_semi"), width).dropDuplicates(["id", "set_low", "set_high"]))
    # Collisions with hubs: each document's most frequent one.
    met = posted.filter(F.col("rep") != F.col("hub")).groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("collisions"))
    best = cut(met.groupBy(F.col("rep").alias("a")).agg(F.max_by("hub", F.struct("collisions", -F.col("hub"))).alias("b")))
    component = connected(cut(confirmed(best, sets, percent)))
    # Collisions across the components that still share lists.
    rooted = posted.join(component, F.col("rep") == F.col("node"), "left").select(*LIST, "length", "rep", "hub", "size", F.coalesce("root", "rep").alias("root"))
    apart = rooted.groupBy(*LIST).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") != F.col("high")).select(*LIST)
    rooted = cut(rooted.join(apart, LIST))
    pairs = _alike(_across(rooted.filter(F.col("length") <= SHORT), percent), tokens)
    crowded = cut(members_of(rooted.filter(F.col("length") > SHORT), component))
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.unionByName(around_hubs(crowded, sets, percent)).distinct().join(tried, ["a", "b"], "left_anti")
    return merged(component, cut(confirmed(pairs, sets, percent)))


def _across(rooted: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of different components that meet in a list, of sizes that allow the similarity, and their collisions."""
    p, q = (rooted.select(*LIST, *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "size", "root")]) for x in "ab")
    fits = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    met = p.join(q, LIST).filter((F.col("rep_a") < F.col("rep_b")) & (F.col("root_a") != F.col("root_b")) & fits)
    return met.groupBy(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).agg(F.count(F.lit(1)).alias("collisions"))


def _alike(met: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs (a, b, collisions) of MATCHES collisions or more, those in lists that were skipped counted."""
    one, two = (tokens.select(F.col("rep").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    both = met.join(two, "b").join(one, "a")
    return both.filter((F.col("collisions") >= MATCHES) | (F.size(F.array_intersect("tokens_a", "tokens_b")) >= MATCHES)).select("a", "b")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4).withColumnRenamed("id", "doc_id")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates of five-word shingles: the one of the smallest id."""
    found = near_duplicates(docs).filter(~F.col("kept") & F.col("id").isNotNull()).select(F.col("id").alias("_gone")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("_gone"), "left_anti").select(*docs.columns)
