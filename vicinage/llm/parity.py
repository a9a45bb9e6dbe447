"""Jaccard join of word-shingle sets by parity sketches.

Shingles are dealt by hash to the parts of a sketch, and each part's word is the exclusive-or of its shingles' hashes, so
that a shingle which only one of two sets has changes one word: the number of unequal words is at most the size of the
symmetric difference. Sets of similarity s and sizes a <= b differ in no more than a * (1 - s) / s shingles.

* Size bands: sketches of a band have as many parts for all its sets. A set is also sketched in the bands below that
  hold sizes which can be linked with its own.
* Pigeonhole: a band of at most ``most`` differences has ``most + spare`` parts, so linked sets have ``spare`` equal words
  or more, and meet in a list of a part and its word. A set with e empty parts, whose words say nothing, has at least
  spare - e others in common with each of its partners: it posts those only, and leaves its spare - e - 1 longest lists.
  Only a set of so many empty parts that these could be all that are equal posts them too, and leaves no list.
* Bits: pairs that met are compared by a second parity sketch of BITS bits, whose Hamming distance is no greater than
  the symmetric difference either, and then on their full sets.

Equal sets are one class with one representative. Each list has a hub, its member with the most company, and a set is
first compared with the hub that it meets most often; only pairs of different components follow. In lists of more than
SHORT members these are joined on what they have otherwise than the hub (see :mod:`residual`): parities are linear, so
the sketch of two sets' difference is the difference of their sketches, and that of their differences from a hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm.common import cut, documents, few
from vicinage.llm.components import connected, merged
from vicinage.llm.kernel import U, Words, blocks, distinct, mixed, shingles
from vicinage.llm.near_dup import SHORT, confirmed
from vicinage.llm.residual import around_hubs, members_of

BITS = 2048
#: Largest size of a band over its smallest. Low bits of a list's name hold its band, those of a class how many lists it needs.
RATIO, BAND, NEED = 1.4, 128, 256
SIGNED = "id long, n_shingles long, set_low long, set_high long"
POSTED = "list long, class long"
SETS = "id long, set_low long, set_high long, shingles array<long>, bits array<long>"


def _begins() -> np.ndarray:
    """Smallest size of each band, up to more shingles than a text can have."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out)


def _spare(most: np.ndarray) -> np.ndarray:
    """Parts beyond ``most`` differences."""
    return 3 + most // 4


class Bands:
    """Bands by size for one similarity: most differences, spare words and parts of each."""

    def __init__(self, percent: int):
        self.percent, self.begins = percent, _begins()
        self.most = (self.begins[1:] - 1) * (100 - percent) // percent
        self.spare = _spare(self.most)
        self.parts = self.most + self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, sizes, "right") - 1

    def members(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Set and band, for each band that a set is sketched in; where no difference is allowed, none is needed."""
        last, first = self.of(sizes), self.of(np.maximum(1, -(-self.percent * sizes // 100)))
        n = last - first + 1
        which = np.repeat(np.arange(len(sizes)), n)
        band = np.repeat(first, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        needed = (self.most[band] > 0) & (sizes[which] > 0)
        return which[needed], band[needed]

    def lists(self, hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the lists that sets are posted in, and the set of each; sets are one after the other in ``hashes``.

        Third, how many of the set's lists in the band any linked set shares, at least.
        """
        which, band = self.members(count)
        if not len(which):
            return np.empty(0, U), which, which
        size, parts = count[which], self.parts[band]
        at = np.cumsum(parts) - parts
        item = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat((np.cumsum(count) - count)[which], size)
        own = hashes[item]
        part = ((mixed(own ^ U(0x2545F4914F6CDD1D)) >> U(32)) * np.repeat(parts, size).astype(U) >> U(32)).astype(np.int64)
        words, held = np.zeros(parts.sum(), U), np.zeros(parts.sum(), bool)
        slot = np.repeat(at, size) + part
        np.bitwise_xor.at(words, slot, own)
        held[slot] = True
        of = np.repeat(np.arange(len(which)), parts)
        need = self.spare[band] - np.bincount(of, ~held, len(which)).astype(np.int64)
        posted = held | (need < 1)[of]
        place = np.arange(len(of)) - at[of]
        names = mixed(words + mixed((band[of] << 40 | place).astype(U))) & ~U(BAND - 1) | band[of].astype(U)
        return names[posted], which[of[posted]], np.maximum(need, 1)[of[posted]]


def _sets_of(texts: list[bytes], width: int) -> tuple:
    """Of each text its distinct shingles (hashes one after the other, and their number) and the 128-bit parity of the set."""
    hashes, of = distinct(*shingles(Words(texts), width))
    count = np.bincount(of, minlength=len(texts))
    low, high = np.zeros(len(texts), U), np.zeros(len(texts), U)
    full = count > 0
    if len(hashes):
        first = (np.cumsum(count) - count)[full]
        low[full] = np.bitwise_xor.reduceat(mixed(hashes), first)
        high[full] = np.bitwise_xor.reduceat(mixed(hashes ^ U(0x5851F42D4C957F2D)), first)
    return hashes, of, count, low, high


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def signed(docs: DataFrame, width: int) -> DataFrame:
    """id, number of distinct shingles and 128-bit parity of their set of each row of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in blocks(batch.column(1).to_pylist()):
                _, _, count, low, high = _sets_of(texts, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(count, pa.int64()), _longs(low), _longs(high)], ["id", "n_shingles", "set_low", "set_high"])

    return docs.select(F.col("id").cast("long"), "text").mapInArrow(run, SIGNED)


def postings(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """list, class (the low half of the set's parity, but for how many lists it needs) of each row of docs (id, text) and list of its sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for _, texts in blocks(batch.column(0).to_pylist()):
                hashes, _, count, low, _ = _sets_of(texts, width)
                names, which, need = bands.lists(hashes, count)
                classes = low[which] & ~U(NEED - 1) | np.minimum(need, NEED - 1).astype(U)
                yield pa.RecordBatch.from_arrays([_longs(names), _longs(classes)], ["list", "class"])

    return docs.filter(F.col("id").isNotNull()).select("text").mapInArrow(run, POSTED)


def shared(posted: DataFrame) -> DataFrame:
    """The postings (list, class), once each, of lists with several classes: one sort by list, and a look at both neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One distinct posting waits for its successor; ``met`` tells if its list had another class before.
        kept_list, kept_class, met = np.empty(0, np.int64), np.empty(0, np.int64), False
        for batch in batches:
            names, classes = (np.concatenate([k, c.to_numpy()]) for k, c in zip((kept_list, kept_class), batch.columns, strict=True))
            if not len(names):
                continue
            new = np.ones(len(names), bool)
            new[1:] = (names[1:] != names[:-1]) | (classes[1:] != classes[:-1])
            names, classes = names[new], classes[new]
            same = names[1:] == names[:-1]
            before, after = np.concatenate([[met], same]), np.append(same, False)
            out = np.flatnonzero((before | after)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(names[out]), pa.array(classes[out])], ["list", "class"])
            kept_list, kept_class, met = names[-1:], classes[-1:], bool(before[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c[: int(met)]) for c in (kept_list, kept_class)], ["list", "class"])

    return posted.repartition("list").sortWithinPartitions("list", "class").mapInArrow(run, POSTED)


def sketched_sets(docs: DataFrame, width: int) -> DataFrame:
    """id, parity of the set, its shingles (hashes in order) and its sketch of BITS bits of each row of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in blocks(batch.column(1).to_pylist()):
                hashes, of, count, low, high = _sets_of(texts, width)
                bits = np.zeros(len(texts) * (BITS // 64), U)
                bit = mixed(hashes ^ U(0x9FB21C651E98DF25)) % U(BITS)
                np.bitwise_xor.at(bits, of * (BITS // 64) + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
                edges, words = np.concatenate([[0], np.cumsum(count)]).astype(np.int32), np.arange(len(texts) + 1, dtype=np.int32) * (BITS // 64)
                lists = [pa.ListArray.from_arrays(pa.array(e), _longs(x)) for e, x in ((edges, hashes), (words, bits))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), _longs(low), _longs(high), *lists], ["id", "set_low", "set_high", "shingles", "bits"])

    return docs.select(F.col("id").cast("long"), "text").mapInArrow(run, SETS)


def _in_reach(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes, and whose bits' Hamming distance, allow the similarity."""
    one, two = (bits.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    both = pairs.join(two, "b").join(one, "a")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("size_a") + F.col("size_b")
    fits = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    return both.filter(fits & ((100 + percent) * apart <= (100 - percent) * total)).select("a", "b")


def _posted(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """list, rep, copies, company of the lists that representatives don't leave.

    company is the sum of the logarithms of the lengths of a representative's lists, rounded: the order of sums must not
    tell equal ones apart.
    """
    lengths = lists.groupBy("list").agg(F.count(F.lit(1)).alias("length"))
    every = lists.join(lengths, "list").select("list", "length", F.col("class").bitwiseAND(-NEED).alias("class"), F.col("class").bitwiseAND(NEED - 1).cast("int").alias("need"))
    every = every.join(classes.select(F.col("set_low").bitwiseAND(-NEED).alias("class"), "rep", "copies"), "class")
    own = F.sort_array(F.collect_list(F.struct("length", "list")))  # no more than the text has shingles
    held = every.groupBy("rep", "copies", "need", F.col("list").bitwiseAND(BAND - 1).alias("band")).agg(own.alias("own"), F.round(F.sum(F.log2("length")), 6).alias("company"))
    held = held.filter(F.size("own") >= F.col("need")).select("rep", "copies", "company", F.explode(F.slice("own", F.lit(1), F.size("own") - F.col("need") + 1)).alias("l"))
    return held.select(F.col("l.list").alias("list"), "rep", "copies", "company")


def _components(lists: DataFrame, classes: DataFrame, plain: DataFrame, width: int, percent: int) -> DataFrame:
    """node, root: the component of each representative that has a link."""
    posted = cut(_posted(lists, classes))
    central = F.struct("company", "copies", (-F.col("rep")).alias("back"))
    hubs = posted.groupBy("list").agg(F.max(central).alias("first"), F.count(F.lit(1)).alias("length")).filter(F.col("length") > 1)
    posted = cut(posted.join(hubs.select("list", "length", (-F.col("first.back")).alias("hub")), "list").select("list", "length", "rep", "hub"))
    ids = cut(posted.select(F.col("rep").alias("id")).distinct())
    of_class = classes.select(F.col("rep").alias("id"), F.col("n_shingles").alias("size"), "set_low", "set_high")
    sets = sketched_sets(plain.join(few(ids), "id", "left_semi"), width).dropDuplicates(["id", "set_low", "set_high"])
    sets = cut(sets.join(of_class, ["id", "set_low", "set_high"]))
    # Each set with the hub that it meets most often.
    met = posted.filter(F.col("rep") != F.col("hub")).groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("collisions"))
    best = cut(met.groupBy(F.col("rep").alias("a")).agg(F.max_by("hub", F.struct("collisions", -F.col("hub"))).alias("b")))
    component = connected(cut(confirmed(_in_reach(best, sets, percent), sets, percent)))
    # Sets of different components that still share lists.
    rooted = posted.join(component, F.col("rep") == F.col("node"), "left").select("list", "length", "rep", "hub", F.coalesce("root", "rep").alias("root"))
    apart = rooted.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") != F.col("high")).select("list")
    rooted = cut(rooted.join(apart, "list"))
    p, q = (rooted.filter(F.col("length") <= SHORT).select("list", F.col("rep").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    pairs = p.join(q, "list").filter((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))).select("a", "b")
    members = cut(members_of(rooted.filter(F.col("length") > SHORT), component))
    pairs = pairs.union(around_hubs(members, sets, percent)).distinct()
    return merged(component, cut(confirmed(_in_reach(pairs, sets, percent), sets, percent)))


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id reachable over links, the own one included).

    Words are split at spaces and the characters 9 to 13 and A-Z are folded. A text of fewer words than ``width`` is one
    shingle of all of them. Null texts, empty ones and those without words have 0 shingles and are linked with nothing.
    Null ids stay null. Rows of one id and different texts go by their own texts; where such an id is the smallest one
    of several classes of equal sets, the links of any of its texts count for all of these. Empty input: no rows. Other
    columns of the input don't matter.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = cut(signed(plain, width))
    full = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    classes = cut(rows.filter(full).groupBy("set_low", "set_high", "n_shingles").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    component = _components(cut(shared(postings(plain, width, percent))), classes, plain, width, percent)
    key = ["set_low", "set_high", "n_shingles"]
    known = classes.join(component, F.col("rep") == F.col("node"), "left").select(*[F.col(c).alias(f"_{c}") for c in key], F.coalesce("root", "rep").alias("found"))
    same = [F.col(c) == F.col(f"_{c}") for c in key] + [full]
    return rows.join(known, same, "left").select("id", "n_shingles", F.coalesce("found", "id").alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def components_sql(width: int, more: str = "") -> str:
    """SQL for the components over the whole texts: sets, all pairs with a common shingle, and what they reach."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[k:k + {width - 1}], ' ') for k in range(1, len(w) - {width - 2})]) END AS s FROM cut),
classes AS (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY ALL),
items AS (SELECT rep, n, unnest(s) AS item FROM classes),
met AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS n, b.n AS m, count(*) AS shared FROM items a JOIN items b ON a.item = b.item AND a.rep < b.rep
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 100 * shared >= 80 * (n + m - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM ways UNION SELECT r.node, w.b FROM reach r JOIN ways w ON r.seen = w.a),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(r.root, c.rep, s.doc_id) AS component_id{more}
FROM sets s LEFT JOIN classes c ON c.s = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN roots r ON r.node = c.rep
"""


OP11_SQL = components_sql(5)
OP5_SQL = components_sql(4, ", s.doc_id = coalesce(r.root, c.rep, s.doc_id) AS kept")
