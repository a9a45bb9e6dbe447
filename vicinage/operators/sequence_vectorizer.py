"""Explicit features of sequences: ordered pairs of equally long substrings at bounded offsets. No join is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.functions.hashing import feature_id, text_hash
from vicinage.functions.lineage import spread
from vicinage.operators.copies import shared
from vicinage.operators.graph_vectorizer import normalized
from vicinage.operators.options import SequenceOptions


def tokens_of(text: Column) -> Column:
    """The characters of a text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _pairs(sequences: DataFrame, options: SequenceOptions) -> DataFrame:
    """id, n, pos, end, r, d, feature, value for every start, radius and offset that fits. Sequences: id, tokens [, weights]."""
    r, d, low = options.radius, options.distance, options.min_d
    offsets = [*range(low, d + 1), *range(-d, -low)]
    weights = F.col("weights") if "weights" in sequences.columns else F.lit(None).cast("array<double>")
    n, pos, end, r_ = F.size("tokens"), F.col("pos"), F.col("end"), F.col("r")
    rows = sequences.select("id", "tokens", weights.alias("weights"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    # From here on a row has no more than the tokens that its pairs can reach, of which the first one is at ``first``.
    first = F.greatest(pos - d, F.lit(0))
    near = lambda c: F.slice(c, first + 1, 2 * d + r + 1).alias(c)
    rows = rows.select("id", near("tokens"), near("weights"), "n", "pos", first.alias("first"))
    rows = rows.withColumn("r", F.explode(F.array(*[F.lit(k) for k in range(options.min_r, r + 1)])))
    rows = rows.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("end", pos + F.col("offset"))
    rows = rows.filter((pos + r_ < F.col("n")) & (end >= 0) & (end + r_ < F.col("n"))).withColumn("d", F.abs("offset"))
    buckets = options.bucket_weights
    if buckets is not None:
        allowed = [F.lit(f"{i},{j}") for (i, j), w in buckets.items() if w]
        rows = rows.filter(F.concat_ws(",", F.col("r").cast("string"), F.col("d").cast("string")).isin(*allowed) if allowed else F.lit(False))
    run = lambda at: text_hash(F.array_join(F.transform(F.slice("tokens", F.col(at) - F.col("first") + 1, F.col("r") + 1), lambda t: F.regexp_replace(t, r"([\\,])", r"\\$1")), ","))
    total = lambda at: F.aggregate(F.slice("weights", F.col(at) - F.col("first") + 1, F.col("r") + 1), F.lit(0.0), lambda a, w: a + w)
    start = F.lit(42) if options.use_only_context else run("pos")
    value = F.when(F.col("weights").isNull(), F.lit(1.0)).otherwise(total("pos") + total("end"))
    return rows.select("id", "n", F.col("pos").cast("long").alias("pos"), "end", "r", "d", feature_id(options.nbits, start, run("end"), F.col("r"), F.col("d")).alias("feature"), value.alias("value"))


def checked(sequences: DataFrame) -> DataFrame:
    """The sequences; an empty one, or one whose weights don't match its tokens, ends the query with an error."""
    wrong = F.size("tokens") < 1
    if "weights" in sequences.columns:
        wrong = wrong | (F.col("weights").isNotNull() & (F.size("weights") != F.size("tokens")))
    return sequences.withColumn("tokens", F.when(wrong, F.raise_error(F.lit("empty sequence, or weights of another length")).cast("array<string>")).otherwise(F.col("tokens")))


def vectorize(sequences: DataFrame, options: SequenceOptions = SequenceOptions()) -> DataFrame:
    """id, feature, value: one sparse vector a sequence."""
    return shared("id", (spread(sequences, "id"),), lambda s: normalized(_pairs(checked(s), options), ["id"], options))


def position_vectorize(sequences: DataFrame, options: SequenceOptions = SequenceOptions()) -> DataFrame:
    """id, pos, feature, value: one vector a position, of the substrings that start or end there.

    A substring of one token starts and ends at its position and counts twice; one that ends there counts only where
    one of its length also starts there. (r, d) are not normalised apart.
    """
    return shared("id", (spread(sequences, "id"),), lambda s: _of_positions(_pairs(checked(s), options), options))


def _of_positions(rows: DataFrame, options: SequenceOptions) -> DataFrame:
    starting = rows.select("id", "pos", "r", "d", "feature", "value")
    ending = rows.withColumn("pos", F.col("pos") + F.col("r")).filter("pos + r < n").select("id", "pos", "r", "d", "feature", "value")
    plain = options.set_params(inner_normalization=False)
    return normalized(starting.unionByName(ending), ["id", "pos"], plain)


def similarity(features: DataFrame, reference: DataFrame) -> DataFrame:
    """id, similarity: dot product of each vector with the reference one (feature, value); 0 where nothing is shared."""
    own = reference.select("feature", F.col("value").alias("other"))
    return features.join(own, "feature", "left").groupBy("id").agg(F.sum(F.col("value") * F.coalesce("other", F.lit(0.0))).alias("similarity"))
