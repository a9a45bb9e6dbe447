"""Quality rules: learned decision lists over statistics of a text, in DataFrame operations only.

Sequential covering: a rule grows threshold by threshold by FOIL gain on one part of the labelled rows, loses its last
thresholds again while that helps on the other part, and is kept if it is precise there; the rows it covers leave, and
the next rule is learned. Rules become one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm.common import SPACES, cut, documents, words_of

SYMBOLS = "#*$%&|<>"
#: What rules test, as SQL over the statistics; no words: 0.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "capitals_per_char": "n_capitals / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}
#: Bound on the labelled rows that rules are learned from, chosen by a hash of the id.
TRAINING_ROWS = 20_000
BINS = 32


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda left, c: F.replace(left, F.lit(c), F.lit("")), chars, text)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_marks, n_capitals, n_lines, n_dup_lines, n_repeat_words (long).

    A line counts if it has a word. A word is repeated if it stands in a run of three words that the text has twice
    or more. Null text has no words: all 0. Columns of these names are replaced. One pass, no shuffle: repeats are
    found by sorting a text's own runs, so long texts take n log n.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_marks", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")
    docs = docs.drop(*names)
    text = F.col("_text")
    step = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    step = step.withColumns({"_words": words_of(text), "_lines": F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")})
    step = step.withColumns({"_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "_n": F.size("_words")})
    tail = lambda k: F.slice("_hashes", k, F.greatest(F.col("_n") - 2, F.lit(0)))
    runs = F.zip_with(tail(1), F.zip_with(tail(2), tail(3), lambda b, c: F.xxhash64(b, c)), lambda a, bc: F.xxhash64(a, bc))
    step = step.withColumn("_runs", F.when(F.col("_n") >= 3, runs).otherwise(F.array().cast("array<bigint>")))
    place = F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.withColumn("_sorted", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), F.sort_array(place)).otherwise(none))
    other = lambda i: F.get(F.col("_sorted"), i)["h"]
    twice = F.filter("_sorted", lambda e, i: F.coalesce(other(i - 1) == e["h"], F.lit(False)) | F.coalesce(other(i + 1) == e["h"], F.lit(False)))
    step = step.withColumn("_starts", F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.zip_with("_starts", F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    length = F.length(text)
    step = step.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(_without(text, SPACES)).cast("long"),
        "n_symbols": (length - F.length(_without(text, SYMBOLS))).cast("long"),
        "n_marks": (length - F.length(_without(text, "!?"))).cast("long"),
        "n_capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.aggregate(covered, F.lit(0), lambda total, x: total + x).cast("long"),
    })
    return step.select(*docs.columns, *names)


Condition = tuple[str, str, float]


def holds(condition: Condition) -> Column:
    name, side, threshold = condition
    value = F.expr(FEATURES[name])
    return value > F.lit(threshold) if side == ">" else value <= F.lit(threshold)


def rejected_by(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that covers a row, from 1; null where none does."""
    verdict = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        verdict = F.when(reduce(lambda a, b: a & b, map(holds, rule)), number).otherwise(verdict)
    return verdict


def learn(labelled: DataFrame, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.97, least_covered: int = 4) -> list[list[Condition]]:
    """Rules that find label 1 (long) in rows with the statistics; a third of the rows (by ``part``, 0 to 2) prunes.

    Thresholds are quantiles. Each step counts labels by feature and bin in one aggregation, whatever the number of
    thresholds, and only these counts come to the driver. No labelled rows, or only one label: no rules.
    Ties go to the feature and threshold that come first.
    """
    rows = labelled.select("label", "part", *[F.expr(sql).alias(name) for name, sql in FEATURES.items()])
    quantiles = rows.agg(*[F.percentile(name, F.array(*[F.lit(k / BINS) for k in range(1, BINS)])).alias(name) for name in FEATURES]).first()
    if quantiles is None or quantiles[0] is None:
        return []
    thresholds = {name: sorted(set(quantiles[name])) for name in FEATURES}
    # A row's bin is the number of thresholds below its value: value > thresholds[k] exactly if bin > k.
    number = lambda name: F.size(F.filter(F.array(*map(F.lit, thresholds[name])), lambda t: t < F.col(name)))
    bins = F.array(*map(number, FEATURES))
    rows = cut(rows.select("label", "part", bins.alias("bins")))
    names = list(FEATURES)
    inside = lambda c: F.col("bins")[names.index(c[0])] > c[2] if c[1] == ">" else F.col("bins")[names.index(c[0])] <= c[2]
    all_of = lambda conditions: reduce(lambda a, b: a & b, map(inside, conditions), F.lit(True))
    left, rules = F.lit(True), []
    while len(rules) < most_rules:
        rule: list[tuple] = []
        while len(rule) < most_conditions:
            counts = rows.filter(left & all_of(rule) & (F.col("part") > 0)).select("label", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).collect()
            found = _best(counts, names, thresholds)
            if found is None:
                break
            rule.append(found)
        if not rule:
            break
        # Prune: the shortest beginning of the rule with the best (p - n) / (p + n) on the other part.
        sums = [F.sum(F.when(all_of(rule[: k + 1]), part)).alias(f"{c}{k}") for k in range(len(rule)) for c, part in (("p", F.col("label")), ("n", 1 - F.col("label")))]
        tested = rows.filter(left & (F.col("part") == 0)).agg(*sums).first()
        value = lambda k: ((tested[f"p{k}"] or 0) - (tested[f"n{k}"] or 0)) / max(1, (tested[f"p{k}"] or 0) + (tested[f"n{k}"] or 0))  # noqa: E731, B023
        keep = max(range(len(rule)), key=lambda k: (value(k), -k))
        p, n = tested[f"p{keep}"] or 0, tested[f"n{keep}"] or 0
        if p < least_covered or p < precision * (p + n):
            break
        rules.append([(c, side, thresholds[c][k]) for c, side, k in rule[: keep + 1]])
        left = left & ~all_of(rule[: keep + 1])
    return rules


def _best(counts: list, names: list[str], thresholds: dict) -> tuple | None:
    """The condition (feature, side, threshold number) of the largest FOIL gain; None: no gain."""
    table = {(row["feature"], row["bin"]): (row["p"], row["n"]) for row in counts}
    all_p = sum(p for (f, _), (p, _) in table.items() if f == 0)
    all_n = sum(n for (f, _), (_, n) in table.items() if f == 0)
    if not all_p or all_p == all_n:
        return None
    best, gain = None, 1e-9
    for f, name in enumerate(names):
        low_p = low_n = 0
        for k in range(len(thresholds[name])):
            p, n = table.get((f, k), (0, 0))
            low_p, low_n = low_p + p, low_n + n
            for side, own_p, own_n in (("<=", low_p, low_n), (">", all_p - low_p, all_n - low_n)):
                if own_p and own_n < all_n:
                    own = own_p * (math.log2(own_p / own_n) - math.log2(all_p / all_n))
                    if own > gain:
                        best, gain = (name, side, k), own
    return best


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> list[list[Condition]]:
    """Rules for ``quality`` 0 from at most ``rows`` labelled documents, those of the smallest hash of their id.

    Ids with several labels take the smallest, ids with several texts the smallest text; nulls are left out.
    """
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((1 - F.min("quality")).cast("long").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return learn(statistics(found).withColumn("part", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))))


def judged(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """``docs`` with the statistics, base_failed, rule (number of the rule that rejects it, or null) and kept."""
    docs = statistics(docs.drop("base_failed", "rule", "kept"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.withColumns({"base_failed": failed, "rule": rejected_by(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = learned(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
