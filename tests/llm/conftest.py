"""Odd inputs that every operator must take: nulls, blanks, a long text, copies, and columns of clashing names."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
TEXTS = [None, "", " \t\n", "one", "One two  three", "one two three", "a#b $ c\nsame line\nsame line\n\n", LONG, LONG + " end", "été Übung \U0001f600 naïve", "x" * 50_000]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, id string, size string, target string, n_words string, toxicity string, quality_score string, kept string, label string, digests string"


def odd_rows():
    rows = [(k, t, None if k % 3 == 0 else f"s{k % 3}", None if k % 2 else "en", None if t is None else len(t)) for k, t in enumerate(TEXTS)]
    rows += [rows[4], rows[7], (50, TEXTS[4], "s1", "en", 3)]
    return [(*row, *"abcdefghi") for row in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def odd_with_null_id(spark, odd):
    return odd.unionByName(spark.createDataFrame([(None, "no id here", "s1", "en", 10, *"abcdefghi")], SCHEMA))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
