"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.functions.lineage import cut, few, shared_folder, stored  # noqa: F401

#: The separators of a word: space, and the characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def trimmed(text: Column) -> Column:
    """The text without separators at its ends; null becomes empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words_of(text: Column) -> Column:
    """Array of the words of a text. Null or blank text: empty array."""
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def n_words(text: Column) -> Column:
    bare = trimmed(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def hash32(*parts: Column) -> Column:
    """32 bits of an md5 of the parts' text, as DuckDB can compute them too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def unclashed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, under the operator's own names; what else the input holds can't clash."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])
