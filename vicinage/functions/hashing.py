"""The hash contract: every label, neighbourhood and feature id is 32 bits of an md5 of text, equal in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(*parts: Column) -> Column:
    """Unsigned 32-bit hash of the parts' text joined with ``|``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def list_hash(values: Column) -> Column:
    """The same of an array's values joined with commas."""
    return F.conv(F.substring(F.md5(F.array_join(F.transform(values, lambda v: v.cast("string")), ",")), 1, 8), 16, 10).cast("long")


def feature_id(nbits: int, *parts: Column) -> Column:
    """Feature id from 1 to 2 ** nbits; id 0 is kept for instances without features."""
    return text_hash(*parts).bitwiseAND((1 << nbits) - 1) + 1
