"""Cutting the lineage of iterative jobs with reliable checkpoints, and joins with small sides."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where the session has none, one in the warehouse.

    A temporary folder is taken only where driver and executors are one local process.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="vicinage-") if context.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    For loops of joins: a checkpoint still knows the constraints of its plan, which such a loop doubles in every round.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to as many parts as a shuffle has.

    For rows that are unfolded to many more: a table of one small file is read by one task, which would unfold all of it.
    The number is named, since Spark would join parts of few bytes to one again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def many(df: DataFrame) -> DataFrame:
    """``df`` marked so that its next join sorts and shuffles both sides.

    For rows that come of explode or stand for a table that grows: Spark takes exploded rows for as small as what they
    come from, so it would gather millions of them in the driver to broadcast them.
    """
    return df.hint("merge")


def few(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` (materialised, narrow) marked for broadcast if it has no more than ``rows`` rows; else it is joined by shuffles."""
    return F.broadcast(df) if df.count() <= rows else df
