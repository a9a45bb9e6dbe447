"""A corpus pipeline of the training-data operators: filter, deduplicate, mix and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vicinage.llm.common import documents, shared_folder
from vicinage.llm.mixing import mixing_stage
from vicinage.llm.near_dup import near_dup_stage
from vicinage.llm.packing import packing_stage
from vicinage.llm.repeats import repeats_stage
from vicinage.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express a learned score, so run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one returns is written to the session's shared folder and read again."""
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
