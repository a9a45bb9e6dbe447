"""Features of a stream of sequences: each micro-batch is vectorised as a table and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vicinage.operators.options import SequenceOptions
from vicinage.operators.sequence_vectorizer import vectorize


def write_features(stream: DataFrame, path: str, checkpoint: str, options: SequenceOptions = SequenceOptions(), once: bool = False) -> StreamingQuery:
    """Append id, feature, value of a stream of sequences (id, tokens [, weights]) to Parquet files.

    A vector needs its own sequence alone, so there is no state and late rows are like others. Each batch goes to a
    folder of its own number and is overwritten when it is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        vectorize(batch, options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
