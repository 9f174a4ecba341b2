"""Questions as a stream: each micro-batch is answered by the batch retriever against the static index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer_stream(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write the retrieval of every micro-batch to ``path``, one folder a batch, so that a repeated batch replaces itself."""

    def batch(df: DataFrame, epoch: int) -> None:
        retrieve(df).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
