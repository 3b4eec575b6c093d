"""Scoring of a stream of interactions with frozen factors."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def score_batches(stream: DataFrame, model, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of ``stream`` (u, i) with its scores goes to ``sink``; unknown ids are left out."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(model.scores(batch), n)).option("checkpointLocation", checkpoint).start()
