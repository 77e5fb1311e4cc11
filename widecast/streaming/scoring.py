"""Batch scoring applied to a streaming table: the fitted models are plain projections and
broadcast joins, so a stream is scored by the same code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from widecast.operators.evaluate import prediction_distribution
from widecast.operators.learner import PREDICT, PROBABILITIES, Model


def score_stream(model: Model, stream: DataFrame) -> DataFrame:
    """The streaming rows with ``predict`` and ``probabilities``."""
    return model.transform(stream)


def stream_distribution(scored: DataFrame) -> DataFrame:
    """Running count per predicted class; its state holds one row per class."""
    return prediction_distribution(scored)


def export_stream(scored: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append key, class and probabilities to Parquet; each available file is scored once."""
    return (
        scored.select(key, PREDICT, PROBABILITIES)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
