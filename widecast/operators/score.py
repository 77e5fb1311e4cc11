"""Batch scoring and its exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F

from widecast.operators.evaluate import prediction_distribution
from widecast.operators.learner import PREDICT, PROBABILITIES, Model
from widecast.sources.tables import write_csv


def score(model: Model, df: DataFrame) -> DataFrame:
    """The input rows with ``predict`` and ``probabilities`` appended."""
    return model.transform(df)


def explode_probabilities(
    df: DataFrame, keep: Sequence[str], n: int, names: Sequence[str] | None = None, column: str = PROBABILITIES
) -> DataFrame:
    """One double column per class, named ``0``, ``1``, ... unless ``names`` says otherwise.

    ``column`` may be an array, a vector, or a field of a struct (``a.b``).
    """
    names = list(names or map(str, range(n)))
    values = F.col(column)
    if isinstance(df.select(values).schema[0].dataType, VectorUDT):
        values = vector_to_array(values)
    return df.select(*keep, *[values[i].alias(name) for i, name in enumerate(names)])


def export_probabilities(scored: DataFrame, key: str, classes: Sequence[str], path: str, single_file: bool = False) -> None:
    write_csv(explode_probabilities(scored, [key], len(classes)), path, single_file=single_file)


def export_labels(scored: DataFrame, key: str, path: str, single_file: bool = False) -> None:
    write_csv(scored.select(key, PREDICT), path, single_file=single_file)


def score_to(
    model: Model, df: DataFrame, key: str, probabilities_path: str, labels_path: str, single_file: bool = False
) -> DataFrame:
    """Both exports and the class distribution from one scored table, which is kept for the three."""
    scored = score(model, df).select(key, PREDICT, PROBABILITIES).persist()
    export_probabilities(scored, key, model.classes, probabilities_path, single_file)
    export_labels(scored, key, labels_path, single_file)
    counts = prediction_distribution(scored).collect()  # one row per class
    scored.unpersist()
    return df.sparkSession.createDataFrame(counts, f"{PREDICT} string, count bigint")
