"""Saving and loading models of any family: one folder each, tables plus one line of JSON."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING, Any

from pyspark.sql import SparkSession

if TYPE_CHECKING:
    from widecast.operators.learner import Model


def write_meta(spark: SparkSession, path: str, meta: dict[str, Any]) -> None:
    line = json.dumps(meta, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}/meta").first()["value"])


def save_model(model: Model, path: str) -> None:
    """Write the model, replacing what the folder holds."""
    model.save(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """Read a model of whatever family was saved there."""
    from widecast.operators.balanced import PriorCorrectedModel
    from widecast.operators.boost import BoostModel
    from widecast.operators.families import PipelineClassifier
    from widecast.operators.nbayes import NaiveBayesModel
    from widecast.operators.stack import StackModel

    kinds = {m.family: m for m in (BoostModel, NaiveBayesModel, PipelineClassifier, PriorCorrectedModel, StackModel)}
    return kinds[read_meta(spark, path)["family"]].load(spark, path)
