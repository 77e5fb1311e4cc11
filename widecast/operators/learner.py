"""What every classifier family offers: ``fit`` gives a model, a model scores and saves.

A model adds two columns to the rows it scores: ``probabilities`` (array of doubles in the order of
``model.classes``) and ``predict`` (class name). Labels may be null or absent when scoring.
"""

from __future__ import annotations

from collections.abc import Hashable
from dataclasses import asdict, dataclass
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from widecast.functions import columns as C

MAX_CLASSES = 1000

PROBABILITIES = "probabilities"
PREDICT = "predict"


def label_classes(df: DataFrame, label: str) -> list[str]:
    """The classes in alphabetical order; null labels are no class."""
    rows = df.select(label).filter(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values: not a class label")
    return sorted(r[0] for r in rows)


def with_prediction(df: DataFrame, scores: str, classes: list[str]) -> DataFrame:
    """Turn a column of log scores into ``probabilities`` and ``predict``."""
    n = len(classes)
    kept = [c for c in df.columns if c != scores]
    predict = C.class_of_largest(F.col(scores), classes).alias(PREDICT)
    weighted = df.select(*kept, C.relative_weights(scores, n).alias("__weights"), predict)
    return weighted.select(*kept, C.shares("__weights", n).alias(PROBABILITIES), PREDICT)


class Model:
    """Base of the fitted models."""

    family: ClassVar[str] = ""
    classes: list[str]
    params: dict[str, Any]

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def importance(self, spark: SparkSession) -> DataFrame:
        """(variable, importance); empty for a family that has no measure of its own."""
        return spark.createDataFrame([], "variable string, importance double")

    def save(self, path: str) -> None:
        raise NotImplementedError

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        raise NotImplementedError


@dataclass(frozen=True, kw_only=True)
class Learner:
    """Base of the learners: settings plus ``fit``. Subclasses add their own settings."""

    family: ClassVar[str] = ""
    name: str

    def params(self) -> dict[str, Any]:
        plain = (str, int, float, bool, type(None), list, tuple, dict)
        return {k: v for k, v in asdict(self).items() if isinstance(v, plain) and k not in ("spec", "classes")}

    def preparation(self) -> Hashable | None:
        """What ``prepare`` depends on besides the rows; None if nothing can be shared between fits."""
        return None

    def prepare(self, df: DataFrame) -> Any:
        """The input of ``fit_prepared``, stored or cached."""
        raise NotImplementedError

    def release(self, prepared: Any) -> None:
        """Give up what ``prepare`` cached."""

    def fit_prepared(self, prepared: Any) -> Model:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> Model:
        prepared = self.prepare(df)
        try:
            return self.fit_prepared(prepared)
        finally:
            self.release(prepared)
