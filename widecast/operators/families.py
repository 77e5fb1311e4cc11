"""Classifier families that Spark ships: random forest, multinomial logistic regression, naive Bayes
on vectors. Each is one saved pipeline from raw columns to class name."""

from __future__ import annotations

from collections.abc import Hashable
from dataclasses import dataclass, field
from typing import Any, ClassVar

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from widecast.functions import columns as C
from widecast.operators.encode import VECTOR, VectorSettings, vector_slots, vectorizer
from widecast.operators.learner import PREDICT, PROBABILITIES, Learner, Model, label_classes
from widecast.sources.models import read_meta, write_meta
from widecast.spec import TableSpec

INNER = (VECTOR, "__raw", "__probability", "__prediction")


class PipelineClassifier(Model):
    family = "pipeline"

    def __init__(
        self, classes: list[str], params: dict[str, Any], pipeline: PipelineModel, slots: list[list], spreads: list[float] | None
    ):
        self.classes = classes
        self.params = params
        self.pipeline = pipeline
        self.slots = slots
        self.spreads = spreads

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.pipeline.transform(df)
        return scored.withColumn(PROBABILITIES, vector_to_array("__probability")).drop(*INNER)

    def importance(self, spark: SparkSession) -> DataFrame:
        """Forest: impurity decrease. Logistic regression: size of the coefficients, in units of one
        standard deviation of their slot. Others have none."""
        inner = self.pipeline.stages[-2]
        if hasattr(inner, "featureImportances"):
            values = inner.featureImportances.toArray()
        elif self.spreads is not None and hasattr(inner, "coefficientMatrix"):
            values = np.abs(inner.coefficientMatrix.toArray()).sum(axis=0) * np.asarray(self.spreads)
        else:
            return super().importance(spark)
        total: dict[str, float] = {}
        for (parent, _), value in zip(self.slots, values):
            total[parent] = total.get(parent, 0.0) + float(value)
        return spark.createDataFrame(list(total.items()), "variable string, importance double")

    def _meta(self) -> dict[str, Any]:
        return {
            "family": self.family,
            "classes": self.classes,
            "params": self.params,
            "slots": self.slots,
            "spreads": self.spreads,
        }

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        write_meta(spark, path, self._meta())
        self.pipeline.write().overwrite().save(f"{path}/pipeline")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PipelineClassifier:
        m = read_meta(spark, path)
        return cls(m["classes"], m["params"], PipelineModel.load(f"{path}/pipeline"), m["slots"], m["spreads"])


@dataclass
class Vectors:
    """Labelled rows as cached vectors, with the stages that make them."""

    classes: list[str]
    stages: list
    slots: list[list]
    rows: DataFrame


@dataclass(frozen=True, kw_only=True)
class PipelineLearner(Learner):
    spec: TableSpec
    classes: tuple[str, ...] | None = None
    weight: str | None = None
    vector: VectorSettings = field(default_factory=VectorSettings)
    reports_spreads: ClassVar[bool] = False

    def estimator(self, features: str):
        raise NotImplementedError

    def preparation(self) -> Hashable:
        return "vectors", repr(self.spec), self.classes, self.weight, self.vector

    def prepare(self, df: DataFrame) -> Vectors:
        label = self.spec.label
        classes = list(self.classes or label_classes(df, label))
        labelled = df.filter(F.col(label).isNotNull())
        stages = list(vectorizer(labelled, self.spec, self.vector).stages)
        ready = PipelineModel(stages).transform(labelled).withColumn("__y", C.class_index(label, classes))
        slots = [list(s) for s in vector_slots(ready)]
        # Iterative training reads the vectors many times; the wide source is read once.
        return Vectors(classes, stages, slots, ready.select(VECTOR, "__y", *([self.weight] if self.weight else [])).persist())

    def release(self, prepared: Vectors) -> None:
        prepared.rows.unpersist()

    def fit_prepared(self, prepared: Vectors) -> PipelineClassifier:
        estimator = self.estimator(VECTOR).setLabelCol("__y")
        if self.weight:
            estimator = estimator.setWeightCol(self.weight)
        estimator = (
            estimator.setPredictionCol("__prediction").setProbabilityCol("__probability").setRawPredictionCol("__raw")
        )
        fitted = estimator.fit(prepared.rows)
        spreads = None
        if self.reports_spreads:
            spreads = prepared.rows.select(Summarizer.std(F.col(VECTOR)).alias("sd")).first()["sd"].toArray().tolist()
        named = IndexToString(inputCol="__prediction", outputCol=PREDICT, labels=prepared.classes)
        return PipelineClassifier(prepared.classes, self.params(), PipelineModel([*prepared.stages, fitted, named]), prepared.slots, spreads)


@dataclass(frozen=True, kw_only=True)
class ForestLearner(PipelineLearner):
    family: ClassVar[str] = "forest"
    name: str = "forest"
    trees: int = 200
    depth: int = 15
    column_rate: str = "0.3"
    min_rows: int = 1
    seed: int = 42

    def estimator(self, features: str):
        return RandomForestClassifier(
            featuresCol=features,
            numTrees=self.trees,
            maxDepth=self.depth,
            featureSubsetStrategy=self.column_rate,
            minInstancesPerNode=self.min_rows,
            seed=self.seed,
        )


@dataclass(frozen=True, kw_only=True)
class LogisticLearner(PipelineLearner):
    family: ClassVar[str] = "logistic"
    reports_spreads: ClassVar[bool] = True
    name: str = "logistic"
    regularization: float = 0.05
    elastic_net: float = 0.01
    max_iter: int = 50

    def estimator(self, features: str):
        return LogisticRegression(
            featuresCol=features,
            family="multinomial",
            regParam=self.regularization,
            elasticNetParam=self.elastic_net,
            maxIter=self.max_iter,
        )


@dataclass(frozen=True, kw_only=True)
class VectorBayesLearner(PipelineLearner):
    """Multinomial naive Bayes; numbers are scaled to [0, 1], as it takes no negative values."""

    family: ClassVar[str] = "vector_bayes"
    name: str = "vector_bayes"
    smoothing: float = 1.0
    vector: VectorSettings = field(default_factory=lambda: VectorSettings(unit_range=True))

    def estimator(self, features: str):
        return NaiveBayes(featuresCol=features, smoothing=self.smoothing)
