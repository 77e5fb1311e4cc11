"""Training on resampled classes, with the class shares put right again in the probabilities."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from widecast.functions import columns as C
from widecast.operators.learner import PREDICT, PROBABILITIES, Learner, Model, label_classes
from widecast.operators.nbayes import class_priors
from widecast.operators.sample import balance, capped_factors, class_factors, restore_prior
from widecast.sources.models import load_model, read_meta, write_meta


class PriorCorrectedModel(Model):
    family = "prior_corrected"

    def __init__(self, inner: Model, prior: list[float], trained_prior: list[float], params: dict[str, Any]):
        self.inner = inner
        self.classes = inner.classes
        self.prior = prior
        self.trained_prior = trained_prior
        self.params = params

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.inner.transform(df).withColumn(
            PROBABILITIES, restore_prior(F.col(PROBABILITIES), self.prior, self.trained_prior)
        )
        return scored.withColumn(PREDICT, C.class_of_largest(F.col(PROBABILITIES), self.classes))

    def importance(self, spark: SparkSession) -> DataFrame:
        return self.inner.importance(spark)

    def save(self, path: str) -> None:
        meta = {"family": self.family, "prior": self.prior, "trained_prior": self.trained_prior, "params": self.params}
        write_meta(SparkSession.active(), path, meta)
        self.inner.save(f"{path}/inner")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PriorCorrectedModel:
        m = read_meta(spark, path)
        return cls(load_model(spark, f"{path}/inner"), m["prior"], m["trained_prior"], m["params"])


@dataclass(frozen=True, kw_only=True)
class BalancedLearner(Learner):
    """Any learner, fitted on rows resampled by one factor per class (in alphabetical class order)."""

    family: ClassVar[str] = "balanced"
    name: str
    inner: Learner
    factors: tuple[float, ...]
    max_size: float | None = None
    seed: int = 42
    correct_prior: bool = True

    @property
    def spec(self):
        return self.inner.spec

    def params(self) -> dict[str, Any]:
        return {
            **self.inner.params(),
            "name": self.name,
            "factors": list(self.factors),
            "max_size": self.max_size,
            "balance_seed": self.seed,
        }

    def fit(self, df: DataFrame) -> Model:
        spec = self.inner.spec
        classes = list(self.inner.classes or label_classes(df, spec.label))
        labelled = df.filter(F.col(spec.label).isNotNull())
        factors = class_factors(classes, self.factors)
        if self.max_size is not None:
            factors = capped_factors(labelled, spec.label, factors, self.max_size)
        balanced = balance(labelled, spec.label, factors, spec.key, self.seed)
        model = self.inner.fit(balanced)
        if not self.correct_prior:
            return model
        before, after = (
            {r["label"]: r["prior"] for r in class_priors(t, spec.label).collect()} for t in (labelled, balanced)
        )
        gone = [c for c in classes if not after.get(c)]
        if gone:
            raise ValueError(f"resampling left no row of {gone}: raise their factors")
        return PriorCorrectedModel(model, [before[c] for c in classes], [after[c] for c in classes], self.params())
