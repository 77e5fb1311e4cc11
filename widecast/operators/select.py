"""Out-of-fold prediction, parameter grids, cross-validated selection and budgeted search."""

from __future__ import annotations

import itertools
import re
import threading
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from widecast.operators import evaluate as E
from widecast.operators.learner import PREDICT, PROBABILITIES, Learner, Model, label_classes
from widecast.operators.prepared import Preparations
from widecast.session import concurrently, written
from widecast.sources.models import save_model

FOLD = "fold"
#: Names of the rows that a shared input was prepared from, beside the numbers of folds left out.
ALL, FOLDS = "all", "folds"


class TimeBudget:
    """Ends the Spark jobs of counted work when the time is over, and those it starts after that."""

    def __init__(self, spark: SparkSession, seconds: float | None) -> None:
        self.context, self.seconds = spark.sparkContext, seconds
        self.tag = f"budget-{uuid.uuid4().hex}"
        self.over = seconds is not None and seconds <= 0
        self.done = threading.Event()

    def __enter__(self) -> TimeBudget:
        if self.seconds is not None:
            threading.Thread(target=self.watch, daemon=True).start()
        return self

    def __exit__(self, *_: object) -> None:
        self.done.set()

    def watch(self) -> None:
        if self.done.wait(max(0.0, self.seconds)):
            return
        self.over = True
        while not self.done.wait(0.2):
            self.context.cancelJobsWithTag(self.tag)

    @contextmanager
    def counted(self) -> Iterator[None]:
        """Work of this thread, and of threads it starts, that ends with the budget."""
        self.context.addJobTag(self.tag)
        try:
            yield
        finally:
            self.context.removeJobTag(self.tag)


def fold_models(
    learner: Learner, df: DataFrame, k: int, fold: str = FOLD, parallelism: int = 1, shared: Preparations | None = None
) -> list[Model]:
    """One model per fold, fitted on the other folds; from one pass where the family can do that.

    ``shared`` has the inputs that other learners prepared from the same rows.
    """
    shared = shared or Preparations()
    if hasattr(learner, "fit_folds"):
        with shared.using((FOLDS, learner.preparation()), lambda: learner.prepare(df, fold), learner.release) as prepared:
            return learner.models(prepared, list(range(k)))
    fits = [partial(shared.fit, learner, df.filter(F.col(fold) != i), i) for i in range(k)]
    return concurrently(df.sparkSession, fits, parallelism)


def expect_uses(shared: Preparations, learner: Learner, k: int, refit: bool) -> None:
    """Announce what ``fold_models``, and a fit on all rows, will use."""
    for part in [FOLDS] if hasattr(learner, "fit_folds") else range(k):
        shared.expect(learner, part)
    if refit:
        shared.expect(learner, ALL)


def oof_predict(
    learner: Learner, df: DataFrame, k: int, fold: str = FOLD, keep: Sequence[str] | None = None, parallelism: int = 1, shared: Preparations | None = None
) -> tuple[DataFrame, list[Model]]:
    """Every row scored by a model that did not see its fold, and the ``k`` fold models."""
    models = fold_models(learner, df, k, fold, parallelism, shared)
    parts = []
    for i, model in enumerate(models):
        scored = model.transform(df.filter(F.col(fold) == i))
        parts.append(scored.select(*keep, PREDICT, PROBABILITIES) if keep else scored)
    return reduce(DataFrame.unionByName, parts), models


def grid(learner: Learner, **choices: Sequence[Any]) -> list[Learner]:
    """One learner per combination of settings, the last setting varying fastest."""
    names = list(choices)
    out = []
    for values in itertools.product(*choices.values()):
        tag = ",".join(f"{n}={v}" for n, v in zip(names, values))
        out.append(replace(learner, name=f"{learner.name}[{tag}]" if tag else learner.name, **dict(zip(names, values))))
    return out


def grid_table(spark: SparkSession, candidates: Iterable[Learner]) -> DataFrame:
    """(position, model_id, family, params) of a candidate list."""
    rows = [(i, c.name, c.family, {k: str(v) for k, v in c.params().items()}) for i, c in enumerate(candidates)]
    return spark.createDataFrame(rows, "position int, model_id string, family string, params map<string,string>")


@dataclass
class Trained:
    """A candidate after cross-validation, and after the refit on all rows if it was refitted."""

    learner: Learner
    measured: dict[str, float]
    oof: DataFrame | None = None
    fold_models: list[Model] = field(default_factory=list)
    model: Model | None = None


@dataclass
class SearchResult:
    classes: list[str]
    trained: list[Trained]
    sort_by: str
    stopped_by: str = "candidates"
    prepared: Counter = field(default_factory=Counter)  # how often each shared input was made

    def measured(self, spark: SparkSession) -> DataFrame:
        rows = [(t.learner.name, *(float(t.measured[m]) for m in E.METRICS)) for t in self.trained]
        return spark.createDataFrame(rows, "model_id string, " + ", ".join(f"{m} double" for m in E.METRICS))

    def leaderboard(self, spark: SparkSession) -> DataFrame:
        return E.leaderboard(self.measured(spark), self.sort_by)

    @property
    def leader(self) -> Trained:
        sign = -1 if self.sort_by in E.HIGHER_IS_BETTER else 1
        return min(self.trained, key=lambda t: (sign * t.measured[self.sort_by], t.learner.name))


def cross_validate(
    learner: Learner, df: DataFrame, k: int, label: str, classes: Sequence[str], key: str, fold: str = FOLD, shared: Preparations | None = None
) -> Trained:
    """Metrics out of fold. The scored rows are stored once; metrics and later users read that table."""
    oof, models = oof_predict(learner, df, k, fold, keep=[key, label, fold], shared=shared)
    stored = written(oof, "oof")
    return Trained(learner, E.metrics(stored, label, classes), stored, models)


def with_known_classes(learner: Learner, classes: Sequence[str]) -> Learner:
    """The learner told which classes there are, so that it need not look in every fold."""
    if hasattr(learner, "inner"):
        return replace(learner, inner=with_known_classes(learner.inner, classes))
    if hasattr(learner, "classes") and learner.classes is None:
        return replace(learner, classes=tuple(classes))
    return learner


def select_model(
    candidates: Sequence[Learner],
    df: DataFrame,
    k: int,
    sort_by: str = "weighted_f1",
    fold: str = FOLD,
    parallelism: int = 1,
    refit: bool = True,
) -> SearchResult:
    """Cross-validate all candidates and refit the best on all rows.

    Folds must be in ``df``. Candidates run as concurrent Spark jobs, ``parallelism`` at a time.
    """
    return search(
        candidates, df, k, max_models=len(candidates), sort_by=sort_by, fold=fold, parallelism=parallelism, refit="leader" if refit else "none"
    )


def search(
    candidates: Sequence[Learner],
    df: DataFrame,
    nfolds: int,
    max_models: int | None = None,
    max_runtime_secs: float | None = None,
    exclude: Iterable[str] = (),
    sort_by: str = "mean_per_class_error",
    fold: str = FOLD,
    keep_oof: bool = True,
    keep_fold_models: bool = True,
    refit: str = "all",
    parallelism: int = 1,
) -> SearchResult:
    """Train candidates in order until the model or time budget, if any, is used up.

    Families in ``exclude`` are left out. Inputs that several candidates prepare alike are made once. When
    the time is over, running jobs are ended and the candidates finished by then are the result.
    """
    if refit not in ("all", "leader", "none"):
        raise ValueError(f"unknown refit {refit!r}")
    excluded = set(exclude)
    chosen = [c for c in candidates if c.family not in excluded and getattr(getattr(c, "inner", c), "family") not in excluded]
    if not chosen:
        raise ValueError("no candidate left to train")
    names = [c.name for c in chosen]
    if len(set(names)) < len(names):
        raise ValueError("candidate names must differ")
    label, key = chosen[0].spec.label, chosen[0].spec.key

    def run(learner: Learner) -> Trained | None:
        if budget.over:
            return None
        try:
            with budget.counted():
                t = cross_validate(learner, labelled, nfolds, label, classes, key, fold, shared)
                if refit == "all":
                    t.model = shared.fit(learner, labelled, ALL)
        except Exception:
            if budget.over:  # its jobs were ended
                return None
            raise
        if not keep_oof:
            t.oof = None
        if not keep_fold_models:
            t.fold_models = []
        return t

    shared = Preparations()
    with TimeBudget(df.sparkSession, max_runtime_secs) as budget:
        try:
            with budget.counted():
                # Stored, since every candidate and fold reads the rows several times.
                labelled = written(df.filter(F.col(label).isNotNull()), "labelled")
                classes = label_classes(labelled, label)
        except Exception:
            if budget.over:
                raise ValueError("the time budget ended before the first model") from None
            raise
        first = [with_known_classes(c, classes) for c in chosen[:max_models]]
        for learner in first:
            expect_uses(shared, learner, nfolds, refit == "all")
        try:
            done = concurrently(df.sparkSession, [partial(run, c) for c in first], parallelism)
        finally:
            shared.close()
    trained = [t for t in done if t is not None]
    if not trained:
        raise ValueError("the time budget ended before the first model")
    stopped = "time" if len(trained) < len(first) else "models" if len(first) < len(chosen) else "candidates"
    result = SearchResult(classes, trained, sort_by, stopped, shared.made)
    if refit == "leader":
        result.leader.model = result.leader.learner.fit(labelled)
    return result


def summary(spark: SparkSession, model: Model, **metric_sets: dict[str, float]) -> DataFrame:
    """(key, value) rows: family, classes, settings, and the metrics given by name
    (``train=...``, ``valid=...``, ``cross_validation=...``)."""
    rows = [("family", model.family), ("classes", ", ".join(model.classes))]
    rows += [(f"param.{k}", str(v)) for k, v in sorted(model.params.items())]
    for name, values in metric_sets.items():
        rows += [(f"{name}.{k}", str(v)) for k, v in values.items()]
    return spark.createDataFrame(rows, "key string, value string")


def train_and_validate(learner: Learner, train: DataFrame, valid: DataFrame) -> tuple[Model, dict[str, dict[str, float]]]:
    """Fit, and measure on the training and the validation rows."""
    model = learner.fit(train)
    label = learner.spec.label
    return model, {n: E.metrics(model.transform(t), label, model.classes) for n, t in (("train", train), ("valid", valid))}


def folder_name(model_id: str) -> str:
    """A model name as a folder name; brackets and the like would be read as path patterns."""
    return re.sub(r"[^A-Za-z0-9_.=-]+", "_", model_id).strip("_")


def report_all(spark: SparkSession, result: SearchResult, path: str | None = None) -> dict[str, dict[str, DataFrame]]:
    """Summary and variable importance of every refitted model; each is saved below ``path``."""
    out = {}
    for t in result.trained:
        if t.model is None:
            continue
        out[t.learner.name] = {
            "summary": summary(spark, t.model, cross_validation=t.measured),
            "importance": E.scaled_importance(t.model.importance(spark)),
        }
        if path:
            save_model(t.model, f"{path}/{folder_name(t.learner.name)}")
    return out
