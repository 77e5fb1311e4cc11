"""Stacked ensemble: a meta-learner on the out-of-fold probabilities of the base learners."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from widecast.operators.boost import BoostLearner
from widecast.operators.learner import PREDICT, PROBABILITIES, Learner, Model, label_classes
from widecast.operators.prepared import Preparations
from widecast.operators.select import ALL, FOLD, FOLDS, expect_uses, fold_models, with_known_classes
from widecast.session import concurrently, cut_lineage, written
from widecast.sources.models import load_model, read_meta, write_meta
from widecast.spec import TableSpec


def probability_columns(names: Sequence[str], n_classes: int) -> list[str]:
    """Level-one column names: base model and class position."""
    return [f"{name}_p{i}" for name in names for i in range(n_classes)]


def append_base(df: DataFrame, names: Sequence[str], models: Sequence[Model], keep: Sequence[str]) -> DataFrame:
    """The rows with one probability column per base model and class, in one pass."""
    arrays = [f"__base{j}" for j in range(len(models))]
    for array, model in zip(arrays, models):
        df = model.transform(df).withColumnRenamed(PROBABILITIES, array).drop(PREDICT)
    columns = [
        F.col(array)[i].alias(c)
        for array, name, model in zip(arrays, names, models)
        for i, c in enumerate(probability_columns([name], len(model.classes)))
    ]
    return df.select(*keep, *columns)


def level_one(
    base: Sequence[Learner], df: DataFrame, k: int, keep: Sequence[str], fold: str = FOLD, parallelism: int = 1
) -> DataFrame:
    """Out-of-fold probabilities of all base learners side by side.

    All base models of one fold score its rows in the same pass, so no join by key is needed. The rows
    are stored first, since every base learner and fold reads them several times.
    """
    stored = written(df, "folded")
    by_learner, _ = fitted(base, stored, k, fold, parallelism, refit=False)
    return level_one_of_models(base, by_learner, stored, keep, fold)


def level_one_of_models(base: Sequence[Learner], by_learner: Sequence[Sequence[Model]], df: DataFrame, keep: Sequence[str], fold: str) -> DataFrame:
    """The rows of each fold, scored by its models of all base learners."""
    names = [b.name for b in base]
    parts = [append_base(df.filter(F.col(fold) == i), names, models, keep) for i, models in enumerate(zip(*by_learner))]
    return reduce(DataFrame.unionByName, parts)


def fitted(base: Sequence[Learner], df: DataFrame, k: int, fold: str, parallelism: int, refit: bool) -> tuple[list[list[Model]], list[Model]]:
    """The fold models of every base learner and, with ``refit``, its model of all rows.

    Every fit is a task of its own, so that the folds of a slow learner run side by side. Tasks go fold by
    fold: an input that several learners share is given up before those of later folds are made.
    """
    shared = Preparations()
    for b in base:
        expect_uses(shared, b, k, refit)
    at_once = [hasattr(b, "fit_folds") for b in base]
    tasks = {(j, FOLDS): partial(fold_models, b, df, k, fold, shared=shared) for j, b in enumerate(base) if at_once[j]}
    for part in [*range(k), *([ALL] if refit else [])]:
        rows = df if part == ALL else df.filter(F.col(fold) != part)
        tasks |= {(j, part): partial(shared.fit, b, rows, part) for j, b in enumerate(base) if part == ALL or not at_once[j]}
    try:
        models = dict(zip(tasks, concurrently(df.sparkSession, list(tasks.values()), parallelism)))
    finally:
        shared.close()
    by_learner = [models[j, FOLDS] if at_once[j] else [models[j, i] for i in range(k)] for j in range(len(base))]
    return by_learner, [models[j, ALL] for j in range(len(base))] if refit else []


def join_oof(tables: Mapping[str, DataFrame], key: str, keep: Sequence[str], n_classes: int) -> DataFrame:
    """The level-one table from out-of-fold tables stored before, joined on the key.

    All joins use one key, so each table is exchanged once.
    """
    joined = None
    for name, t in tables.items():
        columns = [F.col(PROBABILITIES)[i].alias(c) for i, c in enumerate(probability_columns([name], n_classes))]
        side = t.select(key, *([c for c in keep if c != key] if joined is None else []), *columns)
        joined = side if joined is None else joined.join(side, key)
    return joined


class StackModel(Model):
    family = "stack"

    def __init__(self, names: list[str], base: list[Model], meta: Model, params: dict[str, Any]):
        self.names = names
        self.base = base
        self.meta = meta
        self.classes = meta.classes
        self.params = params

    def transform(self, df: DataFrame) -> DataFrame:
        level = append_base(df, self.names, self.base, df.columns)
        return self.meta.transform(level).drop(*probability_columns(self.names, len(self.classes)))

    def save(self, path: str) -> None:
        write_meta(SparkSession.active(), path, {"family": self.family, "names": self.names, "params": self.params})
        for i, m in enumerate(self.base):
            m.save(f"{path}/base{i}")
        self.meta.save(f"{path}/meta_model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StackModel:
        m = read_meta(spark, path)
        base = [load_model(spark, f"{path}/base{i}") for i in range(len(m["names"]))]
        return cls(m["names"], base, load_model(spark, f"{path}/meta_model"), m["params"])


@dataclass(frozen=True, kw_only=True)
class StackLearner(Learner):
    """``fit`` needs the fold column in the table; all base learners share it."""

    family: ClassVar[str] = "stack"
    spec: TableSpec
    base: tuple[Learner, ...]
    folds: int
    name: str = "stack"
    fold: str = FOLD
    classes: tuple[str, ...] | None = None
    rounds: int = 50
    depth: int = 4
    eta: float = 0.1
    annealing: float = 0.99
    seed: int = 42
    parallelism: int = 1

    def params(self) -> dict[str, Any]:
        plain = ("name", "folds", "rounds", "depth", "eta", "annealing", "seed")
        return {**{p: getattr(self, p) for p in plain}, "base": [b.name for b in self.base]}

    def meta_learner(self, classes: Sequence[str]) -> BoostLearner:
        columns = probability_columns([b.name for b in self.base], len(classes))
        return BoostLearner(
            spec=TableSpec.build(self.spec.key, self.spec.label, real=columns),
            classes=tuple(classes),
            rounds=self.rounds,
            depth=self.depth,
            eta=self.eta,
            annealing=self.annealing,
            seed=self.seed,
        )

    def fit(self, df: DataFrame) -> StackModel:
        label = self.spec.label
        # Stored, since every base learner and fold reads the rows several times.
        labelled = written(df.filter(F.col(label).isNotNull()), "labelled")
        classes = list(self.classes or label_classes(labelled, label))
        base = [with_known_classes(b, classes) for b in self.base]
        by_learner, models = fitted(base, labelled, self.folds, self.fold, self.parallelism, refit=True)
        # Stored, since it stands on all fold models of all base learners.
        table = cut_lineage(level_one_of_models(base, by_learner, labelled, [self.spec.key, label], self.fold))
        meta = self.meta_learner(classes).fit(table)
        return StackModel([b.name for b in base], models, meta, self.params())
