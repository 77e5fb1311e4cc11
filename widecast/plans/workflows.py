"""The four packaged workflows: model search, fixed models with a stack, typed selection, scoring.

Each takes tables and gives tables or models. Settings default to the full published sizes; pass
others for a smaller run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from widecast import presets as P
from widecast.operators import evaluate as E
from widecast.operators.balanced import BalancedLearner
from widecast.operators.boost import BoostLearner
from widecast.operators.encode import VectorSettings
from widecast.operators.families import ForestLearner, LogisticLearner, VectorBayesLearner
from widecast.operators.learner import Learner, Model, label_classes
from widecast.operators.nbayes import NaiveBayesLearner
from widecast.operators.profile import profile
from widecast.operators.sample import assign_folds, cut_labels, holdout, split
from widecast.operators.sanity import SanityLimits, sanity_check
from widecast.operators.score import score_to
from widecast.operators.select import SearchResult, grid, report_all, search, select_model
from widecast.operators.stack import StackLearner, StackModel
from widecast.sources.models import load_model, save_model
from widecast.spec import TableSpec


def balanced(learner: Learner, seed: int = P.FOLD_SEED, max_size: float | None = None) -> BalancedLearner:
    return BalancedLearner(name=learner.name, inner=learner, factors=tuple(P.CLASS_FACTORS), seed=seed, max_size=max_size)


# ---------------------------------------------------------------- model search


def search_candidates(spec: TableSpec) -> list[Learner]:
    """Candidate list of the budgeted search, each balanced; order is the order of training."""
    seed = P.FOLD_SEED
    plain: list[Learner] = [
        BoostLearner(spec=spec, name="newton_1", mode="newton", rounds=50, depth=10, eta=0.1, row_rate=0.7, column_rate=0.3, seed=seed),
        LogisticLearner(spec=spec, name="logistic_1", regularization=0.05, max_iter=50),
        ForestLearner(spec=spec, name="forest_1", trees=50, depth=15, seed=seed),
        BoostLearner(spec=spec, name="gradient_1", rounds=50, depth=6, row_rate=0.8, column_rate=0.8, seed=seed),
        BoostLearner(spec=spec, name="gradient_2", rounds=50, depth=7, row_rate=0.8, column_rate=0.8, seed=seed),
        BoostLearner(spec=spec, name="gradient_3", rounds=50, depth=8, row_rate=0.8, column_rate=0.8, seed=seed),
        BoostLearner(spec=spec, name="gradient_4", rounds=50, depth=10, row_rate=0.8, column_rate=0.8, seed=seed),
        ForestLearner(spec=spec, name="forest_2", trees=100, depth=20, column_rate="sqrt", seed=seed),
        NaiveBayesLearner(spec=spec, name="bayes_1", laplace=0.1),
        LogisticLearner(spec=spec, name="logistic_2", regularization=0.1, max_iter=80),
        BoostLearner(spec=spec, name="gradient_5", rounds=120, depth=8, row_rate=0.7, column_rate=0.2, seed=seed),
        ForestLearner(spec=spec, name="forest_3", trees=200, depth=15, seed=seed),
        VectorBayesLearner(spec=spec, name="vector_bayes_1"),
    ]
    return [balanced(c, max_size=P.MAX_BALANCED_SIZE) for c in plain]


@dataclass
class SearchReport:
    profile: DataFrame
    result: SearchResult
    leaderboard: DataFrame
    leader: Model
    reports: dict[str, dict[str, DataFrame]]


def model_search(
    labelled: DataFrame,
    spec: TableSpec,
    candidates: Sequence[Learner] | None = None,
    path: str | None = None,
    max_models: int = P.MAX_MODELS,
    max_runtime_secs: float | None = P.MAX_RUNTIME_SECS,
    exclude: Sequence[str] = (),
    folds: int = P.FOLDS,
) -> SearchReport:
    """Profile, budgeted search, leaderboard; the leader and all models are saved below ``path``.

    Second-order boosting is left out of the default candidates.
    """
    spark = labelled.sparkSession
    if candidates is None:
        candidates = [c for c in search_candidates(spec) if getattr(c.inner, "mode", "") != "newton"]
    folded = assign_folds(labelled, spec.key, folds, P.FOLD_SEED)
    result = search(candidates, folded, folds, max_models, max_runtime_secs, exclude)
    reports = report_all(spark, result, f"{path}/all_models" if path else None)
    leader = result.leader.model
    if path:
        save_model(leader, f"{path}/best_model")
    return SearchReport(profile(labelled), result, result.leaderboard(spark), leader, reports)


# ---------------------------------------------------------------- fixed models and stack


def fixed_learners(spec: TableSpec) -> list[Learner]:
    """The six hand-tuned base models: each kind of boosting plain and balanced, naive Bayes, a balanced forest."""
    common = {"spec": spec, "seed": P.FOLD_SEED}
    gradient = BoostLearner(name="gradient", **common, **P.GRADIENT_SETTINGS)
    newton = BoostLearner(name="newton", mode="newton", **common, **P.NEWTON_SETTINGS)
    return [
        gradient,
        newton,
        balanced(replace(gradient, name="gradient_balanced", **P.BALANCED_GRADIENT_CHANGES)),
        NaiveBayesLearner(spec=spec, name="bayes", **P.BAYES_SETTINGS),
        balanced(ForestLearner(name="forest_balanced", **common, **P.FOREST_SETTINGS)),
        balanced(replace(newton, name="newton_balanced", **P.BALANCED_NEWTON_CHANGES)),
    ]


def stack_learner(spec: TableSpec, base: Sequence[Learner], folds: int = P.FOLDS) -> StackLearner:
    return StackLearner(spec=spec, base=tuple(base), folds=folds, seed=P.FOLD_SEED, **P.STACK_SETTINGS)


@dataclass
class StackReport:
    model: StackModel
    metrics: dict[str, dict[str, float]]
    importance: dict[str, DataFrame]


def fixed_models(
    labelled: DataFrame,
    spec: TableSpec,
    learner: StackLearner | None = None,
    path: str | None = None,
) -> StackReport:
    """Split, train all base models and the stack on the training part, measure on both parts."""
    learner = learner or stack_learner(spec, fixed_learners(spec))
    folded = assign_folds(labelled, spec.key, learner.folds, P.FOLD_SEED)
    train, test = split(folded, spec.key, P.SPLIT_SHARES, P.HOLDOUT_SEED)
    model = learner.fit(train)
    measured = {
        name: E.metrics(model.transform(part), spec.label, model.classes) for name, part in (("train", train), ("valid", test))
    }
    importance = {n: E.var_importance(m, labelled) for n, m in zip(model.names, model.base)}
    if path:
        for name, m in zip(model.names, model.base):
            save_model(m, f"{path}/{name}")
        save_model(model, f"{path}/stack")
    return StackReport(model, measured, importance)


# ---------------------------------------------------------------- typed features and selection


def typed_candidates(spec: TableSpec, vector: VectorSettings = VectorSettings(P.PIVOT_TOP_K, P.PIVOT_MIN_SUPPORT)) -> list[Learner]:
    """The 52 grid candidates: 6 logistic, 27 forest, 1 naive Bayes, 18 boosting.

    ``vector`` says how many levels of a pick list the first three keep apart; the others are pooled.
    """
    return [
        *grid(LogisticLearner(spec=spec, vector=vector), **P.LOGISTIC_GRID),
        *grid(ForestLearner(spec=spec, vector=vector, column_rate="auto"), **P.FOREST_GRID),
        *grid(VectorBayesLearner(spec=spec, vector=replace(vector, unit_range=True)), **P.VECTOR_BAYES_GRID),
        *grid(BoostLearner(spec=spec, mode="newton"), **P.BOOST_GRID),
    ]


@dataclass
class TypedReport:
    checks: DataFrame
    spec: TableSpec
    result: SearchResult
    model: Model
    scores: DataFrame
    metrics: dict[str, float]
    holdout_metrics: dict[str, float]
    cut_classes: list[str]


def typed_selection(
    labelled: DataFrame,
    spec: TableSpec,
    candidates=typed_candidates,
    folds: int = P.FOLDS,
    limits: SanityLimits = SanityLimits(),
    parallelism: int = 1,
    max_labels: int = P.MAX_LABELS,
) -> TypedReport:
    """Check features, drop bad ones, cross-validate the candidates, score and evaluate the winner.

    Rows of classes beyond the ``max_labels`` most frequent take no part in training; the report names
    those classes.
    """
    classes = label_classes(labelled, spec.label)
    checks, kept = sanity_check(labelled, spec.numeric, spec.categorical, spec.label, classes, limits)
    spec = spec.with_role("ignored", *(set(spec.predictors) - set(kept)))
    kept_rows = cut_labels(labelled, spec.label, max_labels)
    cut = sorted(set(classes) - set(label_classes(kept_rows, spec.label)))
    train, reserved = holdout(kept_rows, spec.key, P.HOLDOUT_SHARE, P.HOLDOUT_SEED)
    folded = assign_folds(train, spec.key, folds, P.HOLDOUT_SEED)
    result = select_model(candidates(spec), folded, folds, "weighted_f1", parallelism=parallelism)
    model = result.leader.model
    scores, measured = E.score_and_evaluate(model, labelled, spec.label)
    held_out = E.metrics(model.transform(reserved), spec.label, model.classes)
    return TypedReport(checks, spec, result, model, scores, measured, held_out, cut)


# ---------------------------------------------------------------- batch scoring


def batch_scoring(
    spark: SparkSession,
    model_path: str,
    to_score: DataFrame,
    probabilities_path: str,
    labels_path: str,
    key: str = P.KEY,
    single_file: bool = False,
) -> DataFrame:
    """Load a saved model of any family, export probabilities and labels, give the distribution."""
    return score_to(load_model(spark, model_path), to_score.drop(P.LABEL), key, probabilities_path, labels_path, single_file)
