import os
import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from widecast import fixtures as X
from widecast.functions import columns as C
from widecast.operators import evaluate as E
from widecast.operators.balanced import BalancedLearner
from widecast.operators.boost import BoostLearner
from widecast.operators.families import ForestLearner, LogisticLearner, VectorBayesLearner
from widecast.operators.nbayes import NaiveBayesLearner, merge_moments
from widecast.operators.sample import assign_folds
from widecast.operators.select import folder_name, grid, grid_table, oof_predict, report_all, search, summary, train_and_validate
from widecast.operators.stack import StackLearner
from widecast.operators.walk import BINS
from widecast.plans.workflows import fixed_learners, search_candidates, typed_candidates
from widecast.sources.models import load_model, save_model

SPEC = X.WIDE_SPEC
CLASSES = tuple(X.SIGNAL_CLASSES)
BOOST = BoostLearner(spec=SPEC, classes=CLASSES, rounds=3, depth=2, eta=0.3, max_bins=20)
LEARNERS = [
    NaiveBayesLearner(spec=SPEC, classes=CLASSES),
    BOOST,
    replace(BOOST, name="newton", mode="newton"),
    ForestLearner(spec=SPEC, classes=CLASSES, trees=5, depth=4),
    LogisticLearner(spec=SPEC, classes=CLASSES, max_iter=30, regularization=0.001),
    BalancedLearner(name="balanced", inner=NaiveBayesLearner(spec=SPEC, classes=CLASSES), factors=(1.0, 1.0, 0.2, 1.0, 1.0)),
    VectorBayesLearner(spec=SPEC, classes=CLASSES),
]


@pytest.fixture(scope="module")
def table(spark, small):
    return assign_folds(X.signal(spark, small), "user", 3, 1).persist()


def scored(df):
    return {r["user"]: (r["predict"], tuple(np.round(r["probabilities"], 8))) for r in df.collect()}


@pytest.mark.parametrize("learner", LEARNERS, ids=lambda x: x.name)
def test_family(learner, spark, table, tmp_path):
    """Probabilities add up, the signal is found, saving changes nothing, unseen equals missing."""
    train, test = table.filter("fold <> 0"), table.filter("fold = 0")
    model = learner.fit(train)
    out = model.transform(test.drop("label"))
    assert set(test.columns) - {"label"} < set(out.columns) and not [c for c in out.columns if c.startswith("__")]
    assert out.selectExpr("max(abs(aggregate(probabilities, 0D, (a, p) -> a + p) - 1)) AS off").first()["off"] < 1e-9
    accuracy = E.metrics(model.transform(test), "label", CLASSES)["accuracy"]
    assert accuracy > (0.2 if learner.name == "vector_bayes" else 0.5)
    save_model(model, str(tmp_path / "m"))
    assert scored(load_model(spark, str(tmp_path / "m")).transform(test)) == scored(out)
    unseen = model.transform(test.withColumn("credit_level", F.lit(999)).withColumn("brand", F.lit("never seen")))
    missing = model.transform(test.withColumn("credit_level", F.lit(None).cast("int")).withColumn("brand", F.lit(None).cast("string")))
    if learner.name in ("naive_bayes", "boost", "newton", "balanced"):
        assert scored(unseen) == scored(missing)


def test_merge_moments():
    rng = np.random.default_rng(1)
    parts = [rng.normal(1e6, 3, n) for n in (5, 1, 40)]
    whole = np.concatenate(parts)
    mean, sd = merge_moments([(len(p), p.mean(), p.var(ddof=1) if len(p) > 1 else None) for p in parts] + [(0, None, None)])
    assert mean == pytest.approx(whole.mean()) and sd == pytest.approx(whole.std(ddof=1))
    assert merge_moments([(0, None, None)]) == (None, None)


def test_fold_models_equal_separate_fits(table):
    learner = LEARNERS[0]
    together, _ = oof_predict(learner, table, 3)
    apart = learner.fit(table.filter("fold <> 1")).transform(table.filter("fold = 1"))
    assert scored(together.filter("fold = 1")) == scored(apart)


def test_loss_falls_with_rounds(table):
    losses = []
    for rounds in (1, 4):
        model = replace(BOOST, rounds=rounds).fit(table)
        losses.append(E.metrics(model.transform(table), "label", CLASSES)["logloss"])
    assert losses[1] < losses[0] < np.log(5)


@pytest.mark.parametrize("mode", ["gradient", "newton"])
def test_boosting_ignores_placement_and_storing(table, mode):
    """Partition count and the interval at which margins are stored change nothing."""
    learner = replace(BOOST, mode=mode, row_rate=0.7, column_rate=0.5)
    a = learner.fit(table).transform(table)
    b = replace(learner, checkpoint_interval=1).fit(table.repartition(5)).transform(table)
    assert scored(a) == scored(b)


def test_newton_leaves(spark, table):
    """Leaves of the first round are -G / (H + lambda) of the rows that reach them."""
    model = replace(BOOST, mode="newton", rounds=1, eta=1.0, reg_lambda=0.0).fit(table)
    rows = model.binner.transform(table).select(BINS, C.class_index("label", CLASSES).alias("y")).collect()
    bins = np.array([r[BINS] for r in rows])
    y = np.array([r["y"] for r in rows])
    prior = np.exp(model.prior)
    assert prior.sum() == pytest.approx(1)
    for tree in model.trees:
        node = tree.nodes(bins, model.depth)
        p = prior[tree.klass]
        for leaf in np.unique(node):
            here = node == leaf
            g, h = (p - (y[here] == tree.klass)).sum(), here.sum() * p * (1 - p)
            assert tree.value[leaf] == pytest.approx(-g / h)
            assert tree.rows[leaf] == here.sum()


def test_splits_are_the_best_of_all(table):
    """The root split of every class has the largest gain found by brute force over all bins."""
    model = replace(BOOST, rounds=1, depth=1, min_rows=1).fit(table)
    rows = model.binner.transform(table).select(BINS, C.class_index("label", CLASSES).alias("y")).collect()
    bins, y = np.array([r[BINS] for r in rows]), np.array([r["y"] for r in rows])
    prior = np.exp(model.prior)
    for tree in model.trees:
        g = prior[tree.klass] - (y == tree.klass)
        best = 0.0
        for j in range(len(SPEC.numeric)):
            for b in range(bins[:, j].max()):
                for missing_left in (True, False):
                    left = (bins[:, j] <= b) & ((bins[:, j] > 0) | missing_left)
                    if 0 < left.sum() < len(y):
                        gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(y)
                        best = max(best, gain)
        for j in range(len(SPEC.numeric), bins.shape[1]):
            levels = np.unique(bins[:, j])
            order = sorted(levels, key=lambda b: g[bins[:, j] == b].mean())
            for i in range(1, len(order)):
                left = np.isin(bins[:, j], order[:i])
                gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(y)
                best = max(best, gain)
        assert tree.gain[0] == pytest.approx(best)


def test_workers_need_no_package(tmp_path, small):
    """Boosting from a folder where the workers cannot import this package."""
    root = Path(__file__).resolve().parent.parent
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
from widecast import fixtures as X
from widecast.operators.boost import BoostLearner
from widecast.session import local_session
spark = local_session(2)
df = X.signal(spark, {small!r})
model = BoostLearner(spec=X.WIDE_SPEC, rounds=2, depth=1, checkpoint_interval=1).fit(df)
print("rows", model.transform(df).filter("predict IS NOT NULL").toArrow().num_rows)
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300
    )
    assert "rows 1500" in done.stdout, done.stderr[-2000:]


def test_annealing_shrinks_later_steps(table):
    plain, cooled = (replace(BOOST, rounds=2, annealing=a).fit(table) for a in (1.0, 0.5))
    assert np.allclose(plain.trees[0].value, cooled.trees[0].value)
    assert np.allclose(plain.trees[5].value, 2 * cooled.trees[5].value)


def test_metrics_equal_the_library(spark, small):
    df = X.predictions(spark, small)
    ours = E.metrics(df, "label", X.PRIORITIES)
    indexed = df.select(
        C.class_index("label", X.PRIORITIES).alias("label"), C.class_index("predict", X.PRIORITIES).alias("prediction")
    )
    for name, ml in (("weighted_f1", "f1"), ("accuracy", "accuracy")):
        assert ours[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=ml).evaluate(indexed))


def test_search_budgets(spark, table, tmp_path):
    candidates = [LEARNERS[3], *grid(NaiveBayesLearner(spec=SPEC, name="nb"), laplace=[0.1, 1.0, 5.0])]
    result = search(candidates, table, 3, max_models=2, exclude=["forest"])
    assert [t.learner.name for t in result.trained] == ["nb[laplace=0.1]", "nb[laplace=1.0]"]
    assert result.stopped_by == "models"
    board = result.leaderboard(spark).collect()
    assert [r["rank"] for r in board] == [1, 2] and board[0]["model_id"] == result.leader.learner.name
    assert all(len(t.fold_models) == 3 and t.oof.count() == table.count() for t in result.trained)
    reports = report_all(spark, result, str(tmp_path))
    assert set(reports) == {t.learner.name for t in result.trained}
    assert load_model(spark, str(tmp_path / folder_name("nb[laplace=0.1]"))).classes == list(CLASSES)
    with pytest.raises(ValueError, match="time budget"):
        search(candidates, table, 3, max_runtime_secs=-1)
    with pytest.raises(ValueError, match="no candidate"):
        search(candidates, table, 3, exclude=["forest", "naive_bayes"])
    parallel = search(candidates[1:3], table, 3, parallelism=2, refit="none")
    assert [t.measured for t in parallel.trained] == [t.measured for t in result.trained]


def test_importance(spark, table):
    for learner in (BOOST, LEARNERS[3], LEARNERS[4]):
        rows = E.var_importance(learner.fit(table), table).collect()
        assert {r["variable"] for r in rows} == set(SPEC.predictors)
        assert sum(r["share"] for r in rows) == pytest.approx(1) and rows[0]["scaled"] == 1
    assert E.var_importance(LEARNERS[0].fit(table), table).count() == 0


def test_summary_and_validation(spark, table):
    model, measured = train_and_validate(LEARNERS[0], table.filter("fold <> 0"), table.filter("fold = 0"))
    rows = {r["key"]: r["value"] for r in summary(spark, model, **measured).collect()}
    assert rows["family"] == "naive_bayes" and "valid.logloss" in rows and "train.accuracy" in rows


def test_stack(spark, table, tmp_path):
    base = (LEARNERS[0], replace(BOOST, name="gbm", rounds=1))
    model = StackLearner(spec=SPEC, base=base, folds=3, rounds=3, depth=2, eta=0.5).fit(table)
    out = model.transform(table)
    assert E.metrics(out, "label", CLASSES)["accuracy"] > 0.7
    save_model(model, str(tmp_path / "stack"))
    assert scored(load_model(spark, str(tmp_path / "stack")).transform(table)) == scored(out)


@pytest.mark.parametrize("learner", [LEARNERS[0], replace(BOOST, name="gbm", rounds=1)], ids=["bayes", "boost"])
def test_permutation_importance_in_one_plan(table, learner):
    """Each feature's value is that of a run of its own, and the scored plan has no branch for a feature."""
    model = learner.fit(table)
    features = SPEC.predictors[:3]
    got = {r["variable"]: r["importance"] for r in E.permutation_importance(model, table, SPEC.key, SPEC.label, features).collect()}
    mixed = E.permuted(table.filter(F.col(SPEC.label).isNotNull()), SPEC.key, features, 1).persist()
    base = E.metrics(model.transform(mixed.select(table.columns)), SPEC.label, model.classes)["logloss"]
    for f in features:
        changed = mixed.withColumn(f, F.col(f"__shuffled_{f}")).select(table.columns)
        assert got[f] == pytest.approx(E.metrics(model.transform(changed), SPEC.label, model.classes)["logloss"] - base, abs=1e-9)
    plans = [model.transform(E.variants(mixed, table.columns, features[:n]))._jdf.queryExecution().optimizedPlan().toString() for n in (1, 3)]
    assert plans[0].count("Join") == plans[1].count("Join") and "Union" not in plans[1]


def test_candidate_lists(spark):
    families = [c.family for c in typed_candidates(SPEC)]
    assert {f: families.count(f) for f in set(families)} == {"logistic": 6, "forest": 27, "vector_bayes": 1, "boost": 18}
    assert grid_table(spark, typed_candidates(SPEC)).select("model_id").distinct().count() == 52
    assert [c.name for c in fixed_learners(SPEC)] == [
        "gradient", "newton", "gradient_balanced", "bayes", "forest_balanced", "newton_balanced"
    ]
    assert len({c.name for c in search_candidates(SPEC)}) == 13
