"""What the candidates of a search share, and how its time budget ends them."""

import threading
import time
from dataclasses import dataclass, replace
from typing import ClassVar

import numpy as np
import pytest
from pyspark.sql import functions as F

from widecast import fixtures as X
from widecast.operators.boost import BoostLearner
from widecast.operators.families import ForestLearner, LogisticLearner
from widecast.operators.learner import Learner
from widecast.operators.nbayes import NaiveBayesLearner
from widecast.operators.prepared import Preparations
from widecast.operators.sample import assign_folds
from widecast.operators.select import ALL, FOLDS, cross_validate, expect_uses, grid, search
from widecast.operators.stack import StackLearner, level_one
from widecast.plans.workflows import typed_candidates
from widecast.presets import typed_spec

SPEC = X.WIDE_SPEC
CLASSES = tuple(X.SIGNAL_CLASSES)
BAYES = NaiveBayesLearner(spec=SPEC, classes=CLASSES)
BOOST = BoostLearner(spec=SPEC, classes=CLASSES, rounds=1, depth=2, max_bins=10)


@pytest.fixture(scope="module")
def table(spark, small):
    return assign_folds(X.signal(spark, small), "user", 3, 1).persist()


def test_52_candidates_need_fifteen_inputs():
    """Vectors, scaled vectors and bins for each of five folds; every one of the 260 fits uses one of them."""
    shared = Preparations()
    candidates = typed_candidates(typed_spec())
    for c in candidates:
        expect_uses(shared, c, 5, refit=False)
    assert len(candidates) == 52 and len(shared.users) == 15 and sum(shared.users.values()) == 52 * 5


def test_candidates_share_inputs(spark, table):
    forest = ForestLearner(spec=SPEC, classes=CLASSES, trees=2, depth=2)
    logistic = LogisticLearner(spec=SPEC, classes=CLASSES, max_iter=2)
    candidates = [forest, logistic, *grid(BOOST, depth=[1, 2]), BAYES]
    table.count()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    result = search(candidates, table, 3, refit="all")
    assert len(result.trained) == 5 and set(result.prepared.values()) == {1}
    parts = [part for part, _ in result.prepared]
    assert sorted(map(str, parts)) == sorted(map(str, [0, 1, 2, ALL, 0, 1, 2, ALL, FOLDS, ALL]))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    for t in result.trained[2:3]:
        alone = cross_validate(t.learner, table, 3, "label", CLASSES, "user")
        assert t.measured == pytest.approx(alone.measured)
        own, other = ({r["user"]: np.round(r["probabilities"], 9).tolist() for r in m.transform(table).collect()} for m in (t.model, t.learner.fit(table)))
        assert own == other


def test_out_of_fold_rows_are_stored_and_scored_once(spark, table, monkeypatch):
    """No model scores after cross-validation: metrics and later reads come from the stored table."""
    scored = []
    transform = type(BAYES.fit(table)).transform
    monkeypatch.setattr("widecast.operators.nbayes.NaiveBayesModel.transform", lambda self, df: scored.append(1) or transform(self, df))
    result = search([BAYES], table, 3, refit="none")
    oof = result.trained[0].oof
    assert len(scored) == 3
    assert oof.columns == ["user", "label", "fold", "predict", "probabilities"] and oof.count() == table.count()
    assert all(f.startswith("file:") and "/oof-" in f for f in oof.inputFiles())
    assert oof.filter(F.col("predict") == F.col("label")).count() / oof.count() == pytest.approx(result.trained[0].measured["accuracy"])


def test_base_learners_of_a_stack_share_inputs(spark, table, monkeypatch):
    made = []
    prepare = BoostLearner.prepare
    monkeypatch.setattr(BoostLearner, "prepare", lambda self, df: made.append(self.name) or prepare(self, df))
    rows = level_one([BOOST, replace(BOOST, name="second", mode="newton")], table, 3, ["user", "label"])
    assert len(made) == 3 and rows.count() == table.count()


def test_folds_of_a_base_learner_run_side_by_side(spark, table):
    """Each fit waits until those of the other folds have begun; the models are those of one fit after the other."""
    begun = threading.Barrier(3, timeout=120)

    @dataclass(frozen=True, kw_only=True)
    class WaitingLearner(BoostLearner):
        def prepare(self, df):
            begun.wait()
            return super().prepare(df)

    own = {f: getattr(BOOST, f) for f in ("spec", "classes", "rounds", "depth", "max_bins")}
    by_parallelism = [
        {r["user"]: np.round(r[2:], 9).tolist() for r in level_one([learner], table, 3, ["user", "label"], parallelism=n).collect()}
        for learner, n in ((WaitingLearner(**own), 3), (BOOST, 1))
    ]
    assert by_parallelism[0] == by_parallelism[1] and len(by_parallelism[0]) == table.count()


@pytest.mark.parametrize("job", ["search", "level_one", "stack"])
def test_source_rows_are_made_once(spark, table, job):
    """Folds and learners read stored rows; the plan that made them runs once."""
    made = spark.sparkContext.accumulator(0)
    counting = F.udf(lambda v: made.add(1) or v, "string").asNondeterministic()
    source = table.filter("fold < 2") if job == "stack" else table
    rows = source.withColumn("label", counting("label"))
    if job == "search":
        search([BAYES, replace(BAYES, name="second", laplace=3.0)], rows, 3, refit="none")
    elif job == "level_one":
        assert level_one([BAYES, replace(BAYES, name="second", laplace=3.0)], rows, 3, ["user", "label"]).count() == table.count()
    else:
        StackLearner(spec=SPEC, base=(BAYES, replace(BOOST, rounds=1)), folds=2, rounds=1, depth=1).fit(rows)
    assert made.value == source.count()


@dataclass(frozen=True, kw_only=True)
class SlowLearner(Learner):
    family: ClassVar[str] = "slow"
    spec: object = SPEC
    name: str = "slow"

    def fit(self, df):
        def sleep_long(batches):
            time.sleep(600)
            yield from batches

        df.sparkSession.range(2, numPartitions=2).mapInPandas(sleep_long, "id bigint").count()
        raise AssertionError("the job should have been ended")


def test_the_time_budget_ends_running_work(spark, table):
    start = time.monotonic()
    search([BAYES], table, 3, refit="none")
    budget = 1.5 * (time.monotonic() - start) + 5
    start = time.monotonic()
    result = search([BAYES, SlowLearner(), replace(BAYES, name="late")], table, 3, max_runtime_secs=budget, refit="none")
    took = time.monotonic() - start
    assert result.stopped_by == "time" and took < budget + 15
    assert [t.learner.name for t in result.trained] == ["naive_bayes"]
    # The session goes on, also with jobs of the same kind.
    assert spark.range(10).count() == 10


def test_other_errors_are_not_taken_for_the_budget(spark, table):
    class Failing(SlowLearner):
        def fit(self, df):
            raise RuntimeError("no fit")

    with pytest.raises(RuntimeError, match="no fit"):
        search([Failing()], table, 3, max_runtime_secs=100)


def test_an_input_is_released_after_its_last_use():
    shared, released = Preparations(), []
    shared.users["k"] = 2
    for last in (False, True):
        with shared.using("k", lambda: "made", released.append) as value:
            assert value == "made" and not released
        assert bool(released) is last
    with pytest.raises(ZeroDivisionError):
        with shared.using("other", lambda: 1 / 0, released.append):
            pass
    shared.users["left"] = 5
    with shared.using("left", lambda: "left", released.append):
        pass
    shared.close()
    assert released == ["made", "left"] and shared.made == {"k": 1, "left": 1}
