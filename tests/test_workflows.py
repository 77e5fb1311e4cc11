from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_prep import raw_table

from widecast import presets as P
from widecast.operators.boost import BoostLearner
from widecast.operators.nbayes import NaiveBayesLearner
from widecast.operators.stack import StackLearner
from widecast.plans.preparation import derive, prepare, with_products
from widecast.plans.workflows import balanced, batch_scoring, fixed_models, model_search, stack_learner, typed_selection
from widecast.registry.training import stack_score
from widecast.session import ensure_checkpoint_dir
from widecast.streaming.scoring import export_stream, score_stream, stream_distribution


@pytest.fixture(scope="module")
def parts(spark):
    return prepare(with_products(derive(raw_table(spark, 300)).persist()))


def test_search_then_scoring(spark, parts, tmp_path):
    spec = P.typed_spec()
    bayes = NaiveBayesLearner(spec=spec, name="bayes")
    report = model_search(parts.labelled, spec, [bayes, balanced(replace(bayes, name="balanced"))], str(tmp_path), folds=2)
    assert report.leaderboard.count() == 2 and report.profile.count() == len(parts.labelled.columns)
    counts = batch_scoring(
        spark, str(tmp_path / "best_model"), parts.to_score, str(tmp_path / "p"), str(tmp_path / "l"), single_file=True
    )
    assert counts.agg(F.sum("count")).first()[0] == parts.to_score.count()
    assert spark.read.csv(str(tmp_path / "p")).columns == [f"_c{i}" for i in range(6)]
    assert spark.read.csv(str(tmp_path / "l")).count() == parts.to_score.count()


def test_fixed_models(spark, parts, tmp_path):
    spec = P.typed_spec()
    base = [NaiveBayesLearner(spec=spec, name="bayes"), BoostLearner(spec=spec, name="gradient", rounds=1, depth=2, column_rate=0.2)]
    learner = replace(stack_learner(spec, base, folds=2), rounds=1, depth=2)
    report = fixed_models(parts.labelled, spec, learner, str(tmp_path))
    assert set(report.metrics) == {"train", "valid"} and set(report.importance) == {"bayes", "gradient"}
    assert report.model.transform(parts.to_score).count() == parts.to_score.count()


def test_stack_score_trains_at_the_packaged_sizes(spark, tmp_path, monkeypatch):
    """The query's ensemble has all rounds, trees, depths and folds, no column or row sample, and all labelled rows."""
    orders = spark.range(40).selectExpr(
        "id AS o_orderkey", "id % 4 AS o_custkey", "1000.0D * id AS o_totalprice", "'5-LOW' AS o_orderpriority", "'F' AS o_orderstatus", "DATE '1996-01-02' AS o_orderdate"
    )
    customer = spark.range(4).selectExpr("id AS c_custkey", "CAST(id AS INT) AS c_nationkey", "'BUILDING' AS c_mktsegment", "1.0D * id AS c_acctbal")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    customer.write.parquet(str(tmp_path / "customer.parquet"))
    fits = []

    class Fitted(Exception):
        pass

    def fit(self, df):
        fits.append((self, df))
        raise Fitted

    monkeypatch.setattr(StackLearner, "fit", fit)
    with pytest.raises(Fitted):
        stack_score(spark, str(tmp_path))
    [(learner, rows)] = fits
    bayes, gbm, forest = learner.base
    assert learner.folds == P.FOLDS and {s: getattr(learner, s) for s in P.STACK_SETTINGS} == P.STACK_SETTINGS
    assert (bayes.family, gbm.family, forest.family) == ("naive_bayes", "boost", "forest")
    assert (gbm.rounds, gbm.depth) == (P.GRADIENT_SETTINGS["rounds"], P.GRADIENT_SETTINGS["depth"])
    assert (gbm.row_rate, gbm.column_rate) == (1, 1)
    assert (forest.trees, forest.depth) == (P.FOREST_SETTINGS["trees"], P.FOREST_SETTINGS["depth"])
    assert rows.count() == 40 and {r["fold"] for r in rows.collect()} == set(range(P.FOLDS))


def test_typed_selection(parts):
    def candidates(spec):
        return [NaiveBayesLearner(spec=spec, name="a"), NaiveBayesLearner(spec=spec, name="b", laplace=1.0)]

    report = typed_selection(parts.labelled, P.typed_spec(), candidates, folds=2)
    assert report.checks.count() == 64 and report.cut_classes == []
    assert set(report.spec.predictors) <= set(P.typed_spec().predictors)
    assert report.scores.count() == parts.labelled.count()
    assert 0 <= report.holdout_metrics["weighted_f1"] <= 1


def test_typed_selection_names_the_classes_it_cuts(parts):
    def candidates(spec):
        return [NaiveBayesLearner(spec=spec, name="a")]

    counts = {r["label"]: r["count"] for r in parts.labelled.groupBy(P.LABEL).count().withColumnRenamed(P.LABEL, "label").collect()}
    rarest = sorted(counts, key=lambda c: (-counts[c], c))[-1]
    report = typed_selection(parts.labelled, P.typed_spec(), candidates, folds=2, max_labels=len(counts) - 1)
    assert report.cut_classes == [rarest] and report.model.classes == sorted(set(counts) - {rarest})


def test_streaming_equals_batch(spark, parts, tmp_path):
    model = NaiveBayesLearner(spec=P.typed_spec()).fit(parts.labelled)
    source = str(tmp_path / "in")
    parts.to_score.repartition(3).write.parquet(source)
    stream = score_stream(model, spark.readStream.schema(parts.to_score.schema).parquet(source))
    export_stream(stream, "user", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    batch = {r["user"]: r["predict"] for r in model.transform(parts.to_score).collect()}
    assert {r["user"]: r["predict"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
    query = stream_distribution(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("count")).first()[0] == len(batch)


def test_checkpoint_folder_comes_from_the_session(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
