"""Metrics, confusion matrices and leaderboards on stored predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from widecast import fixtures as X
from widecast.operators import evaluate as E
from widecast.registry import query
from widecast.registry.common import rounded

CLASSES = X.PRIORITIES
LOSS_SQL = f"-ln(least(greatest(CASE label {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN p{i}' for i, c in enumerate(CLASSES))} END, 1e-15), 1))"
MODELS = 4


def _matrix_sql(cell: str) -> str:
    cells = ", ".join(cell.format(f"count(*) FILTER (WHERE predict = '{c}')") + f' AS "{c}"' for c in CLASSES)
    return f"WITH {X.PREDICTIONS_SQL} SELECT label, {cells} FROM predictions GROUP BY label"


@query("confusion_matrix", _matrix_sql("nullif({}, 0)"))
def confusion_matrix(spark, sf):
    return E.confusion_matrix(X.predictions(spark, sf), "label", CLASSES)


@query("confusion_matrix_zero", _matrix_sql("{}"))
def confusion_matrix_zero(spark, sf):
    return E.confusion_matrix(X.predictions(spark, sf), "label", CLASSES, fill_zero=True)


@query("prediction_distribution", f'WITH {X.PREDICTIONS_SQL} SELECT predict, count(*) AS "count" FROM predictions GROUP BY predict')
def prediction_distribution(spark, sf):
    return E.prediction_distribution(X.predictions(spark, sf))


def class_sql(source: str, by: str = "") -> str:
    """Per-class support, precision, recall and F1 of ``source`` (label, predict), as a CTE chain."""
    b = f"{by}, " if by else ""
    on = f"USING ({b}cls)"
    return f"""act AS (SELECT {b}label AS cls, count(*) AS support, count(*) FILTER (WHERE predict = label) AS hits FROM {source} GROUP BY ALL),
cho AS (SELECT {b}predict AS cls, count(*) AS chosen FROM {source} GROUP BY ALL),
per AS (SELECT {b}cls, coalesce(support, 0) AS support, CASE WHEN chosen > 0 THEN coalesce(hits, 0) / chosen ELSE 0 END AS pr,
               CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re FROM act FULL JOIN cho {on}),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM per)"""


@query(
    "class_metrics",
    f"""WITH {X.PREDICTIONS_SQL}, {class_sql('predictions')}
SELECT cls AS class, support, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f1, 6) AS f1 FROM f""",
)
def class_metrics(spark, sf):
    pairs = E.pair_counts(X.predictions(spark, sf), "label", CLASSES)
    return E.class_metrics(pairs).select("class", "support", rounded("precision"), rounded("recall"), rounded("f1"))


@query("weighted_f1", f"WITH {X.PREDICTIONS_SQL}, {class_sql('predictions')} SELECT round(sum(support * f1) / sum(support), 6) AS weighted_f1 FROM f")
def weighted_f1(spark, sf):
    return E.metrics_table(X.predictions(spark, sf), "label", CLASSES).select(rounded("weighted_f1"))


@query("log_loss", f"WITH {X.PREDICTIONS_SQL} SELECT round(avg({LOSS_SQL}), 6) AS logloss FROM predictions")
def log_loss(spark, sf):
    return E.metrics_table(X.predictions(spark, sf), "label", CLASSES).select(rounded("logloss"))


# Four stand-in models: model m predicts the class m places further on for every (m + 2)th user.
MODELS_SQL = f"""{X.PREDICTIONS_SQL},
models AS (
  SELECT 'model_' || m AS model_id, label, {', '.join(f'p{i}' for i in range(5))},
         CASE WHEN CAST("user" AS BIGINT) % (m + 2) = 0 THEN label ELSE predict END AS predict
  FROM predictions, (SELECT unnest(range({MODELS})) AS m)
),
{class_sql('models', 'model_id')},
board AS (
  SELECT model_id, round(avg(1 - re) FILTER (WHERE support > 0), 6) AS mean_per_class_error, round(sum(support * f1) / sum(support), 6) AS weighted_f1
  FROM f GROUP BY model_id),
whole AS (
  SELECT model_id, count(*) AS "rows", round(avg({LOSS_SQL}), 6) AS logloss, round(avg(CAST(predict = label AS INTEGER)), 6) AS accuracy
  FROM models GROUP BY model_id)"""
BOARD_COLUMNS = "model_id, mean_per_class_error, logloss, weighted_f1, accuracy"


def _measured(spark, sf):
    numbers = F.explode(F.sequence(F.lit(0), F.lit(MODELS - 1)))
    df = X.predictions(spark, sf).withColumn("m", numbers).withColumn("model_id", F.concat(F.lit("model_"), F.col("m").cast("string")))
    df = df.withColumn("predict", F.when(F.col("user").cast("bigint") % (F.col("m") + 2) == 0, F.col("label")).otherwise(F.col("predict")))
    return E.metrics_table(df, "label", CLASSES, by=["model_id"])


def _rounded(df):
    return df.withColumns({m: F.round(m, 6) for m in E.METRICS})


@query(
    "metrics_by_model",
    f'WITH {MODELS_SQL} SELECT {BOARD_COLUMNS}, "rows" FROM board JOIN whole USING (model_id)',
)
def metrics_by_model(spark, sf):
    return _rounded(_measured(spark, sf)).select("model_id", *E.METRICS, "rows")


@query(
    "leaderboard",
    f"""WITH {MODELS_SQL}
SELECT CAST(row_number() OVER (ORDER BY mean_per_class_error, model_id) AS INTEGER) AS rank, {BOARD_COLUMNS} FROM board JOIN whole USING (model_id)""",
)
def leaderboard(spark, sf):
    return _rounded(E.leaderboard(_measured(spark, sf)))


@query(
    "leader",
    f"WITH {MODELS_SQL} SELECT CAST(1 AS INTEGER) AS rank, {BOARD_COLUMNS} FROM board JOIN whole USING (model_id) ORDER BY weighted_f1 DESC, model_id LIMIT 1",
)
def leader(spark, sf):
    return _rounded(E.leader(_measured(spark, sf), "weighted_f1"))
