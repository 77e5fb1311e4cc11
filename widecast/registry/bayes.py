"""Naive Bayes from counts to exports, with exact SQL throughout."""

from __future__ import annotations

from pyspark.sql import functions as F

from widecast import fixtures as X
from widecast.operators import evaluate as E
from widecast.operators import nbayes as B
from widecast.operators.balanced import BalancedLearner
from widecast.operators.sample import assign_folds
from widecast.operators.score import explode_probabilities, export_labels, export_probabilities, score
from widecast.operators.select import grid, oof_predict, select_model
from widecast.operators.stack import join_oof, level_one
from widecast.registry import query
from widecast.registry.common import FOLD_SEED, as_doubles, fold_sql, rounded, scratch, uniform_sql
from widecast.session import written
from widecast.sources.models import load_model, save_model
from widecast.sources.tables import read_table

K = 3
CLASSES = X.SIGNAL_CLASSES
SPEC = X.WIDE_SPEC
LEARNER = B.NaiveBayesLearner(spec=SPEC, classes=tuple(CLASSES))

FOLDED_SQL = f'{X.SIGNAL_SQL}, folded AS (SELECT *, {fold_sql(K)} AS fold FROM signal)'
# Which rows a fold model learns from and which it scores, by part number.
ONE_SPLIT = """train AS (SELECT 0 AS part, * FROM folded WHERE fold <> 0),
test AS (SELECT 0 AS part, * FROM folded WHERE fold = 0)"""
ALL_FOLDS = f"""train AS (SELECT p.part, f.* FROM folded f JOIN (SELECT unnest(range({K})) AS part) p ON f.fold <> p.part),
test AS (SELECT fold AS part, * FROM folded)"""


def _unpivot(table: str, columns, cast: str) -> str:
    return " UNION ALL ".join(
        f"SELECT part, \"user\", label, '{c}' AS feature, CAST({c} AS {cast}) AS value FROM {table} WHERE {c} IS NOT NULL"
        for c in columns
    )


def model_sql(laplace: float, suffix: str = "") -> str:
    return f"""
prior{suffix} AS (SELECT part, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY part) AS prior FROM train GROUP BY part, label),
cells{suffix} AS (SELECT part, feature, value, label, count(*) AS n FROM ({_unpivot('train', SPEC.categorical, 'VARCHAR')}) GROUP BY ALL),
totals{suffix} AS (SELECT part, feature, label, sum(n) AS t FROM cells{suffix} GROUP BY ALL),
levels{suffix} AS (SELECT DISTINCT part, feature, value FROM cells{suffix}),
n_levels{suffix} AS (SELECT part, feature, count(*) AS k FROM levels{suffix} GROUP BY ALL),
cond{suffix} AS (
  SELECT l.part, l.feature, l.value, p.label, ln((coalesce(c.n, 0) + {laplace}) / (coalesce(t.t, 0) + {laplace} * k)) AS logp
  FROM levels{suffix} l JOIN prior{suffix} p ON l.part = p.part JOIN n_levels{suffix} k ON l.part = k.part AND l.feature = k.feature
  LEFT JOIN cells{suffix} c ON c.part = l.part AND c.feature = l.feature AND c.value = l.value AND c.label = p.label
  LEFT JOIN totals{suffix} t ON t.part = l.part AND t.feature = l.feature AND t.label = p.label),
gauss{suffix} AS (SELECT part, feature, label, avg(value) AS mean, stddev_samp(value) AS sd
          FROM ({_unpivot('train', SPEC.numeric, 'DOUBLE')}) GROUP BY ALL)"""


def scores_sql(laplace: float = 0.1, suffix: str = "") -> str:
    sums = ", ".join(f"sum(s) FILTER (WHERE cls = '{c}') AS s{i}" for i, c in enumerate(CLASSES))
    best = " ".join(f"WHEN s{i} = top THEN '{c}'" for i, c in enumerate(CLASSES))
    total = " + ".join(f"exp(s{i} - top)" for i in range(len(CLASSES)))
    return f"""{model_sql(laplace, suffix)},
terms{suffix} AS (
  SELECT t.part, t."user", p.label AS cls, ln(p.prior) AS s FROM test t JOIN prior{suffix} p ON t.part = p.part
  UNION ALL
  SELECT t.part, t."user", c.label, logp FROM ({_unpivot('test', SPEC.categorical, 'VARCHAR')}) t
  JOIN cond{suffix} c ON t.part = c.part AND t.feature = c.feature AND t.value = c.value
  UNION ALL
  SELECT t.part, t."user", g.label,
         -0.5 * ln(2 * pi() * greatest(sd, 0.001) * greatest(sd, 0.001))
         - (value - mean) * (value - mean) / (2 * greatest(sd, 0.001) * greatest(sd, 0.001))
  FROM ({_unpivot('test', SPEC.numeric, 'DOUBLE')}) t JOIN gauss{suffix} g ON t.part = g.part AND t.feature = g.feature),
scores{suffix} AS (SELECT "user", {sums} FROM terms{suffix} GROUP BY "user"),
topped{suffix} AS (SELECT *, greatest({', '.join(f's{i}' for i in range(len(CLASSES)))}) AS top FROM scores{suffix}),
scored{suffix} AS (
  SELECT "user", {', '.join(f's{i}' for i in range(len(CLASSES)))}, CASE {best} END AS predict,
         {', '.join(f'exp(s{i} - top) / ({total}) AS p{i}' for i in range(len(CLASSES)))}
  FROM topped{suffix})"""


ROUNDED_P = ", ".join(f"round(p{i}, 6) AS p{i}" for i in range(len(CLASSES)))


def folded(spark, sf):
    return assign_folds(X.signal(spark, sf), "user", K, FOLD_SEED)


def _train(spark, sf):
    return folded(spark, sf).filter("fold <> 0")


def _scored(spark, sf):
    df = folded(spark, sf)
    return score(LEARNER.fit(df.filter("fold <> 0")), df.filter("fold = 0"))


@query("nb_class_priors", f"WITH {FOLDED_SQL}, {ONE_SPLIT}, {model_sql(0.1)} SELECT label, n, round(prior, 6) AS prior FROM prior")
def nb_class_priors(spark, sf):
    return B.class_priors(_train(spark, sf), "label").select("label", "n", rounded("prior"))


@query(
    "nb_conditionals",
    f"WITH {FOLDED_SQL}, {ONE_SPLIT}, {model_sql(0.1)} SELECT feature, value, label, round(logp, 6) AS logp FROM cond",
)
def nb_conditionals(spark, sf):
    cond = B.conditionals(B.level_counts(_train(spark, sf), "label", SPEC.categorical), CLASSES, 0.1)
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col("logs")[i].alias("logp")) for i, c in enumerate(CLASSES)])
    return cond.select("feature", "value", F.explode(pairs).alias("p")).select("feature", "value", "p.label", rounded(F.col("p.logp"), "logp"))


@query(
    "nb_moments",
    f"WITH {FOLDED_SQL}, {ONE_SPLIT}, {model_sql(0.1)} SELECT feature, label, round(mean, 6) AS mean, round(sd, 6) AS sd FROM gauss",
)
def nb_moments(spark, sf):
    return B.moments(_train(spark, sf), "label", SPEC.numeric).select("feature", "label", rounded("mean"), rounded("sd"))


@query(
    "nb_score",
    f"""WITH {FOLDED_SQL}, {ONE_SPLIT}, {scores_sql()}
SELECT "user", {', '.join(f'round(s{i}, 6) AS s{i}' for i in range(5))} FROM scored""",
)
def nb_score(spark, sf):
    model = LEARNER.fit(_train(spark, sf))
    df = model.log_scores(folded(spark, sf).filter("fold = 0"))
    return df.select("user", *[rounded(F.col("log_scores")[i], f"s{i}") for i in range(5)])


@query(
    "nb_probabilities",
    f'WITH {FOLDED_SQL}, {ONE_SPLIT}, {scores_sql()} SELECT "user", predict, {ROUNDED_P} FROM scored',
)
def nb_probabilities(spark, sf):
    return _scored(spark, sf).select("user", "predict", *as_doubles("probabilities", 5))


@query(
    "nb_saved_and_loaded",
    f'WITH {FOLDED_SQL}, {ONE_SPLIT}, {scores_sql()} SELECT "user", predict, {ROUNDED_P} FROM scored',
)
def nb_saved_and_loaded(spark, sf):
    path = scratch(spark)
    save_model(LEARNER.fit(_train(spark, sf)), path)
    df = load_model(spark, path).transform(folded(spark, sf).filter("fold = 0"))
    return df.select("user", "predict", *as_doubles("probabilities", 5))


@query(
    "nb_export_probabilities",
    f"""WITH {FOLDED_SQL}, {ONE_SPLIT}, {scores_sql()}
SELECT "user", {', '.join(f'round(p{i}, 6) AS "{i}"' for i in range(5))} FROM scored""",
)
def nb_export_probabilities(spark, sf):
    path = scratch(spark)
    export_probabilities(_scored(spark, sf), "user", CLASSES, path)
    schema = "user string, " + ", ".join(f"`{i}` double" for i in range(5))
    df = read_table(spark, path, "csv", schema, header=False)
    return df.select("user", *[F.round(f"`{i}`", 6).alias(str(i)) for i in range(5)])


@query("export_labels", f'WITH {FOLDED_SQL}, {ONE_SPLIT}, {scores_sql()} SELECT "user", predict FROM scored')
def nb_export_labels(spark, sf):
    path = scratch(spark)
    export_labels(_scored(spark, sf), "user", path)
    return read_table(spark, path, "csv", "user string, predict string", header=False)


@query(
    "nb_distribution",
    f'WITH {FOLDED_SQL}, {ONE_SPLIT}, {scores_sql()} SELECT predict, count(*) AS "count" FROM scored GROUP BY predict',
)
def nb_distribution(spark, sf):
    return E.prediction_distribution(_scored(spark, sf))


@query(
    "nb_confusion",
    f"""WITH {FOLDED_SQL}, {ONE_SPLIT}, {scores_sql()}
SELECT t.label, {', '.join(f"nullif(count(*) FILTER (WHERE predict = '{c}'), 0) AS {c}" for c in CLASSES)}
FROM test t JOIN scored s ON t."user" = s."user" GROUP BY t.label""",
)
def nb_confusion(spark, sf):
    df = folded(spark, sf)
    return E.evaluate(LEARNER.fit(df.filter("fold <> 0")), df.filter("fold = 0"), "label")


@query(
    "nb_unlabelled",
    f"""WITH {X.WIDE_SQL}, train AS (SELECT 0 AS part, * FROM wide WHERE label IS NOT NULL),
test AS (SELECT 0 AS part, * FROM wide WHERE label IS NULL), {scores_sql().replace("'c0'", "'1-URGENT'").replace("'c1'", "'2-HIGH'").replace("'c2'", "'3-MEDIUM'").replace("'c3'", "'4-NOT SPECIFIED'").replace("'c4'", "'5-LOW'")}
SELECT "user", {ROUNDED_P} FROM scored""",
)
def nb_unlabelled(spark, sf):
    """Learn from the labelled rows, score the rows without a label."""
    from widecast.operators.prep import split_by_label

    to_score, labelled = split_by_label(X.wide(spark, sf), "label")
    df = score(B.NaiveBayesLearner(spec=SPEC).fit(labelled), to_score)
    return df.select("user", *as_doubles("probabilities", 5))


BALANCE = (1.0, 1.0, 0.2, 1.0, 1.0)
CORRECTED = [f"p{i} * b.b{i} / a.a{i}" for i in range(5)]
BALANCED_SQL = f"""WITH {FOLDED_SQL}, before AS (SELECT * FROM folded WHERE fold <> 0),
train AS (SELECT 0 AS part, * FROM before WHERE label <> 'c2' OR {uniform_sql('"user"', 'balance', 42)} < 0.2::DOUBLE),
test AS (SELECT 0 AS part, * FROM folded WHERE fold = 0), {scores_sql()},
b AS (SELECT {', '.join(f"count(*) FILTER (WHERE label = '{c}') / count(*) AS b{i}" for i, c in enumerate(CLASSES))} FROM before),
a AS (SELECT {', '.join(f"count(*) FILTER (WHERE label = '{c}') / count(*) AS a{i}" for i, c in enumerate(CLASSES))} FROM train)
SELECT "user", {', '.join(f'round({c} / ({" + ".join(CORRECTED)}), 6) AS p{i}' for i, c in enumerate(CORRECTED))} FROM scored, a, b"""


@query("nb_balanced", BALANCED_SQL)
def nb_balanced(spark, sf):
    """Trained on resampled classes, with the class shares restored in the probabilities."""
    df = folded(spark, sf)
    model = BalancedLearner(name="balanced", inner=LEARNER, factors=BALANCE).fit(df.filter("fold <> 0"))
    return model.transform(df.filter("fold = 0")).select("user", *as_doubles("probabilities", 5))


@query(
    "nb_oof",
    f"""WITH {FOLDED_SQL}, {ALL_FOLDS}, {scores_sql()}
SELECT s."user", CAST(f.fold AS INTEGER) AS fold, predict, {ROUNDED_P} FROM scored s JOIN folded f ON s."user" = f."user\"""",
)
def nb_oof(spark, sf):
    df, _ = oof_predict(LEARNER, written(folded(spark, sf), "folded"), K)  # read by every fold
    return df.select("user", "fold", "predict", *as_doubles("probabilities", 5))


TWO = grid(B.NaiveBayesLearner(spec=SPEC, name="nb", classes=tuple(CLASSES)), laplace=[0.1, 50.0])
LEVEL_SQL = f"""WITH {FOLDED_SQL}, {ALL_FOLDS}, {scores_sql(0.1)}, {scores_sql(50.0, 'b')}
SELECT a."user", f.label, {', '.join(f'round(a.p{i}, 6) AS a{i}' for i in range(5))}, {', '.join(f'round(b.p{i}, 6) AS b{i}' for i in range(5))}
FROM scored a JOIN scoredb b ON a."user" = b."user" JOIN folded f ON a."user" = f."user\""""


def _level_columns(df):
    columns = [c for c in df.columns if "_p" in c]
    return df.select("user", "label", *[rounded(F.col(f"`{c}`"), f"{'ab'[i // 5]}{i % 5}") for i, c in enumerate(columns)])


@query("level_one_table", LEVEL_SQL)
def level_one_table(spark, sf):
    return _level_columns(level_one(TWO, folded(spark, sf), K, ["user", "label"]))


@query("level_one_joined", LEVEL_SQL)
def level_one_joined(spark, sf):
    """The same table from stored out-of-fold tables, joined on the key."""
    df = written(folded(spark, sf), "folded")  # read by every learner and fold
    stored = {}
    for learner in TWO:
        path = scratch(spark)
        oof_predict(learner, df, K, keep=["user", "label"])[0].write.parquet(path)
        stored[learner.name] = spark.read.parquet(path)
    return _level_columns(join_oof(stored, "user", ["user", "label"], 5))


GRID = [0.1, 50.0]
GRID_SQL = f"""WITH {FOLDED_SQL}, {ALL_FOLDS}, {scores_sql(GRID[0])}, {scores_sql(GRID[1], 'b')},
measured AS (
  SELECT 'nb[laplace={GRID[0]}]' AS model_id, f.label, predict, {', '.join(f'p{i}' for i in range(5))} FROM scored s JOIN folded f ON s."user" = f."user"
  UNION ALL
  SELECT 'nb[laplace={GRID[1]}]', f.label, predict, {', '.join(f'p{i}' for i in range(5))} FROM scoredb s JOIN folded f ON s."user" = f."user"
),
per_class AS (
  SELECT model_id, label, count(*) AS support, count(*) FILTER (WHERE predict = label) / count(*) AS recall FROM measured GROUP BY ALL),
overall AS (
  SELECT model_id, count(*) FILTER (WHERE predict = label) / count(*) AS accuracy,
         avg(-ln(least(greatest(CASE label {' '.join(f"WHEN '{c}' THEN p{i}" for i, c in enumerate(CLASSES))} END, 1e-15), 1))) AS logloss
  FROM measured GROUP BY 1),
board AS (
  SELECT o.model_id, e.mean_per_class_error, logloss, accuracy
  FROM overall o JOIN (SELECT model_id, avg(1 - recall) AS mean_per_class_error FROM per_class GROUP BY 1) e ON o.model_id = e.model_id)
SELECT CAST(row_number() OVER (ORDER BY logloss, model_id) AS INTEGER) AS rank, model_id, round(mean_per_class_error, 6) AS mean_per_class_error,
       round(logloss, 6) AS logloss, round(accuracy, 6) AS accuracy FROM board"""


@query("nb_grid_selection", GRID_SQL)
def nb_grid_selection(spark, sf):
    """A parameter grid cross-validated and ranked."""
    result = select_model(TWO, folded(spark, sf), K, sort_by="logloss", refit=False)
    board = result.leaderboard(spark)
    return board.select("rank", "model_id", *[rounded(m) for m in ("mean_per_class_error", "logloss", "accuracy")])
