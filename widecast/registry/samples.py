"""Splits, folds and class balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from widecast import fixtures as X
from widecast.operators import sample as S
from widecast.registry import query
from widecast.registry.common import FOLD_SEED, SPLIT_SEED, fold_sql, hash_sql, rounded, uniform_sql

KEY = '"user"'
FACTORS = dict(zip(X.PRIORITIES, (1.0, 1.0, 0.2, 1.0, 1.0)))
UP_FACTORS = dict(zip(X.PRIORITIES, (3.0, 1.0, 0.2, 4.5, 2.3)))


def _labelled(spark, sf):
    return X.wide(spark, sf).filter(F.col("label").isNotNull())


def _factor_sql(factors: dict[str, float]) -> str:
    return "CASE label " + " ".join(f"WHEN '{c}' THEN {f}::DOUBLE" for c, f in factors.items()) + " END"


@query(
    "split_parts",
    f"""WITH {X.WIDE_SQL}, s AS (SELECT *, {hash_sql(KEY, 'split', SPLIT_SEED)} AS step FROM wide)
SELECT "user", label, CASE WHEN step < 3435973837 THEN 'train' ELSE 'test' END AS part FROM s""",
)
def split_parts(spark, sf):
    train, test = S.split(X.wide(spark, sf), "user", [0.8, 0.2], SPLIT_SEED)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).select("user", "label", "part")


@query(
    "holdout_split",
    f"""WITH {X.WIDE_SQL}
SELECT "user", label FROM wide WHERE {hash_sql(KEY, 'split', SPLIT_SEED)} >= 3435973837 AND label IS NOT NULL""",
)
def holdout_split(spark, sf):
    return S.holdout(_labelled(spark, sf), "user", 0.2, SPLIT_SEED)[1].select("user", "label")


@query(
    "rare_split",
    f"""WITH {X.WIDE_SQL}
SELECT "user", label FROM wide WHERE {hash_sql(KEY, 'split', SPLIT_SEED)} >= 4293249309""",
)
def rare_split(spark, sf):
    """A share far below one thousandth."""
    return S.split(X.wide(spark, sf), "user", [0.9996, 0.0004], SPLIT_SEED)[1].select("user", "label")


@query(
    "label_cut",
    """WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
k AS (SELECT c_nationkey FROM (SELECT *, sum(n) OVER () AS total FROM n) WHERE n >= 0.035 * total
      ORDER BY n DESC, CAST(c_nationkey AS VARCHAR) LIMIT 10)
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM k)""",
)
def label_cut(spark, sf):
    customer = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return S.cut_labels(customer, "nation", max_labels=10, min_share=0.035)


@query("fold_assign", f'WITH {X.WIDE_SQL} SELECT "user", CAST({fold_sql(5)} AS INTEGER) AS fold FROM wide')
def fold_assign(spark, sf):
    return S.assign_folds(X.wide(spark, sf), "user", 5, FOLD_SEED).select("user", "fold")


def _balance_sql(factors: dict[str, float], scale: str = "1.0") -> str:
    return f"""f AS (SELECT *, {_factor_sql(factors)} * {scale} AS f, {uniform_sql(KEY, 'balance', SPLIT_SEED)} AS u FROM labelled),
c AS (SELECT *, CAST(floor(f) AS INTEGER) + CASE WHEN u < f - floor(f) THEN 1 ELSE 0 END AS copies FROM f)
SELECT "user", label, CAST(i AS INTEGER) AS copy FROM c, LATERAL (SELECT unnest(range(1, copies + 1)) AS i)"""


LABELLED = f"{X.WIDE_SQL}, labelled AS (SELECT * FROM wide WHERE label IS NOT NULL)"


@query("balance_down", f"WITH {LABELLED}, {_balance_sql(FACTORS)}")
def balance_down(spark, sf):
    return S.balance(_labelled(spark, sf), "label", FACTORS, "user", SPLIT_SEED, "copy").select("user", "label", "copy")


@query("balance_up", f"WITH {LABELLED}, {_balance_sql(UP_FACTORS)}")
def balance_up(spark, sf):
    return S.balance(_labelled(spark, sf), "label", UP_FACTORS, "user", SPLIT_SEED, "copy").select("user", "label", "copy")


@query(
    "balance_cap",
    f"""WITH {LABELLED},
n AS (SELECT label, count(*) AS n FROM labelled GROUP BY 1),
t AS (SELECT sum(n) AS total, sum(n * {_factor_sql(UP_FACTORS)}) AS planned FROM n)
SELECT label, n, round({_factor_sql(UP_FACTORS)} * least(1.0, 1.5 * total / planned), 6) AS factor FROM n, t""",
)
def balance_cap(spark, sf):
    df = _labelled(spark, sf)
    capped = S.capped_factors(df, "label", UP_FACTORS, 1.5)
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return S.balance_weights(counts, "label", capped, "factor").select("label", "n", rounded("factor"))


@query("balance_weights", f"WITH {LABELLED} SELECT \"user\", label, {_factor_sql(FACTORS)} AS weight FROM labelled")
def balance_weights(spark, sf):
    return S.balance_weights(_labelled(spark, sf), "label", FACTORS).select("user", "label", "weight")


@query(
    "row_sample",
    f"""WITH {X.WIDE_SQL}
{' UNION ALL '.join(f'SELECT "user", {r} AS round FROM wide WHERE {uniform_sql(KEY, f"round{r}", SPLIT_SEED)} < 0.7' for r in range(3))}""",
)
def row_sample(spark, sf):
    """The rows of three boosting rounds."""
    df = X.wide(spark, sf)
    parts = [S.row_sample(df, "user", 0.7, SPLIT_SEED, r).select("user", F.lit(r).alias("round")) for r in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
