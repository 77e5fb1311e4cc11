"""Feature checks against the label."""

from __future__ import annotations

from pyspark.sql import functions as F

from widecast import fixtures as X
from widecast.functions import columns as C
from widecast.operators import sanity as S
from widecast.registry import query
from widecast.registry.common import rounded

NUMERIC = ["cust_point", "dt_m_1085", "dt_m_1006", "dt_m_1041", "dt_m_1043", "fixed", "leak", "sparse"]
CATEGORICAL = ["brand", "product", "credit_level", "gender", "twin"]

EXTRA_SQL = f"""{X.SIGNAL_SQL},
checked AS (
  SELECT *, 1.5::DOUBLE AS fixed, CAST(substr(label, 2) AS DOUBLE) * 2 + CAST("user" AS BIGINT) % 2 * 0.01 AS leak,
         CASE WHEN CAST("user" AS BIGINT) % 1000 = 1 THEN CAST(dt_m_1006 AS DOUBLE) END AS sparse, 'twin-' || label AS twin
  FROM signal
)"""


def checked(spark, sf):
    """The signal table plus a constant, a leak, a nearly empty and a twin column."""
    key = F.col("user").cast("bigint")
    return X.signal(spark, sf).select(
        "*",
        F.lit(1.5).alias("fixed"),
        (F.substring("label", 2, 10).cast("double") * 2 + key % 2 * 0.01).alias("leak"),
        F.when(key % 1000 == 1, F.col("dt_m_1006").cast("double")).alias("sparse"),
        F.concat(F.lit("twin-"), "label").alias("twin"),
    )


def _numeric_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS feature, 'numeric' AS kind, var_samp(CAST({c} AS DOUBLE)) AS variance, "
        f"corr(CAST({c} AS DOUBLE), CAST(substr(label, 2) AS DOUBLE)) AS correlation, "
        f"CAST(NULL AS DOUBLE) AS association, 1 - count({c}) / count(*) AS missing_share FROM checked"
    )


def _categorical_sql(c: str) -> str:
    t = f"CAST({c} AS VARCHAR)"
    return f"""SELECT '{c}' AS feature, 'categorical' AS kind, CAST(NULL AS DOUBLE) AS variance, CAST(NULL AS DOUBLE) AS correlation,
  (SELECT sqrt(greatest(sum(n * n / (rn::DOUBLE * cn)) - 1, 0) / (least(count(DISTINCT v), count(DISTINCT label)) - 1))
   FROM (SELECT v, label, n, sum(n) OVER (PARTITION BY v) AS rn, sum(n) OVER (PARTITION BY label) AS cn
         FROM (SELECT {t} AS v, label, count(*) AS n FROM checked WHERE {c} IS NOT NULL GROUP BY ALL))) AS association,
  (SELECT 1 - count({c}) / count(*) FROM checked) AS missing_share"""


UNION = "\nUNION ALL\n".join([*map(_numeric_sql, NUMERIC), *map(_categorical_sql, CATEGORICAL)])


@query(
    "sanity_numeric",
    f"""WITH {EXTRA_SQL}
SELECT feature, round(variance, 4) AS variance, round(correlation, 6) AS correlation, round(missing_share, 6) AS missing_share
FROM ({chr(10).join(['', *[_numeric_sql(c) + ' UNION ALL' for c in NUMERIC]])[:-len(' UNION ALL')]}) WHERE feature <> 'fixed'""",
)
def sanity_numeric(spark, sf):
    df = S.numeric_checks(checked(spark, sf), [c for c in NUMERIC if c != "fixed"], C.class_index("label", X.SIGNAL_CLASSES))
    return df.select("feature", F.round("variance", 4).alias("variance"), rounded("correlation"), rounded("missing_share"))


@query(
    "sanity_association",
    f"""WITH {EXTRA_SQL}
SELECT feature, round(association, 6) AS association, round(missing_share, 6) AS missing_share
FROM ({' UNION ALL '.join(map(_categorical_sql, CATEGORICAL))})""",
)
def sanity_association(spark, sf):
    df = S.categorical_checks(checked(spark, sf), CATEGORICAL, "label")
    return df.select("feature", rounded("association"), rounded("missing_share"))


@query(
    "sanity_report",
    f"""WITH {EXTRA_SQL}
SELECT feature, kind, CASE WHEN missing_share > 0.99 THEN 'mostly missing'
       WHEN kind = 'numeric' AND coalesce(variance, 0) < 1e-5 THEN 'low variance'
       WHEN abs(correlation) > 0.95 AND NOT isnan(correlation) THEN 'correlated with the label'
       WHEN association > 0.95 THEN 'associated with the label' END AS reason
FROM ({UNION})""",
)
def sanity_report(spark, sf):
    report, _ = S.sanity_check(checked(spark, sf), NUMERIC, CATEGORICAL, "label", X.SIGNAL_CLASSES)
    return report.select("feature", "kind", "reason")


@query(
    "sanity_kept",
    f"""WITH {EXTRA_SQL}
SELECT "user", label, cust_point, dt_m_1085, dt_m_1006, dt_m_1041, dt_m_1043, brand, product, credit_level, gender FROM checked""",
)
def sanity_kept(spark, sf):
    """The table without the columns the checks reject."""
    df = checked(spark, sf)
    _, kept = S.sanity_check(df, NUMERIC, CATEGORICAL, "label", X.SIGNAL_CLASSES)
    return df.select("user", "label", *kept)
