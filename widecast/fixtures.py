"""Derived test tables, each as a Spark builder and as the equal SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from widecast.sources.tables import read_table
from widecast.spec import TableSpec

# Event types behind the visit columns, in column order.
VISIT_TYPES = ["click", "view", "error", "signup", "purchase"]
VISIT_COLUMNS = [f"app{i}_visits" for i in range(1, len(VISIT_TYPES) + 1)]

# Order priorities, which are the classes of the wide table.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

WIDE_SPEC = TableSpec.build(
    "user",
    "label",
    real=["cust_point", "dt_m_1085"],
    integral=["dt_m_1006", "dt_m_1041", "dt_m_1043"],
    picklist=["credit_level", "gender", "brand", "product"],
    ignored=["opened"],
)


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with its customer's attributes; a tenth of the labels is missing."""
    orders = read_table(spark, f"{sf}/orders.parquet")
    customer = read_table(spark, f"{sf}/customer.parquet")
    key = F.col("o_orderkey")
    level = F.floor(F.col("o_totalprice") / 1000).cast("int")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.cast("string").alias("user"),
        F.when(key % 10 != 3, F.col("o_orderpriority")).alias("label"),
        F.when(key % 17 != 0, F.col("c_nationkey")).alias("credit_level"),
        (F.col("o_custkey") % 2).cast("int").alias("gender"),
        F.col("c_mktsegment").alias("brand"),
        F.col("o_orderstatus").alias("product"),
        (F.col("o_totalprice") / 20).alias("cust_point"),
        level.alias("dt_m_1041"),
        F.when(key % 13 != 0, level + (F.col("o_custkey") % 50).cast("int")).alias("dt_m_1043"),
        (F.col("o_custkey") % 30).cast("int").alias("dt_m_1006"),
        F.col("c_acctbal").alias("dt_m_1085"),
        F.col("o_orderdate").alias("opened"),
    )


WIDE_SQL = """
wide AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS "user",
         CASE WHEN o_orderkey % 10 <> 3 THEN o_orderpriority END AS label,
         CASE WHEN o_orderkey % 17 <> 0 THEN c_nationkey END AS credit_level,
         CAST(o_custkey % 2 AS INTEGER) AS gender,
         c_mktsegment AS brand,
         o_orderstatus AS product,
         o_totalprice / 20 AS cust_point,
         CAST(floor(o_totalprice / 1000) AS INTEGER) AS dt_m_1041,
         CASE WHEN o_orderkey % 13 <> 0
              THEN CAST(floor(o_totalprice / 1000) AS INTEGER) + CAST(o_custkey % 50 AS INTEGER) END AS dt_m_1043,
         CAST(o_custkey % 30 AS INTEGER) AS dt_m_1006,
         c_acctbal AS dt_m_1085,
         o_orderdate AS opened
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table with a label that follows the price, a tenth of it shifted by one class."""
    base = wide(spark, sf)
    step = F.least(F.floor(F.col("cust_point") * 20 / 100000), F.lit(4))
    noisy = F.when(F.col("user").cast("bigint") % 10 == 7, (step + 1) % 5).otherwise(step)
    return base.withColumn("label", F.concat(F.lit("c"), noisy.cast("string")))


SIGNAL_CLASSES = ["c0", "c1", "c2", "c3", "c4"]

SIGNAL_SQL = f"""{WIDE_SQL},
signal AS (
  SELECT * REPLACE ('c' || CAST(
           CASE WHEN CAST("user" AS BIGINT) % 10 = 7
                THEN (least(CAST(floor(cust_point * 20 / 100000) AS BIGINT), 4) + 1) % 5
                ELSE least(CAST(floor(cust_point * 20 / 100000) AS BIGINT), 4) END AS VARCHAR) AS label)
  FROM wide
)"""


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user: large visits by type, unknown for every eleventh user."""
    events = read_table(spark, f"{sf}/events.parquet")
    counts = [
        F.sum(F.when((F.col("event_type") == t) & (F.col("value") > 150), 1).otherwise(0)).alias(c)
        for t, c in zip(VISIT_TYPES, VISIT_COLUMNS)
    ]
    return (
        events.groupBy("user_id")
        .agg(*counts)
        .select(
            F.col("user_id").cast("string").alias("user"),
            *[F.when(F.col("user_id") % 11 != 0, F.col(c)).cast("int").alias(c) for c in VISIT_COLUMNS],
        )
    )


VISITS_SQL = """
visits AS (
  SELECT CAST(user_id AS VARCHAR) AS "user",
         %s
  FROM events GROUP BY user_id
)""" % ",\n         ".join(
    f"CAST(CASE WHEN user_id % 11 <> 0 THEN count(*) FILTER (WHERE event_type = '{t}' AND value > 150) END AS INTEGER) AS {c}"
    for t, c in zip(VISIT_TYPES, VISIT_COLUMNS)
)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled wide rows with made-up class probabilities: a metric test bed without a model."""
    base = wide(spark, sf).filter(F.col("label").isNotNull())
    key = F.col("user").cast("bigint")
    weights = [((key * (2 * i + 3) + 7 * i) % 11 + 1).cast("double") for i in range(5)]
    total = sum(weights[1:], weights[0])
    out = base.select("user", "label", F.array(*[w / total for w in weights]).alias("probabilities"))
    names = F.array(*[F.lit(p) for p in PRIORITIES])
    best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    return out.withColumn("predict", F.element_at(names, best))


PREDICTIONS_SQL = (
    WIDE_SQL
    + """,
weighted AS (
  SELECT "user", label, %s FROM wide WHERE label IS NOT NULL
),
predictions AS (
  SELECT "user", label, %s,
         CASE %s END AS predict
  FROM weighted
)"""
    % (
        ", ".join(
            f'CAST((CAST("user" AS BIGINT) * {2 * i + 3} + {7 * i}) % 11 + 1 AS DOUBLE) AS w{i}' for i in range(5)
        ),
        ", ".join(f"w{i} / (w0 + w1 + w2 + w3 + w4) AS p{i}" for i in range(5)),
        " ".join(f"WHEN w{i} = greatest(w0, w1, w2, w3, w4) THEN '{c}'" for i, c in enumerate(PRIORITIES)),
    )
)
