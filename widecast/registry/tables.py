"""Sources, sinks, projections, predicates and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from widecast import fixtures as X
from widecast.functions import columns as C
from widecast.operators import prep as P
from widecast.operators.score import explode_probabilities
from widecast.registry import query
from widecast.registry.common import rounded, scratch
from widecast.sources.tables import local_table, read_table, write_counted, write_csv, write_table

ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


def _orders(spark, sf):
    return read_table(spark, f"{sf}/orders.parquet")


@query("parquet_scan", ORDERS_SQL)
def parquet_scan(spark, sf):
    return P.project(_orders(spark, sf), "o_orderkey", ORDERS_COLUMNS[1:])


@query("parquet_roundtrip", ORDERS_SQL)
def parquet_roundtrip(spark, sf):
    path = scratch(spark)
    write_table(_orders(spark, sf).select(ORDERS_COLUMNS), path)
    return read_table(spark, path)


@query("csv_roundtrip", ORDERS_SQL)
def csv_roundtrip(spark, sf):
    path = scratch(spark)
    write_csv(_orders(spark, sf).select(ORDERS_COLUMNS), path)
    return read_table(spark, path, "csv", ORDERS_SCHEMA, header=False)


@query("csv_header_inferred_roundtrip", ORDERS_SQL)
def csv_header_inferred_roundtrip(spark, sf):
    path = scratch(spark)
    write_csv(_orders(spark, sf).select(ORDERS_COLUMNS), path, header=True)
    return read_table(spark, path, "csv").select(
        F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), *ORDERS_COLUMNS[2:]
    )


@query("written_row_count", "SELECT count(*) AS written, count(*) AS stored FROM orders")
def written_row_count(spark, sf):
    path = scratch(spark)
    n = write_counted(_orders(spark, sf), path)
    return read_table(spark, path).agg(F.lit(n).cast("bigint").alias("written"), F.count(F.lit(1)).alias("stored"))


@query(
    "project_spec",
    f"""WITH {X.WIDE_SQL}
SELECT "user", cust_point, dt_m_1085, dt_m_1006, dt_m_1041, dt_m_1043, credit_level, gender, brand, product, label FROM wide""",
)
def project_spec(spark, sf):
    return P.project(X.wide(spark, sf), "user", X.WIDE_SPEC.predictors, "label")


@query("drop_columns", f'WITH {X.WIDE_SQL} SELECT * EXCLUDE (label, opened, cust_point) FROM wide')
def drop_columns(spark, sf):
    return P.drop_columns(X.wide(spark, sf), "label", "opened", "cust_point")


@query("split_to_score", f'WITH {X.WIDE_SQL} SELECT "user", label, brand FROM wide WHERE label IS NULL')
def split_to_score(spark, sf):
    return P.split_by_label(X.wide(spark, sf), "label")[0].select("user", "label", "brand")


@query("split_labelled", f'WITH {X.WIDE_SQL} SELECT "user", label, brand FROM wide WHERE label IS NOT NULL')
def split_labelled(spark, sf):
    return P.split_by_label(X.wide(spark, sf), "label")[1].select("user", "label", "brand")


CONFORMED = T.StructType(
    [
        T.StructField("user", T.StringType()),
        T.StructField("dt_m_1041", T.LongType()),
        T.StructField("dt_m_1085", T.DoubleType()),
        T.StructField("brand", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)


@query(
    "conform_schema",
    f'WITH {X.WIDE_SQL} SELECT "user", CAST(dt_m_1041 AS BIGINT) AS dt_m_1041, dt_m_1085, brand, label FROM wide',
)
def conform_schema(spark, sf):
    return P.conform(X.wide(spark, sf), CONFORMED)


@query(
    "difference",
    f'WITH {X.WIDE_SQL} SELECT "user", dt_m_1041, dt_m_1043 - dt_m_1041 AS dt_m_1044 FROM wide',
)
def difference(spark, sf):
    df = P.add_difference(X.wide(spark, sf), "dt_m_1044", "dt_m_1043", "dt_m_1041", drop=["dt_m_1043"])
    return df.select("user", "dt_m_1041", "dt_m_1044")


@query(
    "count_positive",
    f"""WITH {X.VISITS_SQL}
SELECT *, CAST({' + '.join(f'CASE WHEN {c} > 0 THEN 1 ELSE 0 END' for c in X.VISIT_COLUMNS)} AS INTEGER) AS app_cnt FROM visits""",
)
def count_positive(spark, sf):
    return P.count_positive(X.visits(spark, sf), X.VISIT_COLUMNS, "app_cnt")


@query(
    "product",
    f'WITH {X.WIDE_SQL} SELECT "user", round(dt_m_1085 * dt_m_1043, 6) AS dt_m_1085_v FROM wide',
)
def product(spark, sf):
    df = P.add_product(X.wide(spark, sf), "dt_m_1085_v", "dt_m_1085", "dt_m_1043")
    return df.select("user", rounded("dt_m_1085_v"))


@query(
    "array_columns",
    f"""WITH {X.PREDICTIONS_SQL}
SELECT "user", {', '.join(f'round(p{i}, 6) AS "{i}"' for i in range(5))} FROM predictions""",
)
def array_columns(spark, sf):
    df = explode_probabilities(X.predictions(spark, sf), ["user"], 5)
    return df.select("user", *[F.round(f"`{i}`", 6).alias(str(i)) for i in range(5)])


@query(
    "struct_field_columns",
    f"""WITH {X.PREDICTIONS_SQL}
SELECT "user", {', '.join(f'round(p{i}, 6) AS p{i}' for i in range(5))} FROM predictions""",
)
def struct_field_columns(spark, sf):
    nested = X.predictions(spark, sf).select("user", F.struct("predict", "probabilities").alias("output"))
    df = explode_probabilities(nested, ["user"], 5, [f"p{i}" for i in range(5)], "output.probabilities")
    return df.select("user", *[rounded(f"p{i}") for i in range(5)])


@query(
    "apply_spec",
    f"""WITH {X.WIDE_SQL}
SELECT "user", cust_point, dt_m_1085, CAST(dt_m_1006 AS BIGINT) AS dt_m_1006, CAST(dt_m_1041 AS BIGINT) AS dt_m_1041,
       CAST(dt_m_1043 AS BIGINT) AS dt_m_1043, CAST(credit_level AS VARCHAR) AS credit_level,
       CAST(gender AS VARCHAR) AS gender, brand, product, label FROM wide""",
)
def apply_spec(spark, sf):
    return P.apply_spec(X.wide(spark, sf), X.WIDE_SPEC).drop("opened")


DIRTY_SQL = """CASE CAST(o_orderkey % 7 AS INTEGER)
         WHEN 0 THEN 'x' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN '' WHEN 2 THEN 'NaN'
         WHEN 3 THEN CAST(o_custkey AS VARCHAR) || '.5' WHEN 4 THEN '-' || CAST(o_custkey AS VARCHAR)
         WHEN 5 THEN NULL ELSE CAST(o_custkey AS VARCHAR) || 'e2' END"""


@query(
    "lenient_cast",
    f"""WITH dirty AS (SELECT o_orderkey, {DIRTY_SQL} AS amount FROM orders)
SELECT o_orderkey, CASE WHEN isnan(TRY_CAST(amount AS DOUBLE)) THEN NULL ELSE TRY_CAST(amount AS DOUBLE) END AS amount
FROM dirty""",
)
def lenient_cast(spark, sf):
    dirty = _orders(spark, sf).select("o_orderkey", F.expr(DIRTY_SQL.replace("VARCHAR", "STRING")).alias("amount"))
    return P.lenient_numbers(dirty, ["amount"])


@query(
    "unseen_level_to_null",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') THEN o_orderpriority END AS o_orderpriority
FROM orders""",
)
def unseen_level_to_null(spark, sf):
    levels = local_table(spark, [("1-URGENT",), ("2-HIGH",), ("5-LOW",)], "level string")
    return P.known_levels_only(_orders(spark, sf), "o_orderpriority", levels).select("o_orderkey", "o_orderpriority")


@query(
    "unseen_level_from_table",
    """SELECT l_orderkey, l_linenumber, l_returnflag,
       CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) THEN l_partkey END AS l_partkey FROM lineitem""",
)
def unseen_level_from_table(spark, sf):
    levels = read_table(spark, f"{sf}/part.parquet").filter(F.col("p_size") > 25).select(F.col("p_partkey").alias("level"))
    lines = read_table(spark, f"{sf}/lineitem.parquet")
    return P.known_levels_only(lines, "l_partkey", levels).select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")


@query("date_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def date_text(spark, sf):
    return P.times_as_text(read_table(spark, f"{sf}/events.parquet"), ["ts"]).select("event_id", "ts")


POINT_SQL = """CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 42.0 WHEN {x} < 0 THEN NULL WHEN {x} < 1 THEN 0.0
     ELSE least(floor(({x} - 1) / 500) + 1, 41) END"""


@query(
    "quantize_points",
    f"""WITH {X.WIDE_SQL}
SELECT "user", CAST({POINT_SQL.format(x='cust_point')} AS DOUBLE) AS cust_point_level,
       CAST({POINT_SQL.format(x='dt_m_1085')} AS DOUBLE) AS balance_level FROM wide""",
)
def quantize_points(spark, sf):
    df = P.quantize_points(X.wide(spark, sf), "cust_point", "cust_point_level")
    return P.quantize_points(df, "dt_m_1085", "balance_level").select("user", "cust_point_level", "balance_level")


BALANCE_SPLITS = [-500.0, 0.0, 100.0, 2500.0, 7500.0, 9000.0]


@query(
    "quantize_splits",
    f"""SELECT c_custkey, CAST(CASE WHEN c_acctbal < -500 OR c_acctbal > 9000 THEN NULL
       ELSE {' + '.join(f'CASE WHEN c_acctbal >= {s} THEN 1 ELSE 0 END' for s in BALANCE_SPLITS[1:-1])} END AS DOUBLE) AS level
FROM customer""",
)
def quantize_splits(spark, sf):
    df = P.quantize(read_table(spark, f"{sf}/customer.parquet"), "c_acctbal", "level", BALANCE_SPLITS)
    return df.select("c_custkey", "level")


@query(
    "derived_wide",
    f"""WITH {X.WIDE_SQL}, {X.VISITS_SQL}
SELECT w."user", w.label, CAST({POINT_SQL.format(x='w.cust_point')} AS DOUBLE) AS cust_point_level,
       w.dt_m_1043 - w.dt_m_1041 AS dt_m_1044, round(w.dt_m_1085 * w.dt_m_1006, 6) AS dt_m_1085_v,
       CAST({' + '.join(f'CASE WHEN v.{c} > 0 THEN 1 ELSE 0 END' for c in X.VISIT_COLUMNS)} AS INTEGER) AS app_cnt
FROM wide w LEFT JOIN visits v ON w."user" = v."user" WHERE w.label IS NOT NULL""",
)
def derived_wide(spark, sf):
    """The whole preparation in one projection: quantize, count, subtract, multiply, keep labelled rows."""
    df = X.wide(spark, sf).join(X.visits(spark, sf), "user", "left").filter(F.col("label").isNotNull())
    return df.select(
        "user",
        "label",
        C.point_level("cust_point").alias("cust_point_level"),
        C.difference("dt_m_1043", "dt_m_1041").alias("dt_m_1044"),
        rounded(C.product("dt_m_1085", "dt_m_1006"), "dt_m_1085_v"),
        C.positive_count(X.VISIT_COLUMNS).alias("app_cnt"),
    )
