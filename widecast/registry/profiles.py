"""Column profiles and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from widecast import fixtures as X
from widecast.operators.profile import profile
from widecast.registry import query
from widecast.registry.common import round_columns
from widecast.sources.tables import read_table

NULL_TEXT = "CAST(NULL AS VARCHAR)"
NULL_NUMBER = "CAST(NULL AS DOUBLE)"


def _line(table: str, column: str, kind: str, position: int) -> str:
    c = f'"{column}"'
    head = f"SELECT {position} AS position, '{column}' AS \"column\", CASE WHEN count({c}) = 0 THEN 'all_NA' ELSE '{kind}' END AS type"
    nas = f"CAST(count(*) - count({c}) AS BIGINT) AS nas, coalesce(min({c}) = max({c}), false) AS constant"
    if kind == "numeric":
        d = f"CAST({c} AS DOUBLE)"
        middle = (
            f"{NULL_TEXT} AS first, {NULL_TEXT} AS last, round(min({d}), 6) AS min_value, round(max({d}), 6) AS max_value, "
            f"round(avg({d}), 6) AS mean, round(stddev_samp({d}), 6) AS sigma"
        )
        levels = "CAST(NULL AS BIGINT)"
    else:
        text = f"strftime({{}}({c}), '%Y-%m-%d %H:%M:%S')" if kind == "time" else f"{{}}({c})"
        if kind in ("string", "UUID"):
            first = last = NULL_TEXT
        else:
            first, last = text.format("min"), text.format("max")
        middle = (
            f"{first} AS first, {last} AS last, {NULL_NUMBER} AS min_value, {NULL_NUMBER} AS max_value, "
            f"{NULL_NUMBER} AS mean, {NULL_NUMBER} AS sigma"
        )
        levels = f"CAST(count(DISTINCT {c}) AS BIGINT)" if kind == "factor" else "CAST(NULL AS BIGINT)"
    return f"{head}, {middle}, {nas}, {levels} AS cardinality FROM {table}"


def profile_sql(table: str, kinds: dict[str, str], ctes: str = "") -> str:
    body = "\nUNION ALL\n".join(_line(table, c, k, i) for i, (c, k) in enumerate(kinds.items()))
    return f"WITH {ctes}\n{body}" if ctes else body


def typed(table):
    """The profile with text bounds only where they are text in every engine."""
    return round_columns(table, ["min_value", "max_value", "mean", "sigma"]).select(
        "position",
        "column",
        "type",
        F.when(F.col("type") != "numeric", F.col("min")).alias("first"),
        F.when(F.col("type") != "numeric", F.col("max")).alias("last"),
        "min_value",
        "max_value",
        "mean",
        "sigma",
        "nas",
        "constant",
        "cardinality",
    )


ORDERS = {
    "o_orderkey": "numeric",
    "o_custkey": "numeric",
    "o_orderstatus": "factor",
    "o_totalprice": "numeric",
    "o_orderdate": "time",
    "o_orderpriority": "factor",
}
EVENTS = {
    "event_id": "numeric",
    "ts": "time",
    "user_id": "numeric",
    "event_type": "factor",
    "value": "numeric",
    "props": "factor",
}
WIDE = {
    "user": "factor",
    "label": "factor",
    "credit_level": "numeric",
    "gender": "numeric",
    "brand": "factor",
    "product": "factor",
    "cust_point": "numeric",
    "dt_m_1041": "numeric",
    "dt_m_1043": "numeric",
    "dt_m_1006": "numeric",
    "dt_m_1085": "numeric",
    "opened": "time",
}
DOCUMENTS = {"doc_id": "numeric", "text": "string", "lang": "factor", "source": "factor", "n_chars": "numeric"}
EDGE_SQL = """
edge AS (
  SELECT CAST(NULL AS DOUBLE) AS nothing, 7 AS always, substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) || '-0000-4000-8000-'
         || substr(md5(CAST(l_orderkey AS VARCHAR)), 9, 12) AS token, l_returnflag, l_shipdate FROM lineitem
)"""
EDGE = {"nothing": "numeric", "always": "numeric", "token": "UUID", "l_returnflag": "factor", "l_shipdate": "time"}


@query("profile_orders", profile_sql("orders", ORDERS))
def profile_orders(spark, sf):
    return typed(profile(read_table(spark, f"{sf}/orders.parquet"), list(ORDERS)))


@query("profile_events", profile_sql("events", EVENTS))
def profile_events(spark, sf):
    return typed(profile(read_table(spark, f"{sf}/events.parquet"), list(EVENTS)))


@query("profile_wide", profile_sql("wide", WIDE, X.WIDE_SQL))
def profile_wide(spark, sf):
    return typed(profile(X.wide(spark, sf), list(WIDE)))


@query("profile_documents", profile_sql("documents", DOCUMENTS))
def profile_documents(spark, sf):
    return typed(profile(read_table(spark, f"{sf}/documents.parquet"), list(DOCUMENTS), text_columns=["text"]))


@query("profile_edge_kinds", profile_sql("edge", EDGE, EDGE_SQL))
def profile_edge_kinds(spark, sf):
    """All-missing, constant and UUID columns."""
    key = F.md5(F.col("l_orderkey").cast("string"))
    token = F.concat(F.substring(key, 1, 8), F.lit("-0000-4000-8000-"), F.substring(key, 9, 12))
    edge = read_table(spark, f"{sf}/lineitem.parquet").select(
        F.lit(None).cast("double").alias("nothing"), F.lit(7).alias("always"), token.alias("token"), "l_returnflag", "l_shipdate"
    )
    return typed(profile(edge, list(EDGE)))


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf):
    return read_table(spark, f"{sf}/lineitem.parquet").agg(F.count(F.lit(1)).alias("n"))
