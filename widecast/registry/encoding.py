"""Levels, pivots, fills and the feature vector."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from widecast import fixtures as X
from widecast.operators import encode as N
from widecast.registry import query
from widecast.registry.common import rounded


def _dense(column: str, text: str) -> str:
    return f"SELECT DISTINCT {text} AS v, dense_rank() OVER (ORDER BY {text}) - 1 AS i FROM wide WHERE {column} IS NOT NULL"


@query(
    "index_levels",
    f"""WITH {X.WIDE_SQL}, b AS ({_dense('brand', 'brand')}), p AS ({_dense('product', 'product')})
SELECT "user", brand, product, CAST(b.i AS DOUBLE) AS brand_index, CAST(p.i AS DOUBLE) AS product_index
FROM wide JOIN b ON brand = b.v JOIN p ON product = p.v""",
)
def index_levels(spark, sf):
    df = N.index_levels(X.wide(spark, sf).select("user", "brand", "product"), ["brand", "product"])
    return df.select("user", "brand", "product", "brand_index", "product_index")


@query(
    "index_numeric_levels",
    f"""WITH {X.WIDE_SQL}, c AS ({_dense('credit_level', 'CAST(credit_level AS VARCHAR)')}),
m AS (SELECT count(*) AS n FROM c)
SELECT "user", CAST(credit_level AS VARCHAR) AS credit_level, CAST(coalesce(c.i, m.n) AS DOUBLE) AS credit_level_index
FROM wide LEFT JOIN c ON CAST(credit_level AS VARCHAR) = c.v CROSS JOIN m""",
)
def index_numeric_levels(spark, sf):
    df = N.index_levels(X.wide(spark, sf).select("user", "credit_level"), ["credit_level"])
    return df.select("user", "credit_level", "credit_level_index")


@query(
    "label_index",
    f"""WITH {X.WIDE_SQL}
SELECT "user", label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_index FROM wide WHERE label IS NOT NULL""",
)
def label_index(spark, sf):
    return N.index_label(X.wide(spark, sf).filter(F.col("label").isNotNull()), "label").select("user", "label", "label_index")


@query(
    "pivot_levels",
    f"""WITH {X.WIDE_SQL},
n AS (SELECT CAST(credit_level AS VARCHAR) AS v, count(*) AS n FROM wide WHERE credit_level IS NOT NULL GROUP BY 1 HAVING count(*) >= 10),
r AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS rn FROM n)
SELECT "user", r.rn AS place, CAST(credit_level IS NOT NULL AND (r.rn IS NULL OR r.rn > 6) AS INTEGER) AS other,
       CAST(credit_level IS NULL AS INTEGER) AS missing
FROM (SELECT "user", credit_level, CASE WHEN r.rn <= 6 THEN r.rn END AS rn FROM wide LEFT JOIN r ON CAST(credit_level AS VARCHAR) = r.v) r""",
)
def pivot_levels(spark, sf):
    df = N.pivot_levels(X.wide(spark, sf).select("user", "credit_level"), "credit_level", top_k=6, min_support=10)
    indicators = [c for c in df.columns if c.startswith("credit_level" + N.IS)][:-2]
    place = F.coalesce(*[F.when(F.col(f"`{c}`") == 1, F.lit(i + 1)) for i, c in enumerate(indicators)])
    return df.select(
        "user",
        place.cast("bigint").alias("place"),
        F.col(f"credit_level{N.IS}{N.OTHER}").cast("int").alias("other"),
        F.col(f"credit_level{N.IS}{N.MISSING}").cast("int").alias("missing"),
    )


@query(
    "fill_mean",
    f"""WITH {X.WIDE_SQL}
SELECT "user", round(coalesce(CAST(dt_m_1043 AS DOUBLE), avg(dt_m_1043) OVER ()), 6) AS dt_m_1043,
       CAST(dt_m_1043 IS NULL AS INTEGER) AS is_missing FROM wide""",
)
def fill_mean(spark, sf):
    df = N.fill_missing(X.wide(spark, sf).select("user", "dt_m_1043"), real=["dt_m_1043"])
    return df.select("user", rounded("dt_m_1043"), F.col(f"dt_m_1043{N.IS}{N.MISSING}").alias("is_missing"))


@query(
    "fill_mode",
    f"""WITH {X.WIDE_SQL},
m AS (SELECT dt_m_1043 AS v FROM wide WHERE dt_m_1043 IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT "user", CAST(coalesce(dt_m_1043, (SELECT v FROM m)) AS DOUBLE) AS dt_m_1043,
       CAST(dt_m_1043 IS NULL AS INTEGER) AS is_missing FROM wide""",
)
def fill_mode(spark, sf):
    df = N.fill_missing(X.wide(spark, sf).select("user", "dt_m_1043"), integral=["dt_m_1043"])
    return df.select("user", "dt_m_1043", F.col(f"dt_m_1043{N.IS}{N.MISSING}").alias("is_missing"))


def _vector_rows() -> str:
    """The expected non-zero slots of the vector, one row each."""
    parts = []
    for c in X.WIDE_SPEC.names("real"):
        parts.append(f"SELECT \"user\", '{c}' AS parent, CAST(NULL AS VARCHAR) AS level, coalesce({c}, avg({c}) OVER ()) AS value FROM wide")
    for c in X.WIDE_SPEC.names("integral"):
        mode = f"(SELECT {c} FROM wide WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
        parts.append(f"SELECT \"user\", '{c}', NULL, CAST(coalesce({c}, {mode}) AS DOUBLE) FROM wide")
    for c in X.WIDE_SPEC.numeric:
        parts.append(f"SELECT \"user\", '{c}', 'missing', 1.0 FROM wide WHERE {c} IS NULL")
    for c in X.WIDE_SPEC.categorical:
        t = f"CAST({c} AS VARCHAR)"
        top = (
            f"(SELECT v FROM (SELECT {t} AS v, count(*) AS n FROM wide WHERE {c} IS NOT NULL GROUP BY 1 "
            "HAVING count(*) >= 10 ORDER BY n DESC, v LIMIT 20))"
        )
        parts.append(
            f"SELECT \"user\", '{c}', CASE WHEN {c} IS NULL THEN 'missing' WHEN {t} IN {top} THEN {t} ELSE 'other' END, 1.0 FROM wide"
        )
    union = "\nUNION ALL\n".join(parts)
    return f'WITH {X.WIDE_SQL}\nSELECT "user", parent, level, round(value, 6) AS value FROM (\n{union}\n) WHERE value <> 0'


@query("vectorize", _vector_rows())
def vectorize(spark, sf):
    """The feature vector's non-zero slots, one row each, named by the vector's own metadata."""
    df = N.vectorize(X.wide(spark, sf), X.WIDE_SPEC)
    slots = N.vector_slots(df)
    names = F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(v).cast("string").alias("level")) for p, v in slots])
    pairs = F.arrays_zip(names.alias("s"), vector_to_array(N.VECTOR).alias("v"))
    long = df.select("user", F.explode(pairs).alias("x"))
    return long.filter(F.col("x.v") != 0).select("user", "x.s.parent", "x.s.level", rounded(F.col("x.v"), "value"))
