import pytest
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F, types as T

from widecast import presets as P
from widecast.functions import columns as C
from widecast.operators import encode as N
from widecast.operators import prep
from widecast.operators.profile import profile, profile_report
from widecast.plans.preparation import derive, model_table_categories, prepare, prepare_model_table, row_counts, with_products
from widecast.sources.tables import read_table, schema_table, write_csv
from widecast.spec import FeatureSpec, TableSpec

# Numbers as text, NaN, edges of the point buckets, an all-missing and a constant column, UUIDs.
DIRTY = [
    (1, "1.5", "a", 0.0, None, 7, "123e4567-e89b-12d3-a456-426614174000"),
    (2, "x", "b", 0.5, None, 7, "123e4567-e89b-12d3-a456-426614174001"),
    (3, "", "a", 1.0, None, 7, None),
    (4, "NaN", "zz", 500.9, None, 7, "123E4567-E89B-12D3-A456-426614174002"),
    (5, None, None, 501.0, None, 7, None),
    (6, "-2", "a", 20000.9, None, 7, None),
    (7, " 3 ", "b", 20001.0, None, 7, None),
    (8, "1e3", "b", 1e9, None, 7, None),
    (9, "7", "a", float("nan"), None, 7, None),
    (10, "8", "a", None, None, 7, None),
]
DIRTY_SCHEMA = "id int, amount string, level string, points double, nothing double, always int, token string"


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(DIRTY, DIRTY_SCHEMA)


def test_point_level_equals_bucketizer(dirty):
    theirs = Bucketizer(splits=C.POINT_SPLITS, inputCol="points", outputCol="b", handleInvalid="keep")
    rows = prep.quantize_points(theirs.transform(dirty), "points", "level_of_points").collect()
    assert [r["level_of_points"] for r in rows] == [r["b"] for r in rows]
    assert len(C.POINT_SPLITS) == 43 and C.POINT_TOP_BUCKET == 41


def test_negative_points(spark):
    df = spark.createDataFrame([(-1.0,)], "points double")
    assert prep.quantize_points(df, "points", "l").first()["l"] is None
    with pytest.raises(Exception, match="below zero"):
        prep.quantize_points(df, "points", "l", mode="strict").collect()


def test_general_splits_keep_and_null(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (3.0,), (10.0,), (11.0,), (float("nan"),), (None,)], "x double")
    got = [r["b"] for r in prep.quantize(df, "x", "b", [0.0, 2.0, 10.0]).collect()]
    assert got == [None, 0.0, 1.0, 1.0, None, 2.0, None]


def test_lenient_numbers(dirty):
    got = {r["id"]: r["amount"] for r in prep.lenient_numbers(dirty, ["amount"]).collect()}
    assert got == {1: 1.5, 2: None, 3: None, 4: None, 5: None, 6: -2.0, 7: 3.0, 8: 1000.0, 9: 7.0, 10: 8.0}


def test_unseen_levels_become_null(spark, dirty):
    levels = spark.createDataFrame([("a",), ("b",)], "level string")
    got = {r["id"]: r["level"] for r in prep.known_levels_only(dirty, "level", levels).collect()}
    assert got[4] is None and got[5] is None and got[1] == "a" and len(got) == len(DIRTY)


def test_project_names_every_absent_column(dirty):
    with pytest.raises(ValueError, match="'q', 'r'"):
        prep.project(dirty, "id", ["q", "amount", "r"])


def test_conform_drops_extras_and_widens(dirty):
    out = prep.conform(dirty, T.StructType([T.StructField("always", T.LongType()), T.StructField("id", T.IntegerType())]))
    assert out.dtypes == [("always", "bigint"), ("id", "int")]


def test_spec_rules():
    with pytest.raises(ValueError, match="unknown kind"):
        FeatureSpec("a", "nope")
    with pytest.raises(ValueError, match="declared twice"):
        TableSpec.build("k", "y", real=["a", "a"])
    spec = TableSpec.build("k", "y", real=["a"], picklist=["b"])
    assert TableSpec.from_rows(spec.to_rows()) == spec
    assert spec.with_role("ignored", "a").predictors == ["b"]


def test_infer_spec(dirty):
    spec = TableSpec.infer(dirty, "id", "level", categories=["always"], ignored=["token"])
    assert spec.categorical == ["amount", "always"] and spec.names("real") == ["points", "nothing"]
    with pytest.raises(ValueError, match="not in the table"):
        TableSpec.infer(dirty, "id", "level", categories=["gone"])


def test_profile_kinds(dirty):
    rows = {r["column"]: r for r in profile(dirty, text_columns=["amount"]).collect()}
    assert {c: r["type"] for c, r in rows.items()} == {
        "id": "numeric",
        "amount": "string",
        "level": "factor",
        "points": "numeric",
        "nothing": "all_NA",
        "always": "numeric",
        "token": "UUID",
    }
    assert rows["always"]["constant"] and not rows["points"]["constant"]
    assert rows["points"]["nas"] == 2  # a null and a NaN
    assert (rows["level"]["min"], rows["level"]["max"], rows["level"]["cardinality"]) == ("a", "zz", 3)
    assert rows["id"]["min"] == "1.0"
    approx = {r["column"]: r for r in profile(dirty, cardinality="approx").collect()}
    assert approx["level"]["cardinality"] == 3
    report = profile_report(profile(dirty)).collect()
    assert len(report[0]) == 9 and all(isinstance(v, str) for r in report for v in r)


def test_schema_table(dirty):
    assert [r["column"] for r in schema_table(dirty).orderBy("position").collect()] == dirty.columns


def test_csv_single_file_with_header(dirty, tmp_path):
    path = str(tmp_path / "out")
    write_csv(dirty.select("id", "amount").repartition(3), path, header=True, single_file=True)
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    assert read_table(dirty.sparkSession, path, "csv", "id int, amount string").count() == len(DIRTY)


def test_index_label_rejects_null(dirty):
    with pytest.raises(Exception):
        N.index_label(dirty, "level").collect()


def test_null_and_unseen_share_an_index(spark, dirty):
    model = N.fit_levels(dirty, ["level"])
    got = [r["level_index"] for r in model.transform(spark.createDataFrame([("a",), ("new",), (None,)], "level string")).collect()]
    assert got == [0.0, 3.0, 3.0]


def raw_table(spark, rows=400):
    """A table with the raw columns of the packaged preparation, derived from a row number."""
    made = ["app_cnt", "cust_point_level", *P.DIFFERENCES]
    i = F.col("id")
    columns = [F.concat(F.lit("u"), i.cast("string")).alias("user")]
    columns.append(F.when(i % 10 != 3, F.concat(F.lit("k"), (F.floor(i / 7) % 5).cast("string"))).alias("label"))
    for j, f in enumerate(P.conformed_schema().fields):
        if f.name in ("user", "label", *made):
            continue
        value = (i * (j + 3) + F.floor(i / 7) * j) % (j + 11)
        value = F.concat(F.lit("v"), (value % 4).cast("string")) if isinstance(f.dataType, T.StringType) else value.cast(f.dataType)
        columns.append(F.when((i + j) % 9 != 0, value).alias(f.name))
    for j, c in enumerate([*P.RAW_ONLY_COLUMNS, *(a for a, _ in P.DIFFERENCES.values())]):
        columns.append(((i * 37 * (j + 1)) % 30000).cast("double" if c == "cust_point" else "int").alias(c))
    return spark.range(rows).select(columns)


def test_presets_sizes():
    assert len(P.conformed_schema().fields) == 67
    assert len(P.model_columns()) == 90 == len(set(P.model_columns()))
    assert len(P.CATEGORY_COLUMNS) == 31
    assert len(P.typed_spec().predictors) == 64
    assert model_table_categories() == P.CATEGORY_COLUMNS and set(P.CATEGORY_COLUMNS) <= set(P.model_columns())
    conformed = {f.name for f in P.conformed_schema().fields} - {P.KEY, P.LABEL}
    types = {c for c in P.CATEGORY_COLUMNS if c.endswith(("_type", "_pref"))}
    shares = {"in_10s_per", "in_10_30s_per", "in_30_60s_per", "out_60s_per"}
    left_out = {"membership_level", "dt_m_1032", "dt_m_1034", "dt_m_1035", "age_level"}
    assert set(P.model_columns()) == conformed - left_out | types | shares | {"age"}
    assert "market_price_level" in P.model_columns() and "market_price" not in P.model_columns()


def test_model_table_of_92_columns(spark):
    table = spark.range(40).select(
        F.concat(F.lit("u"), "id").alias(P.KEY), *[(F.col("id") % (i + 2)).alias(c) for i, c in enumerate(P.model_columns())], F.when(F.col("id") % 4 > 0, "x").alias(P.LABEL)
    )
    parts = prepare_model_table(table.withColumn("market_price", F.lit(1)))
    assert parts.labelled.columns == [P.KEY, *P.model_columns(), P.LABEL] and len(parts.labelled.columns) == 92
    assert parts.labelled.count() == 30 and parts.to_score.count() == 10


def test_packaged_preparation(spark, tmp_path):
    out = derive(raw_table(spark))
    assert out.columns == [f.name for f in P.conformed_schema().fields]
    row = out.filter("user = 'u5'").first()
    raw = raw_table(spark).filter("user = 'u5'").first()
    assert row["dt_m_1069"] == raw["dt_m_1068"] - raw["dt_m_1067"]
    assert row["app_cnt"] == sum(1 for c in P.VISIT_COLUMNS if (raw[c] or 0) > 0)
    parts = prepare(out, str(tmp_path / "to_score"))
    assert parts.rows_to_score == 40
    assert {r["part"]: r["n"] for r in row_counts(parts).collect()} == {"labelled": 360, "to_score": 40}
    assert spark.read.parquet(str(tmp_path / "to_score")).filter("label IS NOT NULL").count() == 0
    assert set(P.typed_spec().predictors) <= set(with_products(out).columns)
