"""Feature checks against the label, and the list of features worth keeping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from widecast.functions import columns as C
from widecast.operators.prep import require_columns
from widecast.session import written


@dataclass(frozen=True)
class SanityLimits:
    min_variance: float = 1e-5
    max_correlation: float = 0.95
    max_association: float = 0.95
    max_missing_share: float = 0.99


def _unpivot(wide: DataFrame, lines: Sequence[Column]) -> DataFrame:
    return wide.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows that have both values; null when one side does not vary.

    The built-in ``corr`` stops the job on a constant column when ANSI mode is on.
    """
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
    return F.try_divide(F.covar_samp(x, y), spread)


def numeric_checks(df: DataFrame, features: Sequence[str], label_index: Column) -> DataFrame:
    """(feature, variance, correlation, missing_share) of numeric features, in one pass."""
    require_columns(df, features)
    types = {f.name: f.dataType for f in df.schema.fields}
    measures = [F.count(F.lit(1)).alias("total")]
    for i, c in enumerate(features):
        x = C.clean_number(c, types[c])
        measures += [
            F.var_samp(x).alias(f"v{i}"),
            correlation(x, label_index).alias(f"c{i}"),
            F.count(x).alias(f"n{i}"),
        ]
    return _unpivot(
        df.agg(*measures),
        [
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"v{i}").alias("variance"),
                F.col(f"c{i}").alias("correlation"),
                (1 - F.col(f"n{i}") / F.col("total")).alias("missing_share"),
            )
            for i, c in enumerate(features)
        ],
    )


def contingency(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, value, label, n): one pass over the table for all features."""
    require_columns(df, features)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in features])
    return (
        df.select(F.col(label).alias("label"), F.explode(pairs).alias("p"))
        .groupBy("p.feature", "p.value", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def categorical_checks(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, association, missing_share): Cramer's V of each category with the label.

    chi2 / n = sum(cell^2 / (row * column)) - 1. Rows and columns are summed from the counted
    cells, never from the table again. Rows whose category is missing take no part in V.
    """
    counted = written(contingency(df, features, label), "contingency")
    cells = counted.filter(F.col("value").isNotNull() & F.col("label").isNotNull())
    by_value = Window.partitionBy("feature", "value")  # at most one row per class
    cells = cells.withColumn("row_n", F.sum("n").over(by_value))
    cols = cells.groupBy("feature", "label").agg(F.sum("n").alias("col_n"))
    sides = cols.groupBy("feature").agg(F.count(F.lit(1)).alias("n_labels"))
    levels = cells.select("feature", "value").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n_values"))
    share = (
        cells.join(F.broadcast(cols), ["feature", "label"])  # features x classes rows
        .groupBy("feature")
        .agg(F.sum(F.col("n") * F.col("n") / (F.col("row_n").cast("double") * F.col("col_n"))).alias("s"))
    )
    smaller = F.least(F.col("n_values"), F.col("n_labels")) - 1
    v = share.join(levels, "feature").join(sides, "feature").select(
        "feature", F.when(smaller > 0, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / smaller)).otherwise(0.0).alias("association")
    )
    missing = counted.groupBy("feature").agg(
        (F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("missing_share")
    )
    return missing.join(v, "feature", "left").select("feature", "association", "missing_share")


def sanity_check(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str,
    classes: Sequence[str],
    limits: SanityLimits = SanityLimits(),
) -> tuple[DataFrame, list[str]]:
    """(report with one row per feature and the reason it fails, names of the features that pass)."""
    columns = ["feature", "kind", "variance", "correlation", "association", "missing_share"]
    none = F.lit(None).cast("double")
    parts = []
    if numeric:
        parts.append(
            numeric_checks(df, numeric, C.class_index(label, classes))
            .withColumns({"kind": F.lit("numeric"), "association": none})
            .select(columns)
        )
    if categorical:
        parts.append(
            categorical_checks(df, categorical, label)
            .withColumns({"kind": F.lit("categorical"), "variance": none, "correlation": none})
            .select(columns)
        )
    report = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    reason = (
        F.when(F.col("missing_share") > limits.max_missing_share, "mostly missing")
        .when((F.col("kind") == "numeric") & (F.coalesce("variance", F.lit(0.0)) < limits.min_variance), "low variance")
        .when(F.abs("correlation") > limits.max_correlation, "correlated with the label")
        .when(F.col("association") > limits.max_association, "associated with the label")
    )
    rows = report.withColumn("reason", reason).collect()  # one row per feature
    schema = "feature string, kind string, variance double, correlation double, association double, missing_share double, reason string"
    failed = {r["feature"] for r in rows if r["reason"]}
    return (
        df.sparkSession.createDataFrame(rows, schema),
        [c for c in [*numeric, *categorical] if c not in failed],
    )
