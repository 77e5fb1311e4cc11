"""Column profile: one row per column with its kind, range, spread, missing values and levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from widecast.functions import columns as C
from widecast.operators.prep import require_columns


def _family(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(data_type, T.StringType):
        return "text"
    raise ValueError(f"no profile for columns of type {data_type.simpleString()}")


def _clean(field: T.StructField, family: str) -> Column:
    if family == "numeric" and isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return C.clean_number(field.name)
    if family == "numeric":
        return F.col(field.name).cast("double")
    return F.col(field.name)


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    text_columns: Sequence[str] = (),
    cardinality: str = "exact",
) -> DataFrame:
    """Profile every column in one aggregation pass.

    Text columns count as factors, except those in ``text_columns``. Levels of factors are counted
    exactly by a second pass that groups (column, value) pairs, so one hot value is combined before
    the shuffle and no group is collected; ``cardinality="approx"`` stays with the first pass.
    """
    if cardinality not in ("exact", "approx"):
        raise ValueError(f"unknown cardinality mode {cardinality!r}")
    columns = list(columns or df.columns)
    require_columns(df, columns)
    fields = {f.name: f for f in df.schema.fields}
    families = {c: _family(fields[c].dataType) for c in columns}
    values = {c: _clean(fields[c], families[c]) for c in columns}

    measures: list[Column] = [F.count(F.lit(1)).alias("total")]
    for i, c in enumerate(columns):
        measures += [
            F.count(values[c]).alias(f"n{i}"),
            F.min(values[c]).alias(f"lo{i}"),
            F.max(values[c]).alias(f"hi{i}"),
        ]
        if families[c] == "numeric":
            measures += [F.avg(values[c]).alias(f"mean{i}"), F.stddev_samp(values[c]).alias(f"sd{i}")]
        if families[c] == "text":
            measures.append(F.bool_and(values[c].rlike(C.UUID_PATTERN)).alias(f"uuid{i}"))
            if cardinality == "approx":
                measures.append(F.approx_count_distinct(values[c]).alias(f"levels{i}"))
    wide = df.agg(*measures)

    def line(i: int, c: str) -> Column:
        family, low, high = families[c], F.col(f"lo{i}"), F.col(f"hi{i}")
        number = T.DoubleType()
        none = {"text": F.lit(None).cast("string"), "number": F.lit(None).cast(number), "count": F.lit(None).cast("bigint")}
        kind = {
            "numeric": F.lit("numeric"),
            "time": F.lit("time"),
            "text": F.when(F.col(f"uuid{i}"), "UUID").otherwise("string" if c in text_columns else "factor")
            if family == "text"
            else None,
        }[family]
        kind = F.when(F.col(f"n{i}") == 0, "all_NA").otherwise(kind)
        if family == "time":
            low_text, high_text = (C.time_text(b, fields[c].dataType) for b in (low, high))
        elif family == "text":
            low_text, high_text = (F.when(kind == "factor", b) for b in (low, high))
        else:
            low_text, high_text = low.cast("string"), high.cast("string")
        levels = none["count"]
        if family == "text" and cardinality == "approx":
            levels = F.when(kind == "factor", F.col(f"levels{i}"))
        is_number = family == "numeric"
        return F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            kind.alias("type"),
            low_text.alias("min"),
            high_text.alias("max"),
            (low if is_number else none["number"]).alias("min_value"),
            (high if is_number else none["number"]).alias("max_value"),
            (F.col(f"mean{i}") if is_number else none["number"]).alias("mean"),
            (F.col(f"sd{i}") if is_number else none["number"]).alias("sigma"),
            (F.col("total") - F.col(f"n{i}")).alias("nas"),
            F.coalesce(low == high, F.lit(False)).alias("constant"),
            levels.alias("cardinality"),
        )

    table = wide.select(F.explode(F.array(*[line(i, c) for i, c in enumerate(columns)])).alias("p")).select("p.*")
    factors = [c for c in columns if families[c] == "text" and c not in text_columns]
    if cardinality == "exact" and factors:
        pairs = df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in factors])).alias("p")
        ).select("p.*")
        counted = (
            pairs.filter(F.col("value").isNotNull())
            .distinct()
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("exact_levels"))
        )
        table = (
            table.join(counted, "column", "left")
            .withColumn("cardinality", F.when(F.col("type") == "factor", F.col("exact_levels")))
            .drop("exact_levels")
        )
    return table.select(
        "position",
        "column",
        "type",
        "min",
        "max",
        "min_value",
        "max_value",
        "mean",
        "sigma",
        "nas",
        "constant",
        "cardinality",
    )


def profile_report(table: DataFrame) -> DataFrame:
    """The profile as nine text columns, blank where a measure does not apply."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return table.orderBy("position").select(
        blank("column"),
        blank("type"),
        blank("min"),
        blank("max"),
        blank("mean"),
        blank("sigma"),
        F.when(F.col("nas") > 0, F.col("nas").cast("string")).otherwise("").alias("nas"),
        F.when(F.col("constant"), "constant").otherwise("").alias("constant"),
        blank("cardinality"),
    )
