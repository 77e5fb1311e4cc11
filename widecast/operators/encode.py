"""Levels, pivots and the feature vector, as ``pyspark.ml`` stages that are saved with the model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, functions as F, types as T

from widecast.functions import columns as C
from widecast.operators.levels import Levels
from widecast.operators.prep import require_columns
from widecast.spec import TableSpec

VECTOR = "features"
IS = "__is__"
MISSING = "missing"
OTHER = "other"


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def as_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns as category text; numbers by their whole part."""
    require_columns(df, columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: C.category_text(c, types[c]) for c in columns})


def fit_levels(df: DataFrame, columns: Sequence[str], order: str = "alphabetAsc") -> Levels:
    """Level tables of category columns, alphabetical or (``frequencyDesc``) the most frequent first; null and unseen values share the index after the last."""
    require_columns(df, columns)
    if order not in ("alphabetAsc", "frequencyDesc"):
        raise ValueError(f"unknown order {order!r}")
    return Levels.learn(df, {c: f"CAST({quoted(c)} AS STRING)" for c in columns}, order == "frequencyDesc")


def index_levels(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every string column, or the named columns, with a ``<c>_index`` column beside it."""
    columns = list(columns or string_columns(df))
    df = as_categories(df, columns)
    return fit_levels(df, columns).transform(df)


def index_label(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """Label position in alphabetical order; a null label is an error."""
    levels = fit_levels(df, [label])
    found = levels.indexed(df, {label: out})
    return found.withColumn(out, F.when(F.col(out).isNull(), F.raise_error(F.lit(f"null in {label}"))).otherwise(F.col(out)).cast("double"))


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n) of all category columns from one pass, missing values left out."""
    types = {f.name: f.dataType for f in df.schema.fields}
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), C.category_text(c, types[c]).alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_levels(df: DataFrame, columns: Sequence[str], top_k: int, min_support: int) -> dict[str, list[str]]:
    """The ``top_k`` most frequent levels of each column with enough rows; ties go by name.

    Each column's levels are ranked inside an aggregate that keeps ``top_k`` of them, so a column
    with very many levels is never sorted in one task.
    """
    found: dict[str, list[str]] = {c: [] for c in columns}
    frequent = level_counts(df, columns).filter(F.col("n") >= min_support)
    for r in top_per_feature(frequent, top_k).collect():  # at most top_k rows per column
        found[r["feature"]].append(r["value"])
    return found


def top_per_feature(counts: DataFrame, top_k: int, buckets: int = 64) -> DataFrame:
    """The ``top_k`` rows by count of each feature: ranked in hash buckets first, then overall."""
    from pyspark.sql import Window

    order = [F.desc("n"), F.asc("value")]
    local = Window.partitionBy("feature", "__bucket").orderBy(*order)
    whole = Window.partitionBy("feature").orderBy(*order)
    return (
        counts.withColumn("__bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)))
        .withColumn("__r", F.row_number().over(local))
        .filter(F.col("__r") <= top_k)
        .withColumn("__r", F.row_number().over(whole))
        .filter(F.col("__r") <= top_k)
        .orderBy("feature", "__r")
        .select("feature", "value", "n")
    )


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class VectorSettings:
    top_k: int = 20
    min_support: int = 10
    track_missing: bool = True
    unit_range: bool = False  # numbers scaled to [0, 1] by the range seen, later values clipped to it


def pivot_expressions(column: str, levels: Sequence[str], text: str, track_missing: bool = True) -> dict[str, str]:
    """Indicator columns of one pick list: a level each, all other values, and missing."""
    out = {f"{column}{IS}{v}": f"CASE WHEN {text} = {sql_text(v)} THEN 1.0D ELSE 0.0D END" for v in levels}
    known = ", ".join(map(sql_text, levels))
    others = f"{text} IS NOT NULL" + (f" AND {text} NOT IN ({known})" if levels else "")
    out[f"{column}{IS}{OTHER}"] = f"CASE WHEN {others} THEN 1.0D ELSE 0.0D END"
    if track_missing:
        out[f"{column}{IS}{MISSING}"] = f"CASE WHEN {text} IS NULL THEN 1.0D ELSE 0.0D END"
    return out


def pivot_levels(df: DataFrame, column: str, top_k: int = 20, min_support: int = 10) -> DataFrame:
    """The rows with one indicator column per frequent level, plus ``other`` and ``missing``."""
    levels = top_levels(df, [column], top_k, min_support)[column]
    text = category_sql(column, df.schema[column].dataType)
    return df.selectExpr("*", *[f"{e} AS {quoted(n)}" for n, e in pivot_expressions(column, levels, text).items()])


def category_sql(column: str, data_type: T.DataType) -> str:
    c = quoted(column)
    return f"CAST(try_cast({c} AS BIGINT) AS STRING)" if isinstance(data_type, T.NumericType) else f"CAST({c} AS STRING)"


def number_sql(column: str) -> str:
    """The column as a double, with NaN and texts that are no number read as missing, as SQL text: one call to the JVM where the
    column functions need many, which counts on tables of a hundred columns."""
    return f"nullif(try_cast({quoted(column)} AS DOUBLE), double('NaN'))"


def fill_values(df: DataFrame, real: Sequence[str], integral: Sequence[str]) -> dict[str, float]:
    """Mean of each real and most frequent value of each integral column (the smallest on a tie).

    A column without any value is filled with 0.
    """
    filled: dict[str, float] = {}
    types = {f.name: f.dataType for f in df.schema.fields}
    if real:
        means = df.agg(*[F.avg(C.clean_number(c, types[c])).alias(f"m{i}") for i, c in enumerate(real)]).first()
        filled |= {c: means[f"m{i}"] or 0.0 for i, c in enumerate(real)}
    if integral:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("feature"), C.clean_number(c, types[c]).alias("value")) for c in integral]
        )
        counts = (
            df.select(F.explode(pairs).alias("p"))
            .select("p.*")
            .filter(F.col("value").isNotNull())
            .groupBy("feature", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        best = counts.groupBy("feature").agg(F.max(F.struct(F.col("n"), (-F.col("value")).alias("v"))).alias("b"))
        modes = {r["feature"]: -r["b"]["v"] + 0.0 for r in best.collect()}  # one row per feature
        filled |= {c: modes.get(c, 0.0) for c in integral}
    return filled


def number_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each column, from one pass; (0, 0) for a column without any."""
    types = {f.name: f.dataType for f in df.schema.fields}
    values = [C.clean_number(c, types[c]) for c in columns]
    row = df.agg(*[m for i, x in enumerate(values) for m in (F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"))]).first()
    return {c: (row[f"lo{i}"] or 0.0, row[f"hi{i}"] or 0.0) for i, c in enumerate(columns)}


def fill_missing(df: DataFrame, real: Sequence[str] = (), integral: Sequence[str] = ()) -> DataFrame:
    """Fill missing numbers and add a ``<c>__is__missing`` indicator for each column."""
    values = fill_values(df, real, integral)
    kept = [quoted(c) for c in df.columns if c not in values]
    filled = [f"coalesce({number_sql(c)}, {v!r}D) AS {quoted(c)}" for c, v in values.items()]
    flags = [f"CASE WHEN {number_sql(c)} IS NULL THEN 1 ELSE 0 END AS {quoted(c + IS + MISSING)}" for c in values]
    return df.selectExpr(*kept, *filled, *flags)


def vectorizer(df: DataFrame, spec: TableSpec, settings: VectorSettings = VectorSettings(), out: str = VECTOR) -> PipelineModel:
    """Learn the fill values and levels, and return saveable stages that build the vector.

    Numbers: filled value and missing indicator. Pick lists: indicators. Slot names in the vector's
    metadata tell parent column and level apart (``brand__is__AUTOMOBILE``).
    """
    require_columns(df, spec.predictors)
    types = {f.name: f.dataType for f in df.schema.fields}
    slots: dict[str, str] = {}
    ranges = number_ranges(df, spec.numeric) if settings.unit_range else {}
    for c, v in fill_values(df, spec.names("real"), spec.names("integral")).items():
        slots[c] = f"coalesce({number_sql(c)}, {v!r}D)"
        if c in ranges:
            low, high = ranges[c]
            width = high - low
            slots[c] = f"least(greatest(({slots[c]} - {low!r}D) / {width!r}D, 0.0D), 1.0D)" if width > 0 else "0.0D"
        if settings.track_missing:
            slots[c + IS + MISSING] = f"CASE WHEN {number_sql(c)} IS NULL THEN 1.0D ELSE 0.0D END"
    if spec.categorical:
        levels = top_levels(df, spec.categorical, settings.top_k, settings.min_support)
        for c in spec.categorical:
            slots |= pivot_expressions(c, levels[c], category_sql(c, types[c]), settings.track_missing)
    # The vector's slot columns live beside the input columns, so they carry a prefix of their own.
    columns = ", ".join(f"{e} AS {quoted('__slot__' + n)}" for n, e in slots.items())
    make = SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__")
    gather = VectorAssembler(inputCols=["__slot__" + n for n in slots], outputCol=out, handleInvalid="error")
    drop = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(quoted('__slot__' + n) for n in slots)}) FROM __THIS__")
    return Pipeline(stages=[make, gather, drop]).fit(df)


def vectorize(df: DataFrame, spec: TableSpec, settings: VectorSettings = VectorSettings(), out: str = VECTOR) -> DataFrame:
    return vectorizer(df, spec, settings, out).transform(df)


def vector_slots(df: DataFrame, vector: str = VECTOR) -> list[tuple[str, str | None]]:
    """(parent column, level or None) of every vector slot, from the column's metadata."""
    groups = df.schema[vector].metadata["ml_attr"]["attrs"]
    attrs = sorted((a for g in groups.values() for a in g), key=lambda a: a["idx"])
    names = [a["name"].removeprefix("__slot__") for a in attrs]
    return [tuple(n.split(IS, 1)) if IS in n else (n, None) for n in names]
