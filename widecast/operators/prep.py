"""Projections, row splits and derived columns of a wide table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F, types as T

from widecast.functions import columns as C
from widecast.spec import TableSpec


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {absent}")


def project(df: DataFrame, key: str, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """Key, the named columns and the label; an error names every column that is absent."""
    wanted = [key, *columns, *([label] if label else [])]
    require_columns(df, wanted)
    return df.select(*wanted)


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def split_by_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows to score, labelled rows). Both are filters that reach the Parquet scan."""
    return df.filter(F.col(label).isNull()), df.filter(F.col(label).isNotNull())


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order, widened where no value is lost; extras go."""
    return df.to(schema)


def add_difference(df: DataFrame, out: str, a: str, b: str, drop: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(out, C.difference(a, b)).drop(*drop)


def count_positive(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    require_columns(df, columns)
    return df.withColumn(out, C.positive_count(columns))


def add_product(df: DataFrame, out: str, a: str, b: str) -> DataFrame:
    return df.withColumn(out, C.product(a, b))


def quantize_points(df: DataFrame, column: str, out: str, mode: str = "keep") -> DataFrame:
    """Point balance to its bucket by closed form."""
    return df.withColumn(out, C.point_level(column, mode))


def quantize(df: DataFrame, column: str, out: str, splits: Sequence[float]) -> DataFrame:
    """Bucket index for any increasing ``splits``; out-of-range gives null, NaN the extra bucket."""
    held = f"__{out}_in_range"
    x = F.col(column).cast("double")
    inside = F.isnan(x) | ((x >= splits[0]) & (x <= splits[-1]))
    bucketizer = Bucketizer(splits=list(splits), inputCol=held, outputCol=out, handleInvalid="keep")
    return bucketizer.transform(df.withColumn(held, F.when(inside, x))).drop(held)


def apply_spec(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Every column of the spec by name, in the type its kind calls for."""
    require_columns(df, [f.name for f in spec.features])
    types = {f.name: f.dataType for f in df.schema.fields}
    cast = {
        "text": lambda n: F.col(n).cast("string"),
        "picklist": lambda n: C.category_text(n, types[n]),
        "real": lambda n: F.col(n).cast("double"),
        "integral": lambda n: F.col(n).cast("bigint"),
    }
    return df.select(*[cast[f.kind](f.name).alias(f.name) for f in spec.features])


def lenient_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns to doubles; what is no number becomes null."""
    require_columns(df, columns)
    return df.withColumns({c: C.lenient_number(c) for c in columns})


def known_levels_only(df: DataFrame, column: str, levels: DataFrame, level_column: str = "level") -> DataFrame:
    """Null out the values of ``column`` that are not in ``levels``.

    The planner broadcasts the level table if its measured bytes allow it; else its keys are unique, so
    the adaptive skew join can split a hot value on the left.
    """
    known = levels.select(F.col(level_column).alias("__level")).distinct()
    joined = df.join(known, df[column] == known["__level"], "left")
    return joined.withColumn(column, F.col("__level")).drop("__level")


def times_as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: C.time_text(c, types[c]) for c in columns})
