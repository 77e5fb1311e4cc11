"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    header: bool = True,
) -> DataFrame:
    """Parquet or CSV. A CSV without ``schema`` is read twice, once to infer its types."""
    if fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    if fmt == "csv":
        reader = spark.read.option("header", header)
        reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
        return reader.csv(path)
    raise ValueError(f"unknown format {fmt!r}")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = False, single_file: bool = False) -> None:
    """CSV export. ``single_file`` sends every row through one task: for small reports only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", header).csv(path)


def write_counted(df: DataFrame, path: str, name: str = "rows") -> int:
    """Write a table and return its row count from the same job, without a second scan."""
    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def local_table(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """A small driver-side list of rows as a table."""
    return spark.createDataFrame(list(rows), schema)


def schema_table(df: DataFrame) -> DataFrame:
    """The table's schema as rows."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return local_table(df.sparkSession, rows, "position int, column string, type string, nullable boolean")
