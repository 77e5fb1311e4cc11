"""From the raw wide table to the labelled and the to-score table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from widecast import presets as P
from widecast.functions import columns as C
from widecast.operators.prep import conform, project, require_columns, split_by_label
from widecast.sources.tables import write_counted


def derive(raw: DataFrame) -> DataFrame:
    """Quantize the points, count the used apps, take the differences, and conform to the schema.

    All derived columns are made in one projection; the raw columns they replace go with it.
    """
    source, level = P.POINT_COLUMN
    require_columns(raw, [source, *P.VISIT_COLUMNS, *(c for pair in P.DIFFERENCES.values() for c in pair)])
    made = {
        level: C.point_level(source),
        "app_cnt": C.positive_count(P.VISIT_COLUMNS),
        **{out: C.difference(a, b).cast("int") for out, (a, b) in P.DIFFERENCES.items()},
    }
    kept = [f for f in P.conformed_schema().fields if f.name not in made]
    require_columns(raw, [f.name for f in kept])
    out = raw.select(*[f.name for f in kept], *[c.alias(name) for name, c in made.items()])
    return conform(out, P.conformed_schema())


def with_products(df: DataFrame) -> DataFrame:
    return df.withColumns({out: C.product(a, b) for out, (a, b) in P.PRODUCTS.items()})


@dataclass
class Prepared:
    labelled: DataFrame
    to_score: DataFrame
    rows_to_score: int | None


def prepare(df: DataFrame, to_score_path: str | None = None) -> Prepared:
    """Part the rows by null label; the rows to score are written, and counted on the way."""
    to_score, labelled = split_by_label(df, P.LABEL)
    n = write_counted(to_score, to_score_path) if to_score_path else None
    return Prepared(labelled, to_score, n)


def prepare_model_table(df: DataFrame, to_score_path: str | None = None) -> Prepared:
    """The 90 model columns with key and label, parted by null label."""
    return prepare(project(df, P.KEY, P.model_columns(), P.LABEL), to_score_path)


def model_table_categories() -> list[str]:
    """The model-table columns that are read as categories."""
    return list(P.CATEGORY_COLUMNS)


def row_counts(prepared: Prepared) -> DataFrame:
    """Rows of both tables in one job."""
    both = prepared.labelled.select(F.lit("labelled").alias("part")).unionByName(
        prepared.to_score.select(F.lit("to_score").alias("part"))
    )
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
