"""Levels of category columns as a stored table: one row for each column and level, numbered by Spark.

No list of levels passes through the driver. Levels are sorted in ranges, which hold about equally many
whatever column they belong to; a level's number is its place in its range plus the sizes of the ranges
before. A column is numbered by a join with its part of the table, whose bytes the planner knows: small
ones are broadcast, others shuffled, and values that fill the table are split by the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from widecast.session import written

SCHEMA = "value string, n bigint, index bigint, feature string"


def counted(df: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """``feature, value, n`` of the levels of all columns, from one pass; ``texts`` has each column's SQL. Nulls are none."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.expr(e).alias("value")) for c, e in texts.items()])
    found = df.select(F.explode(pairs).alias("p")).select("p.*").filter("value IS NOT NULL")
    return found.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def in_ranges(counts: DataFrame, by_frequency: bool) -> DataFrame:
    """``counts`` in ranges of the order within each feature, with each level's range and its place in it from 1."""
    order = [F.col("feature"), *([F.col("n").desc()] if by_frequency else []), F.col("value")]
    dealt = counts.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("feature", "range").orderBy(*order[1:]))
    return dealt.select("value", "n", "range", inside.cast("long").alias("inside"), "feature")


@dataclass
class Levels:
    """The levels of some columns: their SQL, how many they are, and the tables (``value, n, index``) of each."""

    texts: dict[str, str]
    sizes: dict[str, int]
    tables: dict[str, DataFrame]

    @classmethod
    def learn(cls, df: DataFrame, texts: Mapping[str, str], by_frequency: bool = False) -> Levels:
        """Levels of the columns in ``texts``; a column without a value has none."""
        if not texts:
            return cls({}, {}, {})
        # Stored with their ranges, which must stay as they are once their sizes are taken.
        stored = written(in_ranges(counted(df, texts), by_frequency), "levels", ["feature"], gathered=True)
        before: dict[str, dict[int, int]] = {c: {} for c in texts}
        sizes = dict.fromkeys(texts, 0)
        # A row for each column and range of the sort.
        for c, r, n in sorted(map(tuple, stored.groupBy("feature", "range").agg(F.count("*")).collect())):
            before[c][r] = sizes[c]
            sizes[c] += n
        tables = {}
        for c in texts:
            steps = F.lit(0) if len(before[c]) < 2 else F.create_map(*[F.lit(x) for pair in before[c].items() for x in pair])[F.col("range")]
            tables[c] = stored.filter(F.col("feature") == c).select("value", "n", (F.col("inside") - 1 + steps).alias("index"))
        return cls(dict(texts), sizes, tables)

    def indexed(self, df: DataFrame, names: Mapping[str, str]) -> DataFrame:
        """``df`` with the number of each column's level under the given name; null if missing or unseen."""
        for i, (c, name) in enumerate(names.items()):
            value = f"__level{i}"
            own = self.tables[c].select(F.col("value").alias(value), F.col("index").alias(name))
            df = df.join(own, F.expr(self.texts[c]) == F.col(value), "left").drop(value)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``<column>_index`` for every column; missing and unseen values share the number after the last."""
        out = self.indexed(df, {c: f"{c}_index" for c in self.texts})
        return out.withColumns({f"{c}_index": F.coalesce(F.col(f"{c}_index"), F.lit(n)).cast("double") for c, n in self.sizes.items()})

    def labels(self, column: str, most: int) -> list[str]:
        """The first ``most`` levels of a column in order of their number."""
        rows = self.tables[column].filter(F.col("index") < most).select("index", "value").collect()
        return [v for _, v in sorted(map(tuple, rows))]

    def save(self, path: str) -> None:
        """One table of all columns, in folders by column."""
        whole = [t.withColumn("feature", F.lit(c)) for c, t in self.tables.items()]
        if whole:
            reduce(DataFrame.unionByName, whole).write.mode("overwrite").partitionBy("feature").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, texts: Mapping[str, str], sizes: Mapping[str, int]) -> Levels:
        if not texts:
            return cls({}, {}, {})
        whole = spark.read.schema(SCHEMA).parquet(path)
        return cls(dict(texts), dict(sizes), {c: whole.filter(F.col("feature") == c).drop("feature") for c in texts})
