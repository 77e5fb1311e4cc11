"""Naive Bayes over mixed columns, as grouped counts and moments.

Categories are smoothed frequencies, numbers are Gaussian, a missing value adds nothing. Fitting is
two aggregations; scoring joins one small level table per category and needs no shuffle as long as
those tables are small enough to broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from widecast.functions import columns as C
from widecast.operators.encode import number_sql, quoted
from widecast.operators.learner import Learner, Model, label_classes, with_prediction
from widecast.operators.prep import require_columns
from widecast.session import written
from widecast.spec import TableSpec

MIN_DEVIATION = 0.001


def class_priors(df: DataFrame, label: str) -> DataFrame:
    """(label, n, prior) of the labelled rows."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per class
    return counts.select("label", "n", (F.col("n") / total).alias("prior"))


def level_counts(df: DataFrame, label: str, categorical: Sequence[str], fold: str | None = None) -> DataFrame:
    """([part,] feature, value, label, n) from one pass; missing values and labels are left out."""
    types = {f.name: f.dataType for f in df.schema.fields}
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), C.category_text(c, types[c]).alias("value")) for c in categorical]
    )
    part = [F.col(fold).cast("int").alias("part")] if fold else []
    return (
        df.filter(F.col(label).isNotNull())
        .select(*part, F.col(label).alias("label"), F.explode(pairs).alias("p"))
        .filter(F.col("p.value").isNotNull())
        .groupBy(*(["part"] if fold else []), "p.feature", "p.value", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def conditionals(counts: DataFrame, classes: Sequence[str], laplace: float, by: Sequence[str] = ()) -> DataFrame:
    """(by.., feature, value, logs): log P(value | class) for every class, seen together or not.

    P = (n + laplace) / (rows of the class with a value + laplace * levels of the feature).
    """
    by = list(by)
    by_class = [
        F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, c in enumerate(classes)
    ]
    levels = counts.groupBy(*by, "feature", "value").agg(*by_class)
    totals = levels.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("levels"), *[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(classes))]
    )
    logs = ", ".join(f"ln((n{i} + {laplace!r}D) / (t{i} + {laplace!r}D * levels))" for i in range(len(classes)))
    # One row per feature on the right.
    joined = levels.join(F.broadcast(totals), [*by, "feature"])
    return joined.select(*by, "feature", "value", F.expr(f"array({logs})").alias("logs"))


def _moment_measures(numeric: Sequence[str]) -> list[Column]:
    measures = []
    for i, c in enumerate(numeric):
        x = number_sql(c)
        measures += [F.expr(f"count({x}) AS n{i}"), F.expr(f"avg({x}) AS m{i}"), F.expr(f"var_samp({x}) AS v{i}")]
    return measures


def moments(df: DataFrame, label: str, numeric: Sequence[str]) -> DataFrame:
    """(label, feature, mean, sd) of every numeric feature, in one pass."""
    lines = [
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.sqrt(F.col(f"v{i}")).alias("sd"))
        for i, c in enumerate(numeric)
    ]
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"))
        .agg(*_moment_measures(numeric))
        .select("label", F.explode(F.array(*lines)).alias("r"))
        .select("label", "r.*")
    )


def merge_moments(parts: Sequence[tuple[int, float | None, float | None]]) -> tuple[float | None, float | None]:
    """(mean, deviation) of the union of groups given as (count, mean, sample variance)."""
    n, mean, square = 0, 0.0, 0.0
    for count, m, v in parts:
        if not count:
            continue
        shift = m - mean
        total = n + count
        square += (v or 0.0) * (count - 1) + shift * shift * n * count / total
        mean += shift * count / total
        n = total
    if not n:
        return None, None
    return mean, math.sqrt(square / (n - 1)) if n > 1 else None


class NaiveBayesModel(Model):
    family = "naive_bayes"

    def __init__(self, classes, categorical, numeric, prior, gauss, levels, params):
        self.classes: list[str] = classes
        self.categorical: list[str] = categorical
        self.numeric: list[str] = numeric
        self.prior: dict[str, float] = prior
        self.gauss: dict[str, list[tuple[float | None, float | None]]] = gauss
        self.levels: DataFrame | None = levels
        self.params = params

    def _gaussian(self, i: int, k: int) -> str | None:
        """Log density of numeric feature ``i`` in class ``k``; 0 for a missing value.

        ``__x`` and ``__has`` are never null, so the generated code is plain arithmetic.
        """
        mean, sd = self.gauss[self.numeric[i]][k]
        if mean is None:
            return None
        sd = max(sd or 0.0, MIN_DEVIATION)
        constant = -0.5 * math.log(2 * math.pi * sd * sd)
        return f"`__has{i}` * ({constant!r}D - (`__x{i}` - {mean!r}D) * (`__x{i}` - {mean!r}D) * {0.5 / (sd * sd)!r}D)"

    def log_scores(self, df: DataFrame, out: str = "log_scores") -> DataFrame:
        """Array of log prior plus the sum of log conditionals, per class."""
        require_columns(df, [*self.categorical, *self.numeric])
        types = {f.name: f.dataType for f in df.schema.fields}
        columns = df.columns
        n = len(self.classes)
        ready = []
        for i, f in enumerate(self.numeric):
            x = number_sql(f)
            ready += [f"coalesce({x}, 0.0D) AS `__x{i}`", f"CASE WHEN {x} IS NULL THEN 0.0D ELSE 1.0D END AS `__has{i}`"]
        scores = []
        for k, c in enumerate(self.classes):
            terms = [f"{math.log(self.prior[c])!r}D", *(self._gaussian(i, k) for i in range(len(self.numeric)))]
            terms += [f"coalesce(`__l{i}_{k}`, 0.0D)" for i in range(len(self.categorical))]
            scores.append(" + ".join(t for t in terms if t))
        df = df.selectExpr(*map(quoted, columns), *ready)
        for i, c in enumerate(self.categorical):
            table = self.levels.filter(F.col("feature") == c).selectExpr(
                f"value AS `__value{i}`", *[f"logs[{k}] AS `__l{i}_{k}`" for k in range(n)]
            )
            df = df.join(table, C.category_text(c, types[c]) == F.col(f"__value{i}"), "left")
        return df.select(*columns, F.expr(f"array({', '.join(scores)})").alias(out))

    def transform(self, df: DataFrame) -> DataFrame:
        return with_prediction(self.log_scores(df, "__scores"), "__scores", self.classes)

    def save(self, path: str) -> None:
        from widecast.sources.models import write_meta

        spark = SparkSession.active()
        meta = {
            "family": self.family,
            "classes": self.classes,
            "categorical": self.categorical,
            "numeric": self.numeric,
            "prior": self.prior,
            "gauss": self.gauss,
            "params": self.params,
        }
        write_meta(spark, path, meta)
        if self.levels is not None:
            # By feature, as scoring reads them.
            self.levels.write.mode("overwrite").partitionBy("feature").parquet(f"{path}/levels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NaiveBayesModel:
        from widecast.sources.models import read_meta

        m = read_meta(spark, path)
        levels = spark.read.schema("value string, logs array<double>, feature string").parquet(f"{path}/levels") if m["categorical"] else None
        gauss = {f: [tuple(p) for p in pairs] for f, pairs in m["gauss"].items()}
        return cls(m["classes"], m["categorical"], m["numeric"], m["prior"], gauss, levels, m["params"])


@dataclass
class Statistics:
    """What naive Bayes counts: rows and moments by part and class, and a stored table of level counts."""

    classes: list[str]
    grouped: list
    counts: DataFrame | None
    by_fold: bool


@dataclass(frozen=True, kw_only=True)
class NaiveBayesLearner(Learner):
    family: ClassVar[str] = "naive_bayes"
    spec: TableSpec
    name: str = "naive_bayes"
    laplace: float = 0.1
    classes: tuple[str, ...] | None = None

    def preparation(self) -> Hashable:
        return "counts", repr(self.spec), self.classes

    def prepare(self, df: DataFrame, fold: str | None = None) -> Statistics:
        """Counts and moments, kept per fold if there is one: two passes whatever the number of models."""
        spec = self.spec
        classes = list(self.classes or label_classes(df, spec.label))
        part = F.col(fold) if fold else F.lit(0)
        grouped = (
            df.filter(F.col(spec.label).isNotNull())
            .groupBy(part.cast("int").alias("part"), F.col(spec.label).alias("label"))
            .agg(F.count(F.lit(1)).alias("n"), *_moment_measures(spec.numeric))
            .collect()  # folds x classes rows
        )
        counts = written(level_counts(df, spec.label, spec.categorical, fold), "level-counts") if spec.categorical else None
        return Statistics(classes, grouped, counts, fold is not None)

    def fit_prepared(self, prepared: Statistics) -> NaiveBayesModel:
        return self.models(prepared, [None])[0]

    def fit_folds(self, df: DataFrame, k: int, fold: str) -> list[NaiveBayesModel]:
        """The ``k`` leave-one-fold-out models from the same two passes one fit needs."""
        return self.models(self.prepare(df, fold), list(range(k)))

    def models(self, found: Statistics, left_out: Sequence[int | None]) -> list[NaiveBayesModel]:
        """A model for each fold to leave out, or (None) of all rows; each adds up the others' counts and moments."""
        levels, by = None, ["model"] if len(left_out) > 1 else []
        if found.counts is not None:
            counts = found.counts
            if by:  # every count goes to the models that leave another fold out
                others = F.filter(F.array(*[F.lit(i) for i in left_out]), lambda i: i != F.col("part"))
                counts = counts.withColumn("model", F.explode(others))
            elif left_out[0] is not None:
                counts = counts.filter(F.col("part") != left_out[0])
            # Stored by feature: a join reads its own levels only, and is a broadcast if their bytes allow it.
            levels = written(conditionals(counts, found.classes, self.laplace, by), "levels", [*by, "feature"])
        out = []
        for i in left_out:
            own = levels.filter(F.col("model") == i).drop("model") if levels is not None and by else levels
            out.append(self._model(found.classes, [r for r in found.grouped if i is None or r["part"] != i], own))
        return out

    def _model(self, classes: list[str], grouped: list, levels: DataFrame | None) -> NaiveBayesModel:
        spec = self.spec
        rows = {c: [r for r in grouped if r["label"] == c] for c in classes}
        n = {c: sum(r["n"] for r in rows[c]) for c in classes}
        absent = [c for c in classes if not n[c]]
        if absent:
            raise ValueError(f"classes without a labelled row: {absent}")
        prior = {c: n[c] / sum(n.values()) for c in classes}
        gauss = {
            f: [merge_moments([(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]) for r in rows[c]]) for c in classes]
            for i, f in enumerate(spec.numeric)
        }
        return NaiveBayesModel(classes, spec.categorical, spec.numeric, prior, gauss, levels, self.params())
