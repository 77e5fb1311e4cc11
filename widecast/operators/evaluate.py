"""Metrics, confusion matrix, leaderboard and variable importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from widecast.functions import columns as C
from widecast.operators.learner import PREDICT, PROBABILITIES, Model

LOG_FLOOR = 1e-15
HIGHER_IS_BETTER = {"accuracy", "weighted_f1"}
METRICS = ("mean_per_class_error", "logloss", "weighted_f1", "accuracy")


def prediction_distribution(df: DataFrame, predict: str = PREDICT) -> DataFrame:
    return df.groupBy(predict).agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(
    df: DataFrame, label: str, classes: Sequence[str], predict: str = PREDICT, fill_zero: bool = False
) -> DataFrame:
    """One row per actual class, one count column per predicted class; null where no row falls.

    The classes are given, so the pivot needs no extra job to look for them.
    """
    table = df.groupBy(label).pivot(predict, list(classes)).agg(F.count(F.lit(1)))
    return table.fillna(0, subset=list(classes)) if fill_zero else table


def _class_logloss(label: str, classes: Sequence[str], probabilities: str) -> Column:
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int")
    p = F.when(position > 0, F.element_at(probabilities, F.when(position > 0, position).otherwise(1))).otherwise(0.0)
    return -F.log(F.least(F.greatest(p, F.lit(LOG_FLOOR)), F.lit(1.0)))


def pair_counts(
    df: DataFrame, label: str, classes: Sequence[str], by: Sequence[str] = (), predict: str = PREDICT, probabilities: str = PROBABILITIES
) -> DataFrame:
    """(by.., actual, predicted, n, loss): everything the metrics need, from one aggregation."""
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(*by, F.col(label).alias("actual"), F.col(predict).alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_class_logloss(label, classes, probabilities)).alias("loss"))
    )


def class_metrics(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., class, support, hits, precision, recall, f1, error, loss) from the counted pairs."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    nothing = F.lit(0).cast("bigint")

    def side(c: str, support: Column, chosen: Column, hits: Column, loss: Column) -> Column:
        return F.struct(
            F.col(c).alias("class"), support.alias("support"), chosen.alias("chosen"), hits.alias("hits"), loss.alias("loss")
        )

    sides = F.array(
        side("actual", F.col("n"), nothing, hit, F.col("loss")),
        side("predicted", nothing, F.col("n"), nothing, F.lit(0.0)),
    )
    counts = (
        pairs.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, "s.class")
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "chosen", "hits", "loss")])
    )
    precision = F.when(F.col("chosen") > 0, F.col("hits") / F.col("chosen")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("hits") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return counts.select(
        *by,
        "class",
        "support",
        "hits",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        F.when(F.col("support") > 0, 1 - recall).alias("error"),
        "loss",
    )


def metrics_table(
    df: DataFrame, label: str, classes: Sequence[str], by: Sequence[str] = (), predict: str = PREDICT, probabilities: str = PROBABILITIES
) -> DataFrame:
    """(by.., rows, accuracy, logloss, weighted_f1, mean_per_class_error), one row per group.

    One chain of aggregations: the table is scanned, and a lazy model applied, once.
    """
    rows = F.sum("support")
    return (
        class_metrics(pair_counts(df, label, classes, by, predict, probabilities), by)
        .groupBy(*by)
        .agg(
            rows.alias("rows"),
            (F.sum("hits") / rows).alias("accuracy"),
            (F.sum("loss") / rows).alias("logloss"),
            (F.sum(F.col("support") * F.col("f1")) / rows).alias("weighted_f1"),
            F.avg("error").alias("mean_per_class_error"),
        )
    )


def metrics(df: DataFrame, label: str, classes: Sequence[str], **names: str) -> dict[str, float]:
    """The metrics of one scored table."""
    return metrics_table(df, label, classes, **names).first().asDict()


def leaderboard(measured: DataFrame, sort_by: str = "mean_per_class_error", model_column: str = "model_id") -> DataFrame:
    """Rank models; ties go by model name. One row per model, so one window partition is enough."""
    if sort_by not in METRICS:
        raise ValueError(f"unknown metric {sort_by!r}, expected one of {METRICS}")
    order = F.desc(sort_by) if sort_by in HIGHER_IS_BETTER else F.asc(sort_by)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order, model_column))
    return measured.select(rank.alias("rank"), model_column, *METRICS)


def leader(measured: DataFrame, sort_by: str = "mean_per_class_error", model_column: str = "model_id") -> DataFrame:
    return leaderboard(measured, sort_by, model_column).filter(F.col("rank") == 1)


def evaluate(model: Model, df: DataFrame, label: str) -> DataFrame:
    """Score labelled rows and give their confusion matrix."""
    return confusion_matrix(model.transform(df), label, model.classes)


def score_and_evaluate(model: Model, df: DataFrame, label: str) -> tuple[DataFrame, dict[str, float]]:
    """(scored rows, their metrics). The scores are kept, so reading them later is no second run."""
    scored = model.transform(df).persist()
    return scored, metrics(scored, label, model.classes)


def scaled_importance(raw: DataFrame) -> DataFrame:
    """(variable, importance, scaled, share), largest first. One row per variable."""
    everything = Window.partitionBy(F.lit(1))
    top, total = F.max("importance").over(everything), F.sum("importance").over(everything)
    return raw.select(
        "variable",
        "importance",
        F.when(top > 0, F.col("importance") / top).otherwise(0.0).alias("scaled"),
        F.when(total > 0, F.col("importance") / total).otherwise(0.0).alias("share"),
    ).orderBy(F.desc("importance"), "variable")


def var_importance(model: Model, df: DataFrame) -> DataFrame:
    """The model's own importance; an empty table for a family that has none."""
    return scaled_importance(model.importance(df.sparkSession))


def permuted(df: DataFrame, key: str, columns: Sequence[str], seed: int, group_rows: int = 2000) -> DataFrame:
    """Add ``__shuffled_<c>``: each column's values moved to other rows.

    Rows fall into hash groups of about ``group_rows``; inside a group every value moves to the next
    row in hash order and the last one to the first. All values stay, and no group grows with the data.
    """
    groups = max(1, -(-df.count() // group_rows))
    marked = df.withColumn("__group", C.hash_value(key, "permute", seed) % groups).withColumn(
        "__order", C.hash_value(key, "order", seed)
    )
    ordered = Window.partitionBy("__group").orderBy("__order", key)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct(*[F.col(c) for c in columns])
    moved = F.when(F.row_number().over(ordered) == 1, F.last(row).over(whole)).otherwise(F.lag(row).over(ordered))
    out = marked.withColumn("__moved", moved)
    return out.select(df.columns + [F.col(f"__moved.{c}").alias(f"__shuffled_{c}") for c in columns])


def variants(mixed: DataFrame, columns: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Every row of ``permuted`` as it is (``__variant`` 0), and with the i-th feature's moved value (i, from 1)."""
    copies = mixed.withColumn("__variant", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    place = {f: i for i, f in enumerate(features, 1)}
    changed = [
        F.when(F.col("__variant") == place[c], F.col(f"__shuffled_{c}")).otherwise(F.col(c)).alias(c) if c in place else F.col(c)
        for c in columns
    ]
    return copies.select("__variant", *changed)


def permutation_importance(model: Model, df: DataFrame, key: str, label: str, features: Sequence[str], seed: int = 1) -> DataFrame:
    """(variable, importance, scaled, share): rise of the log loss when a feature's values move;
    negative where moving them helps.

    One shuffle moves all features. Each row then stands once as it is and once for each feature with that
    feature's moved value, and all of them go through one scoring plan, whose size does not depend on
    the number of features. ``__variant`` is no column of ``df``.
    """
    from widecast.session import cut_lineage

    labelled = df.filter(F.col(label).isNotNull())
    mixed = cut_lineage(permuted(labelled, key, features, seed))
    together = model.transform(variants(mixed, df.columns, features))
    losses = metrics_table(together, label, model.classes, by=["__variant"]).select("__variant", "logloss").collect()
    found = {r["__variant"]: r["logloss"] for r in losses}
    loss = {f: found[i] for i, f in enumerate(["", *features])}
    rows = [(f, loss[f] - loss[""]) for f in features]
    return scaled_importance(df.sparkSession.createDataFrame(rows, "variable string, importance double"))
