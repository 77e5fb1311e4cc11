"""Multi-class gradient boosting as grouped aggregations.

Each round grows one regression tree per class on the softmax gradients. Columns are binned once, by
saved ``pyspark.ml`` stages. One tree level, for all classes together, is one Spark job:

1. every task sums gradients of its rows by (class, node, column, bin);
2. the partial sums are grouped, and cumulative window sums give each candidate split's gain;
3. the best split per (class, node) comes back: at most classes x 2^level rows.

So a round costs ``depth`` passes over the binned table whatever the class count, and the shuffle holds
sums and never rows. Rows carry their margins, brought up to date once a round, so a level costs the same
however many trees there are; every ``checkpoint_interval`` rounds the rows are stored. Of two sibling
nodes only the one with fewer rows is summed, and the other's sums are their parent's less those.

``gradient`` mode splits on the variance of the residuals and sets leaves by one Newton step
(Friedman 2001); ``newton`` mode uses second-order gains and leaves (Chen & Guestrin 2016).
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, ClassVar

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from widecast.functions import columns as C
from widecast.operators.encode import category_sql, number_sql, quoted
from widecast.operators.levels import Levels
from widecast.operators.learner import Learner, Model, label_classes, with_prediction
from widecast.operators.sample import column_sample, row_sample
from widecast.operators.walk import BINS, bin_set, gradient_sums, joined_sets, margins_from_prior, margins_from_stored, walk
from widecast.session import cut_lineage, written
from widecast.sources.models import read_meta, write_meta
from widecast.spec import TableSpec

SKETCH_COLUMNS = 100
SKETCH_TASKS = 64
SKETCH_POINTS = 2_000
SKETCH_ACCURACY = 10_000
#: One step of a sketch's points, and the sketch's own error.
RANK_ERROR = 1 / SKETCH_POINTS + 1 / SKETCH_ACCURACY
STORED_LEVELS = 3  # one level in so many has its sums stored
MIDDLE_TASKS = 64  # tasks whose sums are added before the final sums
WIDE_BINS = 20_000  # more bins than that of a column are sorted over several tasks; at most 2^15, a bitmap
MAX_BINS = 62  # of a numeric column, with the one for missing values; a category has one for each level
TREE_SCHEMA = T.StructType(
    [
        T.StructField("round", T.IntegerType(), False),
        T.StructField("class", T.IntegerType(), False),
        T.StructField("node", T.IntegerType(), False),
        T.StructField("feature", T.IntegerType(), False),
        T.StructField("left", T.ArrayType(T.LongType(), False), False),
        T.StructField("value", T.DoubleType(), False),
        T.StructField("gain", T.DoubleType(), False),
        T.StructField("rows", T.DoubleType(), False),
    ]
)
SUMS_SCHEMA = "class int, node int, feature int, bin int, g double, h double, n double"


# ---------------------------------------------------------------- binning


def bin_edges(df: DataFrame, numeric: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Inner bin edges of all numeric columns: values at equal steps of rank, up to ``RANK_ERROR`` of the rows off.

    Each column is sketched by groups of ``SKETCH_TASKS`` tasks. A column's sketches are merged as one
    list of values, each with the weight of the rows it stands for, so the largest task of the merge reads
    one column's sketches.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    known: dict[str, list[float]] = {c: [] for c in numeric}
    points = [i / SKETCH_POINTS for i in range(1, SKETCH_POINTS + 1)]
    # Above some hundred groups Spark would sort the rows instead of keeping a sketch for each.
    for at in range(0, len(numeric), SKETCH_COLUMNS):
        some = numeric[at : at + SKETCH_COLUMNS]
        values = F.array(*[F.struct(F.lit(i).alias("feature"), C.clean_number(c, types[c]).alias("value")) for i, c in enumerate(some)])
        rows = df.select(F.floor(F.spark_partition_id() / SKETCH_TASKS).alias("tasks"), F.explode(values).alias("v")).select("tasks", "v.*")
        sketches = rows.filter("value IS NOT NULL").groupBy("feature", "tasks").agg(F.percentile_approx("value", points, SKETCH_ACCURACY).alias("q"), F.count("*").alias("n"))
        upto = Window.partitionBy("feature").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        weights = sketches.select("feature", "n", F.explode("q").alias("value")).groupBy("feature", "value").agg(F.sum("n").alias("n"))
        steps = weights.select("feature", "value", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy("feature")).alias("all"))
        crossed = f"(upto - n) * {bins} div all < least(upto * {bins} div all, {bins - 1})"
        for r in steps.filter(crossed).select("feature", "value").collect():  # fewer than ``bins`` rows for each column
            known[some[r["feature"]]].append(r["value"])
    return {c: sorted(v) for c, v in known.items()}


@dataclass
class Binner:
    """Adds ``__bins``: one small integer per predictor, 0 for missing or unseen.

    Numbers fall between edges; every level of a category has a bin of its own, numbered by frequency
    in a stored table that is joined to the rows.
    """

    numeric: list[str]
    numbers: PipelineModel
    levels: Levels

    @property
    def sizes(self) -> list[int]:
        """Number of bins of every predictor, the one for missing values included."""
        splits = [len(s) for stage in self.numbers.stages if isinstance(stage, Bucketizer) for s in stage.getSplitsArray()]
        return splits + [n + 1 for n in self.levels.sizes.values()]

    def transform(self, df: DataFrame) -> DataFrame:
        marks = {c: f"__i{i}" for i, c in enumerate(self.levels.texts)}
        binned = self.levels.indexed(self.numbers.transform(df), marks)
        slots = [f"coalesce(`__b{i}` + 1, 0)" for i in range(len(self.numeric))] + [f"coalesce(`{m}` + 1, 0)" for m in marks.values()]
        whole = "SMALLINT" if max(self.sizes, default=0) < 2**15 else "INT"
        return binned.selectExpr(*map(quoted, df.columns), f"array({', '.join(f'CAST({s} AS {whole})' for s in slots)}) AS {BINS}")

    def meta(self) -> dict[str, Any]:
        return {"numeric": self.numeric, "levels": [[c, e, self.levels.sizes[c]] for c, e in self.levels.texts.items()]}

    def save(self, path: str) -> None:
        self.numbers.write().overwrite().save(f"{path}/numbers")
        self.levels.save(f"{path}/levels")

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: Mapping[str, Any]) -> Binner:
        levels = Levels.load(spark, f"{path}/levels", {c: e for c, e, _ in meta["levels"]}, {c: n for c, _, n in meta["levels"]})
        return cls(meta["numeric"], PipelineModel.load(f"{path}/numbers"), levels)


def fit_binner(df: DataFrame, spec: TableSpec, max_bins: int = MAX_BINS, edges: Mapping[str, Sequence[float]] | None = None) -> Binner:
    """Learn the edges of numeric columns, for ``max_bins`` bins at most, and the levels of categories."""
    if max_bins < 3:
        raise ValueError("max_bins must be 3 or more")
    numeric, categorical = spec.numeric, spec.categorical
    types = {f.name: f.dataType for f in df.schema.fields}
    known = dict(edges or {})
    known |= bin_edges(df, [c for c in numeric if c not in known], max_bins - 1)
    stages: list = []
    if numeric:
        inf = float("inf")
        stages = [
            SQLTransformer(statement=f"SELECT *, {', '.join(f'{number_sql(c)} AS `__x{i}`' for i, c in enumerate(numeric))} FROM __THIS__"),
            Bucketizer(
                inputCols=[f"__x{i}" for i in range(len(numeric))],
                outputCols=[f"__b{i}" for i in range(len(numeric))],
                # Spark wants at least three splits; a constant column gets one harmless edge.
                splitsArray=[[-inf, *(known[c] or [0.0]), inf] for c in numeric],
                handleInvalid="keep",
            ),
        ]
    levels = Levels.learn(df, {c: category_sql(c, types[c]) for c in categorical}, by_frequency=True)
    return Binner(list(numeric), Pipeline(stages=stages).fit(df), levels)


# ---------------------------------------------------------------- trees


@dataclass
class Tree:
    """One tree in heap order: children of node i are 2i+1 (left) and 2i+2."""

    round: int
    klass: int
    feature: np.ndarray  # -1 for a leaf
    left: list[np.ndarray]  # of every node the set of bins that go left, one bit each in 64-bit words
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    @classmethod
    def empty(cls, round_no: int, klass: int, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(round_no, klass, np.full(n, -1, np.int32), [np.zeros(0, np.int64)] * n, *(np.zeros(n) for _ in range(3)))

    def plain(self) -> tuple:
        """What a task needs, as arrays."""
        return self.klass, self.feature, joined_sets(self.left), self.value

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of every row after at most ``levels`` steps."""
        return walk(self.feature, joined_sets(self.left), bins, levels)

    def to_rows(self) -> list[tuple]:
        used = [0]
        for i in used:
            if self.feature[i] >= 0:
                used += [2 * i + 1, 2 * i + 2]
        return [
            (self.round, self.klass, i, int(self.feature[i]), self.left[i].tolist(), float(self.value[i]), float(self.gain[i]), float(self.rows[i]))
            for i in used
        ]


def margin_column(spark: SparkSession, prior: Sequence[float], trees: Sequence[Tree], depth: int, width: int, stored: bool) -> Column:
    """Array of margins from ``__bins`` (and the stored margins ``__f``). The trees travel as a broadcast;
    their size is bounded by the settings (rounds x classes x 2^depth nodes), not by the data."""
    shared = spark.sparkContext.broadcast((np.asarray(prior, float), [t.plain() for t in trees]))
    if stored:
        return F.arrow_udf(margins_from_stored(shared, depth, width), "array<double>")(F.col(BINS), F.col("__f"))
    return F.arrow_udf(margins_from_prior(shared, depth, width), "array<double>")(F.col(BINS))


# ---------------------------------------------------------------- one level


def combined(sums: DataFrame, tasks: int, least: float) -> DataFrame:
    """One row for each (class, node, column, bin), dealt out by column.

    Of very many tasks, the sums of some are added first, so that no column waits for one task to read
    them all. What is left of a difference of equal sums has less weight than any row, and goes.
    """
    measures = [F.sum(c).alias(c) for c in "ghn"]
    if tasks > MIDDLE_TASKS:
        some = sums.withColumn("tasks", F.floor(F.spark_partition_id() / MIDDLE_TASKS))
        sums = some.repartition("class", "node", "feature", "tasks").groupBy("class", "node", "feature", "bin", "tasks").agg(*measures)
    # One exchange by column serves the grouping and the windows.
    whole = sums.repartition("class", "node", "feature").groupBy("class", "node", "feature", "bin").agg(*measures)
    return whole.filter(F.col("n") > least / 2)


def placed(cells: DataFrame, n_numeric: int, newton: bool, reg_lambda: float) -> DataFrame:
    """Cells with their place among their column's: numbers by bin, categories by mean gradient."""
    return cells.selectExpr("*", f"CASE WHEN feature < {n_numeric} THEN CAST(bin AS DOUBLE) ELSE round(g / {side('h', 'n', newton, reg_lambda)}, 10) END AS place")


def side(h: str, n: str, newton: bool, reg_lambda: float) -> str:
    return f"({h} + {reg_lambda!r}D)" if newton else f"({n})"


def running(cells: DataFrame, n_numeric: int, wide: bool) -> DataFrame:
    """Cells with the sums up to each (``lg``...), of the column (``tg``...) and of its missing values (``mg``...).

    A column's cells are one window; if some have very many (``wide``), cells are sorted in ranges, a
    window goes over the part of a column in a range, and the sums of the ranges before are added.
    """
    missing = [f"CASE WHEN feature < {n_numeric} AND bin = 0 THEN {c} ELSE 0.0D END" for c in "ghn"]
    key = "class, node, feature"
    if not wide:
        whole = f"OVER (PARTITION BY {key})"
        upto = f"OVER (PARTITION BY {key} ORDER BY place, bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        sums = [s for c, m in zip("ghn", missing) for s in (f"sum({c}) {upto} AS l{c}", f"sum({c}) {whole} AS t{c}", f"sum({m}) {whole} AS m{c}")]
        return cells.selectExpr("class", "node", "feature", "bin", "place", *sums)
    # The ranges must stay as they are once their sums are taken.
    dealt = written(cells.repartitionByRange("class", "node", "feature", "place", "bin").withColumn("range", F.spark_partition_id()), "split-ranges")
    ranges = dealt.groupBy("class", "node", "feature", "range").agg(*[F.expr(f"sum({c})").alias(f"r{c}") for c in "ghn"], *[F.expr(f"sum({m})").alias(f"o{c}") for c, m in zip("ghn", missing)])
    earlier = f"OVER (PARTITION BY {key} ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = f"OVER (PARTITION BY {key})"
    sums = [s for c in "ghn" for s in (f"coalesce(sum(r{c}) {earlier}, 0.0D) AS b{c}", f"sum(r{c}) {whole} AS t{c}", f"sum(o{c}) {whole} AS m{c}")]
    before = ranges.selectExpr("class", "node", "feature", "range", *sums)
    upto = f"OVER (PARTITION BY {key}, range ORDER BY place, bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inside = dealt.join(before, ["class", "node", "feature", "range"])
    return inside.selectExpr("class", "node", "feature", "bin", "place", *[s for c in "ghn" for s in (f"b{c} + sum({c}) {upto} AS l{c}", f"t{c}", f"m{c}")])


def best_splits(
    cells: DataFrame, n_numeric: int, mode: str, reg_lambda: float, min_rows: float, min_child_weight: float, rows: float, wide: bool = False
) -> DataFrame:
    """(class, node) with its sums, its best split and the levels that go left, from the ``placed`` cells.

    Numeric columns are cut between bins, with missing values tried on both sides; category bins are
    ordered by their mean gradient. Gains are compared per training row and to ten decimals,
    so that the order of floating-point additions does not decide between equal splits.
    """
    newton = mode == "newton"
    is_number = f"feature < {n_numeric}"

    def weight(g: str, h: str, n: str) -> str:
        return f"try_divide(({g}) * ({g}), {side(h, n, newton, reg_lambda)})"

    def candidate(missing_left: bool) -> str:
        gl, hl, nl = (f"l{c}" if missing_left else f"(l{c} - m{c})" for c in "ghn")
        gr, hr, nr = f"(tg - {gl})", f"(th - {hl})", f"(tn - {nl})"
        least = max(float(min_rows), 1e-9)
        allowed = f"{nl} >= {least!r}D AND {nr} >= {least!r}D"
        if newton:
            allowed += f" AND {hl} >= {float(min_child_weight)!r}D AND {hr} >= {float(min_child_weight)!r}D"
        if not missing_left:
            allowed += f" AND {is_number} AND mn > 0"
        gain = f"({weight(gl, hl, nl)} + {weight(gr, hr, nr)} - {weight('tg', 'th', 'tn')})"
        # Without missing values in the node, they go to the larger side.
        zero = f"(mn > 0 OR {nl} >= {nr})" if missing_left else "false"
        return f"""named_struct(
            'score', CASE WHEN {allowed} THEN round({gain} / {float(rows)!r}D, 10) ELSE -1.0D END,
            'minus_feature', -feature, 'minus_bin', -bin,
            'zero_left', {zero}, 'gain', {gain}, 'lg', {gl}, 'lh', {hl}, 'ln', {nl}, 'tg', tg, 'th', th, 'tn', tn, 'place', place)"""

    sums = running(cells, n_numeric, wide)
    bits = "bitmap_construct_agg(bitmap_bit_position(bin + 1))"
    if not wide:
        # The column's best cut first, then the levels up to it, and at last the best column, all on one exchange.
        whole = "OVER (PARTITION BY class, node, feature)"
        cut = sums.selectExpr("class", "node", "feature", "bin", "place", f"greatest(max({candidate(True)}) {whole}, max({candidate(False)}) {whole}) AS b")
        goes_left = f"NOT ({is_number}) AND (place < b.place OR place = b.place AND bin <= -b.minus_bin)"
        by_column = cut.groupBy("class", "node", "feature").agg(F.first("b").alias("b"), F.expr(f"{bits} FILTER (WHERE {goes_left})").alias("bits"))
        sets = f"CASE WHEN NOT ({is_number}) THEN array(named_struct('block', 1L, 'bits', bits)) END AS sets"
        best = by_column.selectExpr("class", "node", "b", sets).groupBy("class", "node").agg(F.expr("max_by(struct(b, sets), b)").alias("m"))
        return best.selectExpr("class", "node", "-m.b.minus_feature AS feature", "-m.b.minus_bin AS bin", "m.sets", "m.b.*")
    best = sums.groupBy("class", "node").agg(F.expr(f"greatest(max({candidate(True)}), max({candidate(False)}))").alias("b"))
    best = best.selectExpr("class", "node", "-b.minus_feature AS feature", "-b.minus_bin AS bin", "b.*")
    # The levels up to a category's cut, in numbered bitmaps made in the tasks. At most classes x 2^level rows are broadcast.
    at = best.filter(f"score > 0 AND NOT ({is_number})").selectExpr("class", "node", "feature", "bin AS cut_bin", "place AS cut_place")
    left = cells.join(F.broadcast(at), ["class", "node", "feature"]).filter("place < cut_place OR place = cut_place AND bin <= cut_bin")
    blocks = left.groupBy("class", "node", F.expr("bitmap_bucket_number(bin + 1)").alias("block")).agg(F.expr(bits).alias("bits"))
    return best.join(blocks.groupBy("class", "node").agg(F.collect_list(F.struct("block", "bits")).alias("sets")), ["class", "node"], "left")


def words_of_bitmaps(bitmaps: Sequence) -> np.ndarray:
    """Numbered bitmaps of equal size as one run of 64-bit words."""
    parts = {b["block"]: np.frombuffer(bytes(b["bits"]), "<i8") for b in bitmaps}
    none = np.zeros(len(next(iter(parts.values()))), np.int64)
    return np.trim_zeros(np.concatenate([parts.get(i, none) for i in range(1, max(parts) + 1)]), "b")


# ---------------------------------------------------------------- model and learner


class BoostModel(Model):
    family = "boost"

    def __init__(self, classes, params, columns, prior, depth, binner, trees):
        self.classes: list[str] = classes
        self.params: dict[str, Any] = params
        self.columns: list[str] = columns
        self.prior: list[float] = prior
        self.depth: int = depth
        self.binner: Binner = binner
        self.trees: list[Tree] = trees

    def transform(self, df: DataFrame) -> DataFrame:
        margins = margin_column(df.sparkSession, self.prior, self.trees, self.depth, len(self.columns), stored=False)
        scored = self.binner.transform(df).withColumn("__scores", margins).drop(BINS)
        return with_prediction(scored, "__scores", self.classes)

    def importance(self, spark: SparkSession) -> DataFrame:
        """Summed gain of the splits on each column."""
        total = dict.fromkeys(self.columns, 0.0)
        for t in self.trees:
            for i in np.flatnonzero(t.feature >= 0):
                total[self.columns[t.feature[i]]] += float(t.gain[i])
        return spark.createDataFrame(list(total.items()), "variable string, importance double")

    def tree_table(self, spark: SparkSession) -> DataFrame:
        """The trees as rows: (round, class, node, feature, left, value, gain, rows)."""
        return spark.createDataFrame([r for t in self.trees for r in t.to_rows()], TREE_SCHEMA)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        write_meta(
            spark,
            path,
            {
                "family": self.family,
                "classes": self.classes,
                "params": self.params,
                "columns": self.columns,
                "prior": self.prior,
                "depth": self.depth,
                "binner": self.binner.meta(),
            },
        )
        self.binner.save(f"{path}/binner")
        self.tree_table(spark).write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostModel:
        m = read_meta(spark, path)
        trees: dict[tuple[int, int], Tree] = {}
        for r in spark.read.parquet(f"{path}/trees").collect():  # bounded by the model's settings
            t = trees.setdefault((r["round"], r["class"]), Tree.empty(r["round"], r["class"], m["depth"]))
            i = r["node"]
            t.feature[i], t.left[i], t.value[i], t.gain[i], t.rows[i] = r["feature"], np.array(r["left"], np.int64), r["value"], r["gain"], r["rows"]
        ordered = [trees[k] for k in sorted(trees)]
        return cls(m["classes"], m["params"], m["columns"], m["prior"], m["depth"], Binner.load(spark, f"{path}/binner", m["binner"]), ordered)


@dataclass
class Binned:
    """Labelled rows as cached bins (``__y, __w, __bins`` and, for row samples, ``__key``)."""

    classes: list[str]
    binner: Binner
    rows: DataFrame


@dataclass(frozen=True, kw_only=True)
class BoostLearner(Learner):
    family: ClassVar[str] = "boost"
    spec: TableSpec
    name: str = "boost"
    classes: tuple[str, ...] | None = None
    mode: str = "gradient"
    rounds: int = 120
    depth: int = 8
    eta: float = 0.1
    annealing: float = 1.0
    row_rate: float = 1.0
    column_rate: float = 1.0
    min_rows: float = 10.0
    min_child_weight: float = 1.0
    reg_lambda: float = 1.0
    max_bins: int = MAX_BINS
    edges: tuple[tuple[str, tuple[float, ...]], ...] = ()
    weight: str | None = None
    seed: int = 42
    checkpoint_interval: int = 10

    def __post_init__(self) -> None:
        if self.mode not in ("gradient", "newton"):
            raise ValueError(f"unknown mode {self.mode!r}")

    @property
    def _min_rows(self) -> float:
        return self.min_rows if self.mode == "gradient" else 0.0

    def _leaf(self, g: float, h: float, k: int) -> float:
        if self.mode == "newton":
            return -g / (h + self.reg_lambda)
        return -g / max(h, 1e-12) * (k - 1) / k

    def preparation(self) -> Hashable:
        return "bins", repr(self.spec), self.classes, self.max_bins, self.edges, self.weight, self.row_rate < 1

    def prepare(self, df: DataFrame) -> Binned:
        spec = self.spec
        classes = list(self.classes or label_classes(df, spec.label))
        labelled = df.filter(F.col(spec.label).isNotNull())
        binner = fit_binner(labelled, spec, self.max_bins, dict(self.edges))
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = binner.transform(labelled).select(
            *([F.col(spec.key).cast("string").alias("__key")] if self.row_rate < 1 else []),
            C.class_index(spec.label, classes).cast("int").alias("__y"),
            weight.alias("__w"),
            BINS,
        )
        return Binned(classes, binner, rows.persist(StorageLevel.MEMORY_AND_DISK))

    def release(self, prepared: Binned) -> None:
        prepared.rows.unpersist()

    def fit_prepared(self, prepared: Binned) -> BoostModel:
        names = [*self.spec.numeric, *self.spec.categorical]
        prior, trees = self._boost(prepared.rows.sparkSession, prepared.rows, prepared.classes, names, prepared.binner.sizes)
        return BoostModel(prepared.classes, self.params(), names, prior, self.depth, prepared.binner, trees)

    def _boost(self, spark: SparkSession, state: DataFrame, classes: list[str], names: list[str], sizes: list[int]) -> tuple[list[float], list[Tree]]:
        """All rounds on the binned table."""
        weights = state.select("__y", "__w", F.spark_partition_id().alias("task")).groupBy("__y")
        found = weights.agg(F.sum("__w").alias("n"), F.min(F.when(F.col("__w") > 0, F.col("__w"))).alias("least"), F.max("task").alias("last")).collect()
        counts = {r["__y"]: r["n"] for r in found}
        rows, tasks, least = sum(counts.values()), 1 + max((r["last"] for r in found), default=0), min((r["least"] for r in found if r["least"]), default=1.0)
        prior = [math.log(max(counts.get(k, 0.0), 1e-9) / rows) for k in range(len(classes))]
        trees: list[Tree] = []
        recent: list[Tree] = []  # grown since ``base`` was stored
        base, made = state, []  # the states with margins so far; the last but one is kept until the last one's rows are there
        try:
            for r in range(self.rounds):
                grown = self._grow(state, r, prior, names, sizes, rows, tasks, least)
                trees += grown
                recent += grown
                while len(made) > 1:
                    made.pop(0).unpersist()
                if r + 1 < self.rounds:
                    # Always from the stored rows, so that plans and recovery don't grow with the rounds.
                    state = base.withColumn("__f", margin_column(spark, prior, recent, self.depth, len(names), stored="__f" in base.columns))
                    if (r + 1) % self.checkpoint_interval == 0:
                        base = state = cut_lineage(state)
                        recent = []
                    # Cached for the passes of a round.
                    made.append(state.persist(StorageLevel.MEMORY_AND_DISK))
        finally:
            for old in made:
                old.unpersist()
        return prior, trees

    def _grow(self, state: DataFrame, r: int, prior, names: list[str], sizes: list[int], rows: float, tasks: int, least: float) -> list[Tree]:
        """One round: a tree per class, level by level."""
        spark, k, width, numbers = state.sparkSession, len(prior), len(names), len(self.spec.numeric)
        growing = [Tree.empty(r, c, self.depth) for c in range(k)]
        columns = [
            [names.index(c) for c in column_sample(names, self.column_rate, self.seed, r, t.klass)] for t in growing
        ]
        sampled = row_sample(state, "__key", self.row_rate, self.seed, r).drop("__key") if self.row_rate < 1 else state
        step = self.eta * self.annealing**r
        start = np.asarray(prior, float)
        cells: DataFrame | None = None  # the level's sums
        taken: list[np.ndarray] | None = None  # nodes summed from rows
        derived: list[tuple[int, int, int]] = []  # class, parent, the child whose sums are the parent's less its sibling's
        try:
            for level in range(self.depth):
                task = gradient_sums(start, [t.plain() for t in growing], level, columns, sizes, width, taken)
                sums = sampled.mapInArrow(task, SUMS_SCHEMA)
                if cells is not None:
                    # At most classes x 2^level rows; as an Arrow table they need no job of their own.
                    columns_of = [pa.array(c, pa.int32()) for c in zip(*derived)]
                    place = F.broadcast(spark.createDataFrame(pa.table(columns_of, ["class", "node", "child"])))
                    parents = cells.join(place, ["class", "node"]).select("class", F.col("child").alias("node"), "feature", "bin", *"ghn")
                    sums = sums.unionByName(parents)
                above, cells = cells, placed(combined(sums, tasks, least), numbers, self.mode == "newton", self.reg_lambda)
                # A level's plan holds those of the levels since the last stored one.
                store = level % STORED_LEVELS == STORED_LEVELS - 1 and level + 1 < self.depth
                cells = written(cells, "cells") if store else cells.persist(StorageLevel.MEMORY_AND_DISK)
                wide = max(sizes, default=0) > WIDE_BINS
                # At most classes x 2^level rows.
                found = best_splits(cells, numbers, self.mode, self.reg_lambda, self._min_rows, self.min_child_weight, rows, wide).collect()
                if above is not None:
                    above.unpersist()
                taken, derived = [np.zeros(2 ** (level + 1), bool) for _ in range(k)], []
                for b in found:
                    tree, i = growing[b["class"]], b["node"] + 2**level - 1
                    if level == 0:
                        tree.value[i], tree.rows[i] = step * self._leaf(b["tg"], b["th"], k), b["tn"]
                    if b["score"] <= 0:
                        continue
                    left = words_of_bitmaps(b["sets"]) if b["feature"] >= numbers else bin_set(range(0 if b["zero_left"] else 1, b["bin"] + 1))
                    tree.feature[i], tree.left[i], tree.gain[i] = b["feature"], left, b["gain"]
                    for child, g, h, n in (
                        (2 * i + 1, b["lg"], b["lh"], b["ln"]),
                        (2 * i + 2, b["tg"] - b["lg"], b["th"] - b["lh"], b["tn"] - b["ln"]),
                    ):
                        tree.value[child], tree.rows[child] = step * self._leaf(g, h, k), n
                    smaller = 2 * b["node"] + int(b["ln"] > b["tn"] - b["ln"])
                    taken[b["class"]][smaller] = True
                    derived.append((b["class"], b["node"], smaller ^ 1))
                if not derived:
                    break
        finally:
            if cells is not None:
                cells.unpersist()
        return growing
