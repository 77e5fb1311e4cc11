"""Quality of texts by pairwise ranking: a Bradley-Terry model of document scores.

The chance that one document is preferred to another is the logistic function of the difference of
their scores, which are linear in features of the text. The weights are learned from all pairs of a good
and a poor document; a quantile of the learned scores separates the two.
"""

from __future__ import annotations

import operator
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from widecast.llm.common import fresh, pieces, small_batches, texts_of, with_columns_of
from widecast.session import written

RIDGE = 1e-3
KNOT_SCALE = 8
KNOTS = 256
MOST_CELLS = 4096  # on both sides of 0: scores up to 35 million
CUT_SCORE = 0.3
# Signs by what they say about prose.
SENTENCE_SIGNS = b".,;:?'\"-()"
FEATURES = (
    "signs", "digits", "capitals", "exclamations", "bars", "repeated words", "different words", "different triples", "word length",
    "sentence signs", "long words", "length",
)


def features(text: str) -> list[float]:
    """Shares that tell prose from noise. Counts are damped so that a few words say little."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    of = np.bincount(raw, minlength=256)
    words = text.split()
    n = len(words)
    size = len(raw) + 20
    capitals, small = int(of[65:91].sum()), int(of[97:123].sum()) + int(of[128:].sum())
    digits = int(of[48:58].sum())
    said = sum(int(of[c]) for c in SENTENCE_SIGNS)
    other = int(of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum()) - said
    repeated = sum(map(operator.eq, words, words[1:]))
    different = len(set(words))
    triples = len(set(zip(words, words[1:], words[2:])))
    return [
        (other / size) ** 0.5,
        (digits / size) ** 0.5,
        (max(0, capitals - n) / (capitals + small + 20)) ** 0.5,
        (int(of[33]) / (n + 10)) ** 0.5,
        (int(of[124]) / (n + 10)) ** 0.5,
        (repeated / (n + 20)) ** 0.5,
        ((n - different) / (n + 20)) ** 0.5,
        (max(0, n - 2 - triples) / (n + 20)) ** 0.5,
        min((len(raw) - n) / (n + 1), 40) / 10,
        (said / (n + 10)) ** 0.5,
        (max(0, len(raw) - 15 * n) / size) ** 0.5,
        float(np.log1p(n)) / 10,
    ]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Ranking:
    """Weights of the standardised features, the cut, and the steepness of the score around it."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    cut: float
    steep: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1, rising with the raw score; ``CUT_SCORE`` exactly at the cut."""
        return logistic(self.steep * (self.raw(rows) - self.cut) + np.log(CUT_SCORE / (1 - CUT_SCORE)))


def cells_of(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The knot at or below each score and the share that belongs to the knot after it."""
    cell = np.clip(np.floor(np.arcsinh(scores / KNOT_SCALE) * KNOTS), -MOST_CELLS, MOST_CELLS - 1).astype(np.int64)
    low, high = knots(cell), knots(cell + 1)
    return cell, np.clip((scores - low) / (high - low), 0, 1)


def knots(cell: np.ndarray) -> np.ndarray:
    """Scores between which the pairs' loss is interpolated: 1/32 apart around 0, further apart beyond ``KNOT_SCALE``."""
    return KNOT_SCALE * np.sinh(cell / KNOTS)


def moments_by_knot(mean: list[float], scale: list[float], weights: np.ndarray):
    """For ``mapInArrow``: rows, sums and sums of products of the standardised features by class and knot of the score."""
    d = len(weights)
    upper = np.triu_indices(d)
    names = ["label", "cell", *[f"m{i}" for i in range(1 + d + len(upper[0]))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2 * MOST_CELLS + 1, len(names) - 2))
        for batch in batches:
            z = (matrix_of(batch) - np.array(mean)) / np.array(scale)
            y = batch.column("label").to_numpy()
            cell, share = cells_of(z @ weights)
            rows = np.concatenate([np.ones((len(z), 1)), z, z[:, upper[0]] * z[:, upper[1]]], axis=1)
            for at, part in ((cell, 1 - share), (cell + 1, share)):
                place = y * total.shape[1] + at + MOST_CELLS
                order = np.argsort(place, kind="stable")
                found, first = np.unique(place[order], return_index=True)
                if len(found):
                    total.reshape(-1, total.shape[2])[found] += np.add.reduceat((rows * part[:, None])[order], first)
        y, at = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array((at - MOST_CELLS).astype(np.int32)), *map(pa.array, total[y, at].T.copy())], names=names)

    return run, "label int, cell int, " + ", ".join(f"{n} double" for n in names[2:])


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))


def bradley_terry(rows: DataFrame, mean: list[float], scale: list[float], rounds: int = 40) -> np.ndarray:
    """Weights under which good rows beat poor ones: Newton steps on the mean logistic loss over every pair of the two.

    The loss of a pair depends on the difference of two scores, so rows of one score count together: one
    pass sums their features by class and knot, in proportion between the two nearest knots, and the pairs
    of knots stand for all pairs of rows. The sums, not the rows, come to the driver.
    """
    d = len(mean)
    upper = np.triu_indices(d)
    weights = np.zeros(d)
    for _ in range(rounds):
        run, schema = moments_by_knot(mean, scale, weights)
        sums = rows.mapInArrow(run, schema).groupBy("label", "cell")
        found = sums.agg(*[F.sum(f"m{i}") for i in range(1 + d + len(upper[0]))]).toArrow()  # at most 4 * MOST_CELLS rows
        table = np.array([c.to_numpy() for c in found.columns]).T
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        poor, good = table[table[:, 0] == 0, 1:], table[table[:, 0] == 1, 1:]
        n, m = good[:, 1], poor[:, 1]
        pairs = n.sum() * m.sum()
        p = logistic(knots(good[:, 0])[:, None] - knots(poor[:, 0])[None, :])
        q = p * (1 - p)
        slope = ((p - 1) @ m) @ good[:, 2 : 2 + d] - (n @ (p - 1)) @ poor[:, 2 : 2 + d]
        own = np.zeros((d, d))
        own[upper] = (q @ m) @ good[:, 2 + d :] + (n @ q) @ poor[:, 2 + d :]
        own = own + np.triu(own, 1).T
        cross = good[:, 2 : 2 + d].T @ q @ poor[:, 2 : 2 + d]
        step = np.linalg.solve((own - cross - cross.T) / pairs + RIDGE * np.eye(d), slope / pairs + RIDGE * weights)
        weights = weights - step
        if np.abs(step).max() < 1e-7:
            break
    # The order in which Spark adds sums moves the last digits.
    return np.round(weights, 7)


def best_cut(scored: DataFrame) -> tuple[float, float]:
    """Where rejecting the scores below makes the fewest errors among all rows (``label, score``), and their mean distance from it."""
    counts = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("poor"))
    # The ranges must stay as they are once their sums are taken.
    dealt = written(counts.repartitionByRange("score").withColumn("range", F.spark_partition_id()), "quality-scores")
    before = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    errors = F.coalesce(F.sum(F.col("good") - F.col("poor")).over(before), F.lit(0))
    steps = dealt.select("range", "score", "good", "poor", errors.alias("errors")).groupBy("range")
    # A row for each range of the sort.
    ranges = steps.agg(F.min(F.struct("errors", "score")).alias("best"), F.sum("good").alias("good"), F.sum("poor").alias("poor"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
    ranges.sort(key=lambda r: r["low"])
    least, at, so_far = None, None, sum(r["poor"] for r in ranges)
    for r in ranges:
        if least is None or so_far + r["best"]["errors"] < least:
            least, at = so_far + r["best"]["errors"], r["best"]["score"]
        so_far += r["good"] - r["poor"]
    if so_far < least:
        cut = ranges[-1]["high"] + 1
    elif at == ranges[0]["low"]:
        cut = at - 1
    else:
        # Between the two neighbours, nearer to the poor one: good texts are to be kept.
        cut = 0.7 * dealt.filter(F.col("score") < at).agg(F.max("score")).first()[0] + 0.3 * at
    distance = dealt.agg(F.sum(F.abs(F.col("score") - cut) * (F.col("good") + F.col("poor"))) / F.sum(F.col("good") + F.col("poor"))).first()[0]
    return float(cut), float(distance)


def labelled_features(docs: DataFrame, labels: DataFrame, learn: Column, label: str) -> DataFrame:
    """``label, features`` of every document with a label 0 or 1 among the labels with ``learn``, stored.

    Null ids are no examples. Features, not texts, are joined, so that no text is shuffled.
    """
    docs = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [features(t) for t in texts_of(batch)]
            yield with_columns_of(batch, "text", ["features"], [pa.array(found, pa.list_(pa.float64()))])

    found = docs.mapInArrow(run, docs.drop("text").withColumn("features", F.lit(None).cast("array<double>")).schema)
    known = labels.filter(learn & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    return written(found.join(known.filter("label IN (0, 1)"), "doc_id").select("label", "features"), "quality-features")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> Ranking | None:
    """Learn from every labelled row of both classes; sums by score come to the driver, rows never.

    None, if a class has no example.
    """
    small_batches(docs.sparkSession)
    rows = labelled_features(docs, labels, learn, label)
    spread = [f(F.col("features")[i]) for f in (F.avg, F.stddev_pop) for i in range(len(FEATURES))]
    found = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), *spread).first()
    if not found[0] or not found[1]:
        return None
    mean = [round(v, 9) for v in found[2 : 2 + len(FEATURES)]]
    scale = [max(round(v, 9), 1e-6) for v in found[2 + len(FEATURES) :]]
    weights = bradley_terry(rows, mean, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.round(((matrix_of(batch) - np.array(mean)) / np.array(scale)) @ weights, 9)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(raw)], names=["label", "score"])

    cut, distance = best_cut(rows.mapInArrow(run, "label int, score double"))
    return Ranking(mean, scale, weights.tolist(), cut, 4 / (distance or 1.0))


def score(docs: DataFrame, model: Ranking | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text (0 to 1, above the cut from ``CUT_SCORE`` up) as ``name``.

    Null texts count as empty and get the score of an empty text; without a model every score is 0.5.
    A column of that name gives way. One pass without a shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    own = fresh(docs, "text_to_score")
    known = vars(model) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, own):
            found = Ranking(**known).score(np.array([features(t) for t in texts_of(batch, own)])) if known else np.full(len(batch), 0.5)
            yield with_columns_of(batch, own, [name], [pa.array(found)])

    return docs.withColumn(own, F.col(text).cast("string")).mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
