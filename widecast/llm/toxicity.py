"""Toxicity by weak supervision: many voters, a label model of their votes, a linear classifier.

Voters look for words of a small general lexicon, for words and word beginnings that a sample of
labelled texts marks as toxic (grouped by the strength of the evidence), and for patterns; some vote
for clean. A generative model learns how accurate each voter is and which voters say the same thing.
Its posterior labels train a logistic regression on the voters' counts.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from widecast.llm.common import ChunkTable, fresh, labelled_sample, pieces, small_batches, texts_of, with_columns_of
from widecast.llm.quality import logistic

SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 3000
MOST_TERMS = 20_000
CUT_SCORE = 0.7
BEGINNINGS = range(4, 9)
WORD_PATTERN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Least log-odds of a term for the tiers of learned voters, strongest first.
TIERS = (5.0, 4.2, 3.4)
# Insults and threats of common English.
LEXICON = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile scum scumbag trash garbage worthless pathetic disgusting loser "
    "losers clown clowns jerk jerks creep bastard bitch asshole crap damn shit fuck fucking fucker whore slut retard retarded freak vermin "
    "parasite filth filthy cretin dimwit halfwit nitwit".split()
)
STRONG = LEXICON - frozenset("trash garbage clown clowns damn creep dumb freak".split())
ADDRESS = frozenset("you your you're youre ur u yourself".split())
# What a word can be counted as.
IN_LEXICON, IN_STRONG, SHOUTED, ADDRESSED, PLAIN = range(5)
FIRST_TIER = 5
KINDS = FIRST_TIER + 2 * len(TIERS)


def words_in(chunk: str) -> list[str]:
    return WORD_PATTERN.findall(chunk)


def beginnings(word: str) -> list[str]:
    """Prefixes that stand for a word's stem, marked apart from whole words."""
    return [word[:n] + "*" for n in BEGINNINGS if n < len(word)]


@dataclass
class ToxicityModel:
    terms: dict[str, int]  # words and beginnings* to the tier of their evidence
    mean: list[float]
    scale: list[float]
    weights: list[float]  # of the classifier, the last is the intercept
    accuracies: list[tuple[float, float]]  # of the voters: P(vote | toxic), P(vote | clean)

    def kinds_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        lengths = np.zeros(len(chunks), np.int64)
        for i, chunk in enumerate(chunks):
            before = len(flat)
            for word in words_in(chunk):
                low = word.lower()
                flat.append(PLAIN)
                if low in LEXICON:
                    flat.append(IN_LEXICON)
                    if low in STRONG:
                        flat.append(IN_STRONG)
                    if word.isupper():
                        flat.append(SHOUTED)
                if low in ADDRESS:
                    flat.append(ADDRESSED)
                tier = self.terms.get(low)
                if tier is not None:
                    flat.append(FIRST_TIER + tier)
                stems = [t for b in beginnings(low) if (t := self.terms.get(b)) is not None]
                if stems:
                    flat.append(FIRST_TIER + len(TIERS) + min(stems))
            lengths[i] = len(flat) - before
        return np.array(flat, np.uint8), lengths

    def counts(self, texts: list[str], table: ChunkTable) -> np.ndarray:
        """How often each kind of word occurs in each text."""
        flat, ends = table.encode(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        return np.bincount(owner * KINDS + flat, minlength=len(texts) * KINDS).reshape(-1, KINDS)

    def score(self, counts: np.ndarray) -> np.ndarray:
        x = (inputs(counts) - np.array(self.mean)) / np.array(self.scale)
        return logistic(x @ np.array(self.weights[:-1]) + self.weights[-1])


def votes(counts: np.ndarray) -> np.ndarray:
    """Votes of all voters on rows of counts: 1 toxic, 0 clean, -1 none."""
    c, n = counts, counts[:, PLAIN]
    words, stems = c[:, FIRST_TIER : FIRST_TIER + len(TIERS)], c[:, FIRST_TIER + len(TIERS) :]
    for_toxic = [c[:, IN_LEXICON] > 0, c[:, IN_STRONG] > 0, c[:, IN_LEXICON] > 1, c[:, SHOUTED] > 0, (c[:, ADDRESSED] > 0) & (c[:, IN_LEXICON] > 0)]
    for t in range(len(TIERS)):
        for least in (1, 2, 3):
            for_toxic += [words[:, : t + 1].sum(axis=1) >= least, stems[:, : t + 1].sum(axis=1) >= least]
    dense = (c[:, IN_LEXICON] + words.sum(axis=1)) / (n + 10)
    for_toxic += [dense > 0.005, dense > 0.02]
    for_clean = [words.sum(axis=1) == 0, (stems[:, :2].sum(axis=1) == 0), (words[:, 0] + stems[:, 0] + c[:, IN_LEXICON] == 0), dense < 0.002]
    return np.stack([np.where(v, 1, -1) for v in for_toxic] + [np.where(v, 0, -1) for v in for_clean], axis=1).astype(np.int8)


def inputs(counts: np.ndarray) -> np.ndarray:
    """What the classifier sees: damped counts, their shares of the words, and whether there are any."""
    kinds = np.delete(counts, PLAIN, axis=1).astype(float)
    n = counts[:, PLAIN : PLAIN + 1]
    strong = kinds[:, [IN_STRONG, FIRST_TIER - 1, FIRST_TIER - 1 + len(TIERS)]].sum(axis=1, keepdims=True)
    return np.concatenate([np.log1p(kinds), np.sqrt(kinds / (n + 10)), kinds > 0, strong > 1, strong > 2], axis=1)


def label_model(said: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Posterior of "toxic" for each row of votes, and each voter's accuracy, by expectation maximisation.

    A voter's chance to vote depends on the hidden label. Voters that vote alike beyond what the label
    explains share one say: each voter's evidence is divided by the sum of its positive correlations,
    inside the labels, with all voters.
    """
    active = (said >= 0).astype(float)
    toward = np.where(said == 1, 1, 0)
    # To start: more votes for toxic than for clean.
    tox, clean = (said == 1).mean(axis=1), (said == 0).mean(axis=1)
    rank = tox - clean
    posterior = np.where(rank > np.quantile(rank, max(0.0, 1 - prior)), 0.9, 0.1) if len(rank) else rank
    share = np.ones(active.shape[1])
    rates = np.zeros((active.shape[1], 2))
    for _ in range(rounds):
        p = np.stack([posterior, 1 - posterior])
        mass = p.sum(axis=1) + 1e-9
        rates = ((p @ active + 0.5) / (mass[:, None] + 1)).T
        # Voters keep their side: a vote for toxic is never counted as evidence against it.
        for j in range(len(rates)):
            side = toward[:, j].any()
            if (rates[j, 0] < rates[j, 1]) == side:
                rates[j] = rates[j].mean()
        centred = active - (posterior[:, None] * rates[:, 0] + (1 - posterior)[:, None] * rates[:, 1])
        spread = np.sqrt((centred**2).mean(axis=0)) + 1e-9
        alike = np.clip((centred.T @ centred) / len(centred) / np.outer(spread, spread), 0, 1)
        share = 1 / np.maximum(1, alike.sum(axis=1))
        rates = np.clip(rates, 1e-3, 1 - 1e-3)
        evidence = active * np.log(rates[:, 0] / rates[:, 1]) + (1 - active) * np.log((1 - rates[:, 0]) / (1 - rates[:, 1]))
        new = logistic(evidence @ share + np.log(prior / (1 - prior)))
        if np.abs(new - posterior).max() < 1e-6:
            posterior = new
            break
        posterior = new
    return posterior, [(float(a), float(b)) for a, b in rates]


def weighted_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft targets by damped Newton steps; the last weight is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = logistic(x @ w)
        slope = x.T @ (weight * (p - target)) + keep * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def learned_terms(texts: list[str], toxic: np.ndarray, most: int = MOST_TERMS) -> dict[str, int]:
    """Words and beginnings that toxic texts have far more often than clean ones, with their tier."""
    in_toxic, in_clean = Counter(), Counter()

    def seen(text: str) -> set[str]:
        words = {w.lower() for w in words_in(text)}
        return words | {b for w in words for b in beginnings(w)}

    for text, is_toxic in zip(texts, toxic):
        if is_toxic:
            in_toxic.update(seen(text))
    least = max(3, int(0.015 * toxic.sum()))
    candidates = {t for t, n in in_toxic.items() if n >= least}
    for text, is_toxic in zip(texts, toxic):
        if not is_toxic:
            in_clean.update(seen(text) & candidates)
    a, b = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    found = []
    for term in candidates:
        odds = np.log((in_toxic[term] + 0.1) / a) - np.log((in_clean[term] + 0.5) / b)
        # The margin falls with the evidence, so rare terms must be clearer.
        odds -= 2 / np.sqrt(in_toxic[term])
        if odds >= TIERS[-1]:
            found.append((-odds, term))
    return {term: next(i for i, t in enumerate(TIERS) if -odds >= t) for odds, term in sorted(found)[:most]}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> ToxicityModel | None:
    """Learn from about ``sample_toxic`` and ``sample_clean`` labelled texts, which come to the driver.

    The labels choose the learned terms, give the share of toxic texts, and set the classifier's
    intercept so that the cut makes the fewest errors on them; the votes and posteriors do the rest.
    None, if a class has no example.
    """
    sample, sizes = labelled_sample(docs, labels, label, learn, {1: sample_toxic, 0: sample_clean})
    rows = sorted({(r["text"] or "", r["label"]) for r in sample.collect()})
    texts, toxic = [t for t, _ in rows], np.array([y == 1 for _, y in rows], bool)
    if not toxic.any() or toxic.all():
        return None
    # Terms come from one half and are judged on the other, in turn, so that votes aren't flattered.
    half = np.arange(len(texts)) % 2 == 0
    counts = np.zeros((len(texts), KINDS), np.int64)
    for own in (half, ~half):
        if toxic[own].any() and not toxic[own].all():
            part = ToxicityModel(learned_terms([t for t, x in zip(texts, own) if x], toxic[own]), [], [], [], [])
            counts[~own] = part.counts([t for t, x in zip(texts, own) if not x], ChunkTable(part.kinds_of, np.uint8))
    prior = toxic.mean()
    posterior, accuracies = label_model(votes(counts), float(prior))
    x = inputs(counts)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    weights = weighted_logistic((x - mean) / scale, posterior, np.ones(len(x)))
    raw = ((x - mean) / scale) @ weights[:-1] + weights[-1]
    cut = fewest_errors(raw, toxic, np.where(toxic, sizes[1] / toxic.sum(), sizes[0] / (~toxic).sum()))
    weights[-1] += np.log(CUT_SCORE / (1 - CUT_SCORE)) - cut
    return ToxicityModel(learned_terms(texts, toxic), mean.tolist(), scale.tolist(), weights.tolist(), accuracies)


def fewest_errors(raw: np.ndarray, toxic: np.ndarray, weight: np.ndarray, slack: float = 0.003) -> float:
    """The raw score from which calling a text toxic makes about the smallest weight of errors.

    Of the cuts within ``slack`` of the smallest, the one nearest to even odds of the posterior.
    """
    order = np.argsort(raw, kind="stable")
    raw, toxic, weight = raw[order], toxic[order], weight[order]
    errors = np.concatenate([[0], np.cumsum(np.where(toxic, weight, 0))]) + np.concatenate([np.cumsum(np.where(toxic, 0, weight)[::-1])[::-1], [0]])
    cuts = np.concatenate([[raw[0] - 1], (raw[1:] + raw[:-1]) / 2, [raw[-1] + 1]])
    allowed = np.concatenate([[True], raw[1:] > raw[:-1], [True]]) & (errors <= errors.min() + slack * weight.sum())
    # Even odds themselves, if no score lies between them and an allowed cut.
    low = np.concatenate([[-np.inf], raw])
    high = np.concatenate([raw, [np.inf]])
    if (allowed & (low < 0) & (high > 0)).any():
        return 0.0
    return float(cuts[allowed][np.argmin(np.abs(cuts[allowed]))])


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the toxicity of every whole text (0 to 1, toxic from ``CUT_SCORE`` up) as ``name``.

    Null texts count as empty and get the score of an empty text; without a model every score is 0. A
    column of that name gives way. One pass without a shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    own = fresh(docs, "text_to_score")
    shared = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ToxicityModel(**shared.value) if shared.value else None
        table = ChunkTable(known.kinds_of, np.uint8) if known else None
        for batch in pieces(batches, own):
            found = known.score(known.counts(texts_of(batch, own), table)) if known else np.zeros(len(batch))
            yield with_columns_of(batch, own, [name], [pa.array(found)])

    return docs.withColumn(own, F.col(text).cast("string")).mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
