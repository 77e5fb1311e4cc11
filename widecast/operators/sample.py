"""Splits, folds and class balancing by key hash: repeatable and independent of partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from widecast.functions import columns as C

HASH_RANGE = 1 << 32


def split(df: DataFrame, key: str, shares: Sequence[float], seed: int) -> list[DataFrame]:
    """Disjoint parts that together are the input; part sizes follow ``shares``, down to shares of 2^-32."""
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    step = C.hash_value(key, "split", seed)
    bounds, upto = [0], 0.0
    for share in shares:
        upto += share
        bounds.append(round(upto * HASH_RANGE))
    bounds[-1] = HASH_RANGE
    return [df.filter((step >= low) & (step < high)) for low, high in zip(bounds, bounds[1:])]


def holdout(df: DataFrame, key: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(training rows, held-out rows)."""
    kept, reserved = split(df, key, [1 - share, share], seed)
    return kept, reserved


def cut_labels(df: DataFrame, label: str, max_labels: int = 100, min_share: float = 0.0) -> DataFrame:
    """Keep the rows of the most frequent classes: at most ``max_labels``, each with at least
    ``min_share`` of the labelled rows. The kept names go into the filter itself: no join."""
    seen = Observation()
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.observe(seen, F.sum("n").alias("total"))
    ranked = counts.orderBy(F.desc("n"), F.asc(label)).limit(max_labels).collect()
    kept = [r[label] for r in ranked if r["n"] >= min_share * seen.get["total"]]
    return df.filter(F.col(label).isin(kept))


def assign_folds(df: DataFrame, key: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    return df.withColumn(out, (C.hash_value(key, "fold", seed) % k).cast("int"))


def row_sample(df: DataFrame, key: str, rate: float, seed: int, round_no: int = 0) -> DataFrame:
    """The rows that take part in one boosting round."""
    return df.filter(C.hash_uniform(key, f"round{round_no}", seed) < rate)


def column_sample(columns: Sequence[str], rate: float, seed: int, *tree: int) -> list[str]:
    """The columns one tree may use, at least one, in their own order."""
    if rate >= 1:
        return list(columns)
    tag = "|".join(map(str, (seed, *tree)))
    ranked = sorted(columns, key=lambda c: hashlib.md5(f"{c}|{tag}".encode()).hexdigest())
    chosen = set(ranked[: max(1, round(rate * len(columns)))])
    return [c for c in columns if c in chosen]


def class_factors(classes: Sequence[str], factors: Sequence[float]) -> dict[str, float]:
    """Sampling factors listed by class position, as a mapping."""
    if len(classes) != len(factors):
        raise ValueError(f"{len(factors)} factors for {len(classes)} classes")
    return dict(zip(classes, factors))


def capped_factors(df: DataFrame, label: str, factors: Mapping[str, float], max_size: float) -> dict[str, float]:
    """Scale all factors down together where balancing would pass ``max_size`` times the rows."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    planned = sum(n * factors.get(c, 1.0) for c, n in counts.items())
    scale = min(1.0, max_size * rows / planned) if planned else 1.0
    return {c: factors.get(c, 1.0) * scale for c in counts if c is not None}


def _factor_column(label: str, factors: Mapping[str, float]) -> Column:
    factor = F.lit(1.0)
    for c, f in factors.items():
        factor = F.when(F.col(label) == c, F.lit(float(f))).otherwise(factor)
    return factor


def balance(df: DataFrame, label: str, factors: Mapping[str, float], key: str, seed: int, copy_column: str | None = None) -> DataFrame:
    """Resample classes by factor. A factor of 2.3 gives every row twice and 30 % of rows a third
    time; a factor of 0.2 keeps 20 % of rows. Copies are made where the row is: no shuffle."""
    factor = _factor_column(label, factors)
    whole = F.floor(factor)
    extra = (C.hash_uniform(key, "balance", seed) < factor - whole).cast("bigint")
    copies = F.sequence(F.lit(1), (whole + extra).cast("int"))
    number = copy_column or "__copy"
    out = df.filter(whole + extra > 0).withColumn(number, F.explode(copies))
    return out if copy_column else out.drop(number)


def balance_weights(df: DataFrame, label: str, factors: Mapping[str, float], out: str = "weight") -> DataFrame:
    """Class balancing without resampling: the factor becomes the row weight."""
    return df.withColumn(out, _factor_column(label, factors))


def restore_prior(probabilities: Column, prior: Sequence[float], trained_prior: Sequence[float]) -> Column:
    """Undo the shift of the class shares that balancing brought into the probabilities."""
    ratio = F.array(*[F.lit(float(p / t)) for p, t in zip(prior, trained_prior)])
    scaled = F.zip_with(probabilities, ratio, lambda p, r: p * r)
    total = F.aggregate(scaled, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(scaled, lambda p: p / total)
