"""Pieces shared by the registered queries."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from widecast.session import ensure_checkpoint_dir

DIGITS = 6
FOLD_SEED = 67829
SPLIT_SEED = 42


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint location, for queries that write and read back."""
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


def rounded(c: Column | str, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    out = F.round(column, DIGITS)
    return out.alias(name or c) if name or isinstance(c, str) else out


def round_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def as_doubles(probabilities: str, n: int) -> list[Column]:
    return [rounded(F.col(probabilities)[i], f"p{i}") for i in range(n)]


def hash_sql(key: str, purpose: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5({key} || '|{purpose}|{seed}'), 1, 8) AS BIGINT)"


def uniform_sql(key: str, purpose: str, seed: int) -> str:
    return f"({hash_sql(key, purpose, seed)} / 4294967296.0::DOUBLE)"


def fold_sql(k: int, seed: int = FOLD_SEED, key: str = '"user"') -> str:
    return f"{hash_sql(key, 'fold', seed)} % {k}"
