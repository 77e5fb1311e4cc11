"""Scalar column expressions. All are native Spark SQL, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F, types as T

# Loyalty-point buckets start at 0, then at 1, 501, 1001, ... 20001, the last one open.
POINT_FIRST = 1.0
POINT_STEP = 500.0
POINT_LAST = 20001.0
POINT_TOP_BUCKET = int((POINT_LAST - POINT_FIRST) / POINT_STEP) + 1
POINT_SPLITS = [
    0.0,
    *(POINT_FIRST + POINT_STEP * i for i in range(POINT_TOP_BUCKET)),
    float("inf"),
]

UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

HASH_RANGE = 4294967296  # 2^32, the number of values of eight hexadecimal digits


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def difference(a: Column | str, b: Column | str) -> Column:
    """a - b; null when either side is null."""
    return as_column(a) - as_column(b)


def product(a: Column | str, b: Column | str) -> Column:
    """a * b as a double; null when either side is null."""
    return as_column(a).cast("double") * as_column(b).cast("double")


def positive_count(columns: Sequence[str]) -> Column:
    """How many of ``columns`` are above zero; a null counts as zero."""
    return reduce(add, (F.when(F.col(c) > 0, 1).otherwise(0) for c in columns))


def point_level(points: Column | str, mode: str = "keep") -> Column:
    """Bucket index of a point balance by closed form.

    NaN goes to the extra bucket after the last one and null stays null. A negative balance gives
    null in ``keep`` mode and stops the job in ``strict`` mode.
    """
    if mode not in ("keep", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    x = as_column(points).cast("double")
    below = (
        F.raise_error(F.concat(F.lit("point balance below zero: "), x.cast("string"))).cast("double")
        if mode == "strict"
        else F.lit(None).cast("double")
    )
    inner = F.least(F.floor((x - POINT_FIRST) / POINT_STEP) + 1, F.lit(POINT_TOP_BUCKET))
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(x), F.lit(float(POINT_TOP_BUCKET + 1)))
        .when(x < 0, below)
        .when(x < POINT_FIRST, F.lit(0.0))
        .otherwise(inner.cast("double"))
    )


def category_text(c: Column | str, data_type: T.DataType) -> Column:
    """A category as text: numbers by their whole part, everything else as it is."""
    c = as_column(c)
    if isinstance(data_type, T.NumericType):
        return c.cast("bigint").cast("string")
    return c.cast("string")


def lenient_number(c: Column | str) -> Column:
    """Text to double; text that is no number, and NaN, become null."""
    number = as_column(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def clean_number(c: Column | str, data_type: T.DataType | None = None) -> Column:
    """Number as a double with NaN read as missing; whole numbers need no NaN test."""
    number = as_column(c).cast("double")
    if isinstance(data_type, (T.IntegralType, T.DecimalType, T.BooleanType)):
        return number
    return F.when(~F.isnan(number), number)


def time_text(c: Column | str, data_type: T.DataType) -> Column:
    """``yyyy-MM-dd HH:mm:ss``; a timestamp without zone is printed without any zone shift."""
    c = as_column(c)
    if isinstance(data_type, T.TimestampNTZType):
        return F.substring(c.cast("string"), 1, 19)
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def hash_value(key: Column | str, purpose: str, seed: int) -> Column:
    """Whole number in [0, 2^32) that depends only on the key, the purpose and the seed.

    The rows' placement has no influence, unlike with ``rand`` or ``randomSplit``, so a lost
    executor or another partition count cannot move a row to another sample.
    """
    text = F.concat(as_column(key).cast("string"), F.lit(f"|{purpose}|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(key: Column | str, purpose: str, seed: int) -> Column:
    """The hash scaled to [0, 1)."""
    return hash_value(key, purpose, seed) / F.lit(float(HASH_RANGE))


def relative_weights(scores: str, n: int) -> Column:
    """exp(score - largest score) for each of ``n`` log scores in an array column."""
    return F.expr(f"array({', '.join(f'exp(`{scores}`[{i}] - array_max(`{scores}`))' for i in range(n))})")


def shares(weights: str, n: int) -> Column:
    """An array column of ``n`` weights scaled to add up to 1."""
    total = " + ".join(f"`{weights}`[{i}]" for i in range(n))
    return F.expr(f"array({', '.join(f'`{weights}`[{i}] / ({total})' for i in range(n))})")


def class_of_largest(scores: Column, classes: Sequence[str]) -> Column:
    """Class name at the largest array entry; the first one wins a tie."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))


def class_index(label: Column | str, classes: Sequence[str]) -> Column:
    """Position of a class name in ``classes`` as a double; null for an unknown class."""
    names = F.array(*[F.lit(c) for c in classes])
    position = F.array_position(names, as_column(label))
    return F.when(position > 0, (position - 1).cast("double"))
