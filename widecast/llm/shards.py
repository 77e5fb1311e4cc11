"""Shards of equal row counts whose mixture of sources is that of the whole table.

Rows are shuffled by a seeded hash and ranked inside their source; the fractional rank spreads every
source evenly over 0 to 1. In the order of that fraction each stretch of rows has the mixture of the
whole, so cutting the order into equal stretches gives the shards. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from widecast.llm.common import stored

ROWS_PER_BUCKET = 2_000
MOST_BUCKETS = 4096
HASH_DIGITS = 14


def bucket_count(rows: int) -> int:
    return min(MOST_BUCKETS, max(1, -(-rows // ROWS_PER_BUCKET)))


def order_hash(seed: int, *columns: str) -> Column:
    """A number below 2^56 from the MD5 of seed and columns; nulls count as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("bigint")


def ranked(df: DataFrame, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with the 1-based rank of each row in its group, where ``bucket`` rises with ``order``.

    Only the rows of one bucket are sorted together: the rows before it come from counts by bucket.
    """
    sizes = df.groupBy(*group, bucket).agg(F.count("*").alias("rows_here"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("rows_before", F.coalesce(F.sum("rows_here").over(before), F.lit(0))).drop("rows_here")
    inside = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    return df.withColumn(name, inside).join(sizes, [*group, bucket]).withColumn(name, F.col(name) + F.col("rows_before")).drop("rows_before")


def interleave(df: DataFrame, shards: int, seed: int, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, source, shard, slot``: every row's place in ``shards`` shards.

    Shard sizes in rows are at most one apart, and a shard's rows of a source differ from the source's
    share by less than two rows; slots are gapless from 0. A null source is a source of its own; null
    texts have size 1 and checksum 0; repeated rows have places of their own. Rows are hashed by id and
    checksum, and ties go by id, checksum and size. Two shuffles of narrow rows, each in buckets of a
    bounded part of a source and then of the whole, so a large source is no single task's.
    """
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(own) + 1).cast("bigint").alias("size"),
        F.crc32(own.cast("binary")).alias("text_crc32"),
        F.col(source).cast("string").alias("source"),
    )
    rows = stored(rows.withColumn("draw", order_hash(seed, "doc_id", "text_crc32")), "shard-rows")
    total = rows.count()
    buckets = bucket_count(total)
    tie = [F.col("draw"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    # A null source would not join with its counts.
    keyed = rows.withColumns({"has_source": F.col("source").isNotNull(), "source": F.coalesce("source", F.lit(""))})
    keyed = keyed.withColumn("bucket", F.floor(F.col("draw") / F.lit(float(16**HASH_DIGITS)) * buckets).cast("int"))
    placed = ranked(keyed, ["source", "has_source"], "bucket", tie, "place")
    in_source = keyed.groupBy("source", "has_source").agg(F.count("*").alias("n_source"))
    placed = placed.join(in_source, ["source", "has_source"])
    placed = placed.withColumn("fraction", (2.0 * F.col("place") - 1) / (2.0 * F.col("n_source"))).drop("bucket", "place", "n_source")
    cells = placed.withColumns({"cell": F.floor(F.col("fraction") * buckets).cast("int"), "whole": F.lit(0)})
    position = ranked(cells, ["whole"], "cell", [F.col("fraction"), *tie], "position").withColumn("position", F.col("position") - 1)
    shard = F.expr(f"CAST((position * {shards}) DIV {max(1, total)} AS INT)")
    first = F.expr(f"(shard * CAST({max(1, total)} AS BIGINT) + {shards - 1}) DIV {shards}")
    out = position.withColumn("shard", shard).withColumn("slot", F.col("position") - first)
    return out.select("doc_id", "size", "text_crc32", F.when(F.col("has_source"), F.col("source")).alias("source"), "shard", "slot")
