"""Exact top-k by inner product: global score histograms find each query's kth value.

Every pass scores all candidates. The first passes only count: a histogram of each query's scores
shows in which bin the kth highest lies, and the next pass splits that bin. When bins hold one value,
a last pass keeps the candidates from the kth value up and breaks ties by id.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

SCALE = 64
BINS = 1024
GROUP_BYTES = 32 << 20
ROWS_AT_ONCE = 4096
SCORES_AT_ONCE = 2_000_000
EXACT = 2.0**53
LIMIT = 2**63 - 1


@dataclass
class Queries:
    """Queries of one length: per query the range under search and how many scores lie above it."""

    ids: np.ndarray
    matrix: np.ndarray
    low: np.ndarray
    high: np.ndarray  # the last score of the range
    width: np.ndarray  # of a bin
    above: np.ndarray
    done: bool = False  # bins have held one value each


def whole_numbers(flat: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * flat)


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id, vector`` of the rows with an id and a vector of finite numbers only."""
    ready = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return ready.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of whole numbers) of some thousand rows whose vectors have one length."""
    held: dict[int, list] = {}
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        lists = batch.column("vector")
        flat = whole_numbers(lists.flatten().to_numpy(zero_copy_only=False))
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            matrix = flat.reshape(-1, size) if len(rows) == len(sizes) and size else flat[starts[rows][:, None] + np.arange(size)]
            kept = held.setdefault(size, [])
            kept.append((ids[rows], matrix))
            if sum(len(x) for x, _ in kept) >= ROWS_AT_ONCE:
                yield np.concatenate([x for x, _ in kept]), np.concatenate([m for _, m in kept])
                kept.clear()
    for kept in held.values():
        if kept:
            yield np.concatenate([x for x, _ in kept]), np.concatenate([m for _, m in kept])


def scored(queries: Queries, ids: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(queries, scores, which scores count) in bounded parts; a query's own row doesn't count."""
    step = max(1, SCORES_AT_ONCE // max(1, len(ids)))
    reach = np.sqrt((matrix**2).sum(axis=1).max(initial=0.0)) * np.sqrt((queries.matrix**2).sum(axis=1).max(initial=0.0))
    for start in range(0, len(queries.ids), step):
        part = slice(start, start + step)
        if reach < EXACT:  # sums of whole numbers below 2^53 are exact in floating point
            scores = (queries.matrix[part] @ matrix.T).astype(np.int64)
        else:
            exact = [[sum(int(a) * int(b) for a, b in zip(q, c)) for c in matrix.tolist()] for q in queries.matrix[part].tolist()]
            scores = np.array([[max(-LIMIT, min(LIMIT, x)) for x in row] for row in exact], np.int64).reshape(-1, len(ids))
        yield part, scores, queries.ids[part][:, None] != ids[None, :]


def counts(shared, k: int):
    """For ``mapInArrow``: (query, bin, number of scores), from the top bin down to the k-th score of
    the block. Lower bins can't hold a query's kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in blocks(batches):
            if matrix.shape[1] not in shared.value:
                continue
            queries = Queries(**shared.value[matrix.shape[1]])
            for part, scores, counting in scored(queries, ids, matrix):
                low, width = queries.low[part][:, None], queries.width[part][:, None]
                # Divided before the subtraction could leave the range of long.
                bins = scores // width - low // width
                counting &= (scores >= low) & (scores <= queries.high[part][:, None])
                bins = np.where(counting, bins, -1)
                if bins.shape[1] > k:
                    local = np.partition(bins, bins.shape[1] - k, axis=1)[:, bins.shape[1] - k]
                    counting &= bins >= local[:, None]
                row, column = np.nonzero(counting)
                found, number = np.unique(row * (2 * BINS) + bins[row, column], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(queries.ids[part][found // (2 * BINS)]), pa.array(found % (2 * BINS)), pa.array(number)], names=["query_id", "bin", "n"])

    return run


def best(shared, k: int):
    """For ``mapInArrow``: the block's k best of each query among those from ``low`` up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in blocks(batches):
            if matrix.shape[1] not in shared.value:
                continue
            queries = Queries(**shared.value[matrix.shape[1]])
            for part, scores, counting in scored(queries, ids, matrix):
                row, column = np.nonzero(counting & (scores >= queries.low[part][:, None]))
                score, own = scores[row, column], ids[column]
                order = np.lexsort((own, -score, row))
                row, score, own = row[order], score[order], own[order]
                first = np.searchsorted(row, row, side="left")
                keep = np.arange(len(row)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(queries.ids[part][row[keep]]), pa.array(own[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    return run


def refined(queries: Queries, rows: dict[int, list[tuple[int, int]]], k: int) -> Queries:
    """The bin of the kth score as the new range; ``rows`` has bins and numbers by query."""
    low, high, width, above = queries.low.copy(), queries.high.copy(), queries.width, queries.above.copy()
    for i, query in enumerate(queries.ids.tolist()):
        size, counted = int(width[i]), int(above[i])
        base = int(low[i]) // size
        found = sorted(rows.get(query, ()), reverse=True)
        for b, n in found:
            if counted + n >= k or (b, n) == found[-1]:
                # With fewer than k scores, the lowest bin that has any is taken.
                low[i], high[i], above[i] = max(-LIMIT, (base + b) * size), min(LIMIT, (base + b + 1) * size - 1), counted
                break
            counted += n
    return replace(queries, low=low, high=high, width=np.maximum(1, -(-width // BINS)), above=above, done=bool((width == 1).all()))


def search(df: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector: str = "embedding", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest scores, ties to the smaller id.

    A score is the inner product of floor(64 x) of the components, exact; it stops at the range of
    long. Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part; vectors of different lengths have no score together. Rows with a query's own id are not its
    candidates; repeated query rows are one query (of the smallest vector), repeated candidates each
    count. Queries are taken in groups of ``group_bytes``, which are sent to all tasks; vectors are
    never shuffled.
    """
    spark = df.sparkSession
    candidates = usable(df, id_column, vector)
    asked = usable(df.filter(is_query), id_column, vector).groupBy("id").agg(F.min("vector").alias("vector"))
    size = asked.agg(F.sum(8 * F.size("vector") + 64).alias("bytes")).first()["bytes"] or 0
    number = max(1, -(-int(size) // group_bytes))
    out = None
    for g in range(number):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(number)) == g) if number > 1 else asked
        found = one_group(spark, candidates, mine, k)
        out = found if out is None else out.unionAll(found)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def one_group(spark, candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    by_size: dict[int, Queries] = {}
    norm = candidates.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (F.abs(SCALE * x) + 1) * (F.abs(SCALE * x) + 1))).alias("n")).first()["n"] or 0.0
    for ids, matrix in whole_group(asked):
        reach = np.sqrt((matrix**2).sum(axis=1)) * np.sqrt(norm) * (1 + 1e-9) + 2
        high = np.where(reach < 2.0**62, reach, 0).astype(np.int64)
        high[reach >= 2.0**62] = LIMIT
        by_size[matrix.shape[1]] = Queries(ids, matrix, -high, high, 2 * (high // BINS) + 4, np.zeros(len(ids), np.int64))
    while not all(q.done for q in by_size.values()):
        shared = spark.sparkContext.broadcast({size: vars(q) for size, q in by_size.items()})
        found = candidates.mapInArrow(counts(shared, k), "query_id bigint, bin bigint, n bigint").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        below = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        # Bins from the top down to the one with the kth score: at most k rows for each query.
        upper = found.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0))).filter(F.col("before") < k).select("query_id", "bin", "n").toArrow()
        rows: dict[int, list[tuple[int, int]]] = {}
        for query, b, n in zip(*(upper.column(c).to_pylist() for c in ("query_id", "bin", "n"))):
            rows.setdefault(query, []).append((b, n))
        for dim, queries in by_size.items():
            by_size[dim] = refined(queries, rows, k)
    return candidates.mapInArrow(best(spark.sparkContext.broadcast({size: vars(q) for size, q in by_size.items()}), k), "query_id bigint, vec_id bigint, score bigint")


def whole_group(asked: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The queries of one group by the length of their vectors."""
    rows = asked.orderBy("id").toArrow()
    held: dict[int, tuple[list, list]] = {}
    for i, v in zip(rows.column("id").to_pylist(), rows.column("vector").to_pylist()):
        ids, vectors = held.setdefault(len(v), ([], []))
        ids.append(i)
        vectors.append(v)
    return [(np.array(ids, np.int64), whole_numbers(np.array(vectors, float).reshape(len(ids), size))) for size, (ids, vectors) in held.items()]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
