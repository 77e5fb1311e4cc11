"""Draw the documents that look most like a target text, by importance resampling.

Every run of one to three words is a feature, hashed to a bucket. A bucket's gain is the logarithm of
its share in the target over its share in the corpus; a document's weight is the sum over its features.
A Gumbel variate from a hash of the id is added, so that the highest scores are a draw without
replacement in proportion to the weights. The exact cutoff key is found by weighted medians of medians:
groups of rows send their median and their number, each round discards a guaranteed fraction of the
rest, and only the winners are sorted.

Features are hashed on arrays: CRC-32 is linear, so the state behind a run of words is the state behind
its first words, moved over the length of the last one by table lookups, xor the last one's own.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from widecast.llm.common import flat_bytes, pieces, remembered, small_batches, stored

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = (5, 100)
SEED = 42
GROUP_ROWS = 1 << 18
SHRINK = 8
WORDS_AT_ONCE = 200_000
DIRECT = 64
ONES = np.uint32(0xFFFFFFFF)
#: Column names of a row's place in the order of the draw, smallest first.
KEY = ("worse", "no_id", "id", "row")


class Crc:
    """CRC-32 of many byte strings at once, and of strings put behind others."""

    def __init__(self) -> None:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1)).astype(np.uint32)
        self.step = step
        # A state moved over n zero bytes, by the four bytes of the state, for n up to DIRECT.
        shift = np.empty((DIRECT + 1, 4, 256), np.uint32)
        shift[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
        for n in range(DIRECT):
            shift[n + 1] = self.behind(shift[n], 0)
        self.flat = shift.ravel()
        # The same for powers of two, for longer strings.
        self.powers = [shift[1]]
        while len(self.powers) < 40:
            last = self.powers[-1]
            self.powers.append(self.by_table(last, last))

    def behind(self, state: np.ndarray, byte: int) -> np.ndarray:
        return self.step[(state ^ np.uint32(byte)) & np.uint32(255)] ^ (state >> np.uint32(8))

    @staticmethod
    def by_table(table: np.ndarray, state: np.ndarray) -> np.ndarray:
        byte = np.uint32(255)
        return table[0][state & byte] ^ table[1][(state >> np.uint32(8)) & byte] ^ table[2][(state >> np.uint32(16)) & byte] ^ table[3][state >> np.uint32(24)]

    def over(self, state: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The states moved over so many zero bytes each."""
        at = np.minimum(lengths, DIRECT) * 1024
        byte = np.uint32(255)
        out = self.flat[at + (state & byte)]
        for k in (1, 2, 3):
            out ^= self.flat[at + 256 * k + ((state >> np.uint32(8 * k)) & byte)]
        long = np.flatnonzero(lengths > DIRECT)
        if len(long):
            moved, rest = state[long], lengths[long]
            for k in range(int(rest.max()).bit_length()):
                moved = np.where(rest >> k & 1, self.by_table(self.powers[k], moved), moved)
            out[long] = moved
        return out

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The states behind words that begin with state 0."""
        out = np.zeros(len(starts), np.uint32)
        order = np.argsort(-np.minimum(lengths, DIRECT + 1), kind="stable")
        short = order[int((lengths > DIRECT).sum()) :]
        first, size = starts[short], lengths[short]
        state = np.zeros(len(short), np.uint32)
        left = len(short)
        for k in range(int(size[0]) if left else 0):
            left = int(np.searchsorted(-size, -k, side="left"))
            state[:left] = self.step[(state[:left] ^ data[first[:left] + k]) & np.uint32(255)] ^ (state[:left] >> np.uint32(8))
        out[short] = state
        for i in order[: len(order) - len(short)].tolist():
            out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes(), 0xFFFFFFFF) ^ 0xFFFFFFFF
        return out


def crc() -> Crc:
    return remembered(("crc",), Crc)


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z as a-z, where words start, their lengths, and how many words come before each text's end.

    Words are runs of a-z, 0-9 and bytes of other code points; they end with their text.
    """
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data = lower[raw]
    is_word = np.zeros(256, bool)
    is_word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    inside = is_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside[1:], [False]])
    stops = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return data, starts, stops - starts, np.searchsorted(starts, bounds[1:], side="left")


def feature_buckets(raw: np.ndarray, bounds: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the features, some words at a time.

    Each block gives the number of its first word, an array (3, words) with the buckets of the runs of
    one, two and three words that start at each word, which of them there are, and the words before each
    text's end. Runs end with their text.
    """
    table = crc()
    data, starts, lengths, ends = words_of(raw, bounds)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    n = len(starts)
    for low in range(0, n, WORDS_AT_ONCE):
        high = min(n, low + WORDS_AT_ONCE)
        beyond = min(n, high + 2)
        own = table.words(data, starts[low:beyond], lengths[low:beyond])
        size, of = lengths[low:beyond], text[low:beyond]
        m = high - low
        state = own ^ table.over(np.full(len(own), ONES), size)
        found, there = np.zeros((3, m), np.int64), np.zeros((3, m), bool)
        found[0], there[0] = (state[:m] ^ ONES).astype(np.int64) % buckets, True
        for k in (1, 2):
            more = max(0, len(own) - k)
            state = table.over(table.behind(state[:more], 32), size[k : k + more]) ^ own[k : k + more]
            some = min(m, more)
            found[k, :some] = (state[:some] ^ ONES).astype(np.int64) % buckets
            there[k, :some] = of[:some] == of[k : k + some]
        yield low, found, there, ends
    if n == 0:
        yield 0, np.zeros((3, 0), np.int64), np.zeros((3, 0), bool), ends


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. Tasks send their sums, at most ``buckets`` rows each."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches):
            for _, found, there, _ in feature_buckets(*flat_bytes(batch.column("text")), buckets):
                total += np.bincount(found[there], minlength=buckets)
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(total[kept])], names=["bucket", "n"])

    sums = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the corpus."""
    buckets, of_corpus, of_target = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = [(t + 1) * (of_corpus + buckets) / ((s + 1) * (of_target + buckets)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row, n_words, n_features, weight`` of every row, in one pass; ``row`` is unique."""
    small_batches(df.sparkSession)
    ready = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            sums = [np.zeros(1, np.int64)]
            for _, found, there, ends in feature_buckets(*flat_bytes(batch.column("text")), len(gain)):
                block = np.where(there, gain[found], 0).sum(axis=0)
                sums.append(sums[-1][-1] + np.cumsum(block))
            upto = np.concatenate(sums)
            words = np.diff(ends, prepend=0)
            features = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            columns = [batch.column("doc_id"), pa.array(row + np.arange(len(batch))), pa.array(words), pa.array(features), pa.array(np.diff(upto[ends], prepend=0))]
            row += len(batch)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_words", "n_features", "weight"])

    return ready.mapInArrow(run, "doc_id bigint, row bigint, n_words bigint, n_features bigint, weight bigint")


def variate(doc_id: str, seed: int) -> Column:
    """Thousandths of a standard Gumbel variate from a hash of seed and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))


def keyed(scored: DataFrame) -> DataFrame:
    """The order of the draw as four numbers: higher scores, then smaller ids, null ids last, then rows."""
    return scored.select((-F.col("score")).alias("worse"), F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row")


def below(key: tuple, strictly: bool = True) -> Column:
    """Whether a row's key is smaller than ``key`` (or equal to it)."""
    out = F.lit(not strictly)
    for name, value in reversed(list(zip(KEY, key))):
        out = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def group_medians(keys: DataFrame, pivot: tuple | None, group_rows: int) -> list[tuple]:
    """One row for each group of rows and side of the pivot: side, number of rows, median key.

    Sides are -1 (below the pivot), 0 (the pivot's row) and 1; without a pivot all rows are of side 1.
    A group is what a task reads, up to ``group_rows`` rows.
    """

    def summaries(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held, axis=1)
        side = np.ones(rows.shape[1], np.int64)
        if pivot is not None:
            side[:] = 0
            for column, value in zip(rows, pivot):
                side = np.where(side == 0, np.sign(column - value), side)
        out = []
        for s in (-1, 0, 1):
            part = rows[:, side == s]
            if part.shape[1]:
                order = np.lexsort(part[::-1])
                out.append((s, part.shape[1], *part[:, order[(part.shape[1] - 1) // 2]].tolist()))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["side", "n", *KEY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), group_rows):
                part = batch.slice(at, group_rows)
                if n and n + len(part) > group_rows:
                    yield summaries(held)
                    held, n = [], 0
                held.append(np.stack([part.column(c).to_numpy() for c in KEY]))
                n += len(part)
        if n:
            yield summaries(held)

    return [tuple(r) for r in keys.mapInArrow(run, "side bigint, n bigint, worse bigint, no_id bigint, id bigint, row bigint").collect()]


def weighted_median(medians: list[tuple]) -> tuple:
    """The median key of (number of rows, key) pairs, each counted as often as it has rows."""
    ordered = sorted((r[2:], r[1]) for r in medians)
    half, seen = sum(n for _, n in ordered) / 2, 0
    for key, n in ordered:
        seen += n
        if seen >= half:
            return key
    raise ValueError("no rows")


def cutoff(scored: DataFrame, number: int, group_rows: int = GROUP_ROWS) -> tuple | None:
    """The key of the ``number``-th row in the order of the draw (None for 0): exact, whatever the order of rows.

    The weighted median of the groups' medians has a quarter of the remaining rows on either side at
    least, so every round keeps three quarters at most. Rounds read a table of keys, which is written
    anew when an eighth of it remains; the driver sees one row for each group and side.
    """
    if number < 1:
        return None
    keys, low, high = keyed(scored), None, None
    found = group_medians(keys, None, group_rows)
    size = remaining = sum(r[1] for r in found)
    if number > remaining:
        raise ValueError("fewer rows than asked for")
    wanted = number
    pivot = weighted_median(found)
    while True:
        rest = keys
        if low is not None:
            rest = rest.filter(~below(low, strictly=False))
        if high is not None:
            rest = rest.filter(below(high))
        if remaining * SHRINK <= size:
            keys = rest = stored(rest, "draw-keys")
            size = remaining
        found = group_medians(rest, pivot, group_rows)
        smaller = [r for r in found if r[0] == -1]
        n = sum(r[1] for r in smaller)
        if wanted <= n:
            high, remaining = pivot, n
            pivot = weighted_median(smaller)
        elif wanted == n + 1:
            return pivot
        else:
            larger = [r for r in found if r[0] == 1]
            low, wanted, remaining = pivot, wanted - n - 1, sum(r[1] for r in larger)
            pivot = weighted_median(larger)


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with ``rank`` from 1 in the order of the draw: sorted in ranges, numbered by the ranges' sizes."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    dealt = stored(winners.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "drawn")
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    # One row for each range of the sort.
    return dealt.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + inside).drop("range", "before")


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``; undrawn rows have a null rank.

    Of the N rows with ``least_words`` words or more, floor(share * N) are drawn: the highest scores, ties
    to smaller ids, null ids last; rows of one id and score are drawn in the order they were read. Ids are
    integers (a null id is an empty text to the hash). Null texts are empty texts, with weight 0. Equal
    texts have one weight, and repeated rows count as often as they come. Other columns are left out. Empty
    tables: without documents there is no row, without target texts only the corpus's counts matter.

    Two passes over the texts; all later steps work on a stored table of numbers. Nothing is shuffled but
    bucket sums and the winners.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    scored = stored(weigh(docs, gain, doc_id, text).withColumn("score", F.col("weight") + variate("doc_id", seed)), "draw-scores")
    may = scored.filter(F.col("n_words") >= least_words)
    number = share[0] * may.count() // share[1]
    last = cutoff(may, number, group_rows)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    key = keyed(scored)
    named = scored.withColumns({"worse": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0))})
    drawn = (F.col("n_words") >= least_words) & below(last, strictly=False)
    lost = named.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return lost.unionByName(ranked(named.filter(drawn).drop(*KEY[:3])).select(*columns, F.col("rank").cast("long").alias("rank")))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
