"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from widecast.session import ensure_checkpoint_dir

ROWS_PER_BATCH = 1000
PIECE_BYTES = 2_000_000
REMEMBERED_CHUNKS = 300_000
REMEMBERED_VALUES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches between Spark and Python: long texts come in rows of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front, so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_crc(column: str = "doc_id") -> Column:
    """CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``most`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: none), and where each text starts and the last ends."""
    full = pc.fill_null(column.cast(pa.large_string()), "")
    if len(full) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = full.buffers()
    ends = np.frombuffer(offsets, np.int64)[full.offset : full.offset + len(full) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[s:s+n]`` one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)]


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ``values`` that end at ``ends`` as an Arrow binary column."""
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends
    offsets *= values.dtype.itemsize
    if offsets[-1] < 2**31:
        kind, offsets = pa.binary(), offsets.astype(np.int32)
    else:
        kind = pa.large_binary()
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: dict[int, int], doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """``text, label`` of about ``rows[c]`` rows of each class ``c``, and the size of each class.

    Rows are chosen by a hash of the id among the labels with ``learn``, so the choice grows with no
    table; the chosen ids are a bounded table that goes to every task. Null labels, null ids and
    classes not named are no examples.
    """
    known = labels.filter(learn & F.col(doc_id).isNotNull()).select(F.col(doc_id), F.col(label).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect() if r["label"] in rows}
    share = F.lit(0.0)
    for c, n in sizes.items():
        share = F.when(F.col("label") == c, F.lit(min(1.0, rows[c] / n))).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64(doc_id), F.lit(1 << 40)) < share * (1 << 40))
    texts = docs.select(F.col(doc_id), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), doc_id)
    return texts.select("text", "label"), sizes


def with_columns_of(batch: pa.RecordBatch, drop: str, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    """The batch without ``drop`` and with further columns."""
    rest = batch.drop_columns([drop])
    return pa.RecordBatch.from_arrays([*rest.columns, *columns], names=[*rest.schema.names, *names])


def remembered(key: tuple, make: Callable):
    """``make()``, kept for the later tasks of this Python process. Task code is sent by value, so its
    own module variables end with the task."""
    kept = sys.__dict__.setdefault("widecast_remembered", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


class ChunkTable:
    """Values of chunks of text, remembered from text to text.

    ``rows_of`` gives the values of several chunks, one after the other, and their numbers. Texts repeat their chunks, so a dictionary
    and array gathers replace most of the work. At a bound of entries the quarter that was met most
    often stays and the rest is forgotten; results do not depend on it.
    """

    def __init__(self, rows_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: type) -> None:
        self.rows_of, self.dtype = rows_of, dtype
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.values = np.empty(1 << 16, self.dtype)
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.hits = np.zeros(1 << 12, np.int64)
        self.used = 0

    def forget(self) -> None:
        """Keep the quarter of the entries met most often, if their values are not too many."""
        chunks = list(self.index)
        n = len(chunks)
        kept = np.sort(np.argpartition(-self.hits[:n], n // 4)[: n // 4])
        kept = kept[np.cumsum(self.lengths[kept]) <= REMEMBERED_VALUES // 2]
        values, lengths, hits = gather(self.values, self.starts[kept], self.lengths[kept]), self.lengths[kept], self.hits[kept]
        self.clear()
        self.store([chunks[i] for i in kept.tolist()], values, lengths)
        self.hits[: len(kept)] = hits // 2

    def learn(self, chunks: list[str]) -> None:
        self.store(chunks, *self.rows_of(chunks))

    def store(self, chunks: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.index)
        while len(self.starts) < first + len(chunks):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        while len(self.values) < self.used + len(flat):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        self.starts[first : first + len(chunks)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(chunks)] = lengths
        self.values[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.index.update(zip(chunks, range(first, first + len(chunks))))

    def values_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The values of all chunks, one after the other, and the number of each chunk's values."""
        if len(self.index) > REMEMBERED_CHUNKS or self.used > REMEMBERED_VALUES:
            self.forget()
        rows = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            self.learn(list(dict.fromkeys(chunks[i] for i in missing.tolist())))
            rows[missing] = [self.index[chunks[i]] for i in missing.tolist()]
        self.hits[: len(self.index)] += np.bincount(rows, minlength=len(self.index))
        lengths = self.lengths[rows]
        return gather(self.values, self.starts[rows], lengths), lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The values of all texts, cut at blanks and newlines, and where each text's values end."""
        lists = [t.replace("\n", " ").split(" ") for t in texts]
        flat, lengths = self.values_of([c for one in lists for c in one])
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return flat, upto[np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
