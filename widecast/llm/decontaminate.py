"""Benchmark passages in documents, found by spaced seeds and verified with substitutions allowed.

Words are lower-cased runs of word characters. A seed is a window of words of which a fixed mask
ignores some; the masks together ignore every pair of positions in a window, so any window with up to
two substituted words still shares a seed with the original. Around every shared seed the texts are
aligned and the best stretch of equal words, with few substituted ones in between, is measured.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from widecast.llm.common import ChunkTable, fresh, pieces, remembered, small_batches, texts_of

WINDOW = 12
GROUP = 3
MASKS = tuple(tuple(i for i in range(WINDOW) if i // GROUP not in ignored) for ignored in combinations(range(WINDOW // GROUP), 2))
SHORTEST = 5
MIN_EQUAL = 10
MIN_SHARE = 0.8
BLOCK_WORDS = 2_000_000
#: Stand before and behind each text and each item, so that windows reach over their ends; they equal nothing.
PAD = WINDOW - MIN_EQUAL
TEXT_PAD, ITEM_PAD = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
WORD_PATTERN = re.compile(r"\w+")


def chunk_words(chunk: str) -> list[str]:
    low = chunk.lower()
    word = low.strip(".,;:!?\"'()*$%&#|")
    return [word] if word.isalnum() else WORD_PATTERN.findall(low)


def word_hashes(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [chunk_words(c) for c in chunks]
    flat = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for f in found for w in f), np.uint64)
    return flat, np.fromiter(map(len, found), np.int64, len(found))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text's words end."""
    return remembered(("word hashes",), lambda: ChunkTable(word_hashes, np.uint64)).encode(texts)


def seeds_at(words: np.ndarray, width: int, masks: tuple[tuple[int, ...], ...]) -> Iterator[np.ndarray]:
    """For each mask the seed hashes of the windows that start at positions 0, 1, ..."""
    n = len(words) - width + 1
    if n <= 0:
        return
    multipliers = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3) ^ (0xC2B2AE3D27D4EB4F * (width + 1))) & (2**64 - 1) | 1) for i in range(width)]
    scaled = {i: words[i : i + n] * multipliers[i] for i in {i for mask in masks for i in mask}}
    for k, mask in enumerate(masks):
        total = np.full(n, (k + 1) * 0x165667B19E3779F9 & (2**64 - 1), np.uint64)
        for i in mask:
            total += scaled[i]
        yield total ^ (total >> np.uint64(29))


@dataclass
class Seeds:
    """Seeds of one block of items: a bit table to pass over most windows, and the sorted hashes."""

    items: list
    words: list[np.ndarray]
    widths: list[int]
    bits: int
    table: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    position: np.ndarray

    @staticmethod
    def of(rows: list[tuple]) -> Seeds:
        items, words = [r[0] for r in rows], []
        for _, text in rows:
            flat, _ = words_of([text or ""])
            words.append(flat)
        hashes, item, position = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i, flat in enumerate(words):
            if len(flat) < SHORTEST:
                continue
            whole = len(flat) < MIN_EQUAL  # all words must be equal
            width, masks = (len(flat), (tuple(range(len(flat))),)) if whole else (WINDOW, MASKS)
            for found in seeds_at(flat if whole else np.pad(flat, PAD, constant_values=ITEM_PAD), width, masks):
                hashes.append(found)
                item.append(np.full(len(found), i, np.int32))
                position.append(np.arange(len(found), dtype=np.int32) - (0 if whole else PAD))
        all_hashes = np.concatenate(hashes)
        order = np.argsort(all_hashes, kind="stable")
        bits = min(28, max(16, int(16 * len(all_hashes) + 1).bit_length()))
        table = np.zeros(1 << bits, bool)
        table[all_hashes >> np.uint64(64 - bits)] = True
        widths = sorted({WINDOW if len(w) >= MIN_EQUAL else len(w) for w in words if len(w) >= SHORTEST})
        return Seeds(items, words, widths, bits, table, all_hashes[order], np.concatenate(item)[order], np.concatenate(position)[order])

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``words``, item, position in the item) of every shared seed."""
        spots, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width in self.widths:
            for found in seeds_at(words, width, MASKS if width == WINDOW else (tuple(range(width)),)):
                maybe = np.flatnonzero(self.table[found >> np.uint64(64 - self.bits)])
                first = np.searchsorted(self.hashes, found[maybe], side="left")
                number = np.searchsorted(self.hashes, found[maybe], side="right") - first
                spots.append(np.repeat(maybe, number))
                ends = np.cumsum(number)
                rows.append(np.repeat(first - (ends - number), number) + np.arange(int(ends[-1]) if len(ends) else 0))
        at = np.concatenate(rows)
        return np.concatenate(spots), self.item[at], self.position[at]

    def overlaps(self, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word in the text, words, equal words): the best overlap for each pair."""
        starts = np.concatenate([[0], ends[:-1]])
        before = 2 * PAD * np.arange(len(ends))
        spots, item, position = self.candidates(np.insert(words, np.repeat(np.stack([starts, ends], axis=1).ravel(), PAD), TEXT_PAD))
        text = np.searchsorted(ends + before + 2 * PAD, spots, side="right")
        spots = spots - (starts + before)[text] - PAD if len(spots) else spots
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        # One alignment for each text, item and shift; windows that reach over a text's end fail here.
        for t, i, shift in np.unique(np.stack([text, item, spots - position], axis=1), axis=0).tolist() if len(spots) else []:
            own, other = words[starts[t] : ends[t]], self.words[i]
            low, high = max(0, -shift), min(len(other), len(own) - shift)
            if high <= low:
                continue
            equal = other[low:high] == own[low + shift : high + shift]
            first, beyond, same = best_stretch(equal)
            needed = min(MIN_EQUAL, len(other))
            if same >= needed and same >= MIN_SHARE * (beyond - first):
                found = (same, beyond - first, low + shift + first)
                if found > best.get((t, i), (0, 0, 0)):
                    best[t, i] = found
        return [(t, i, first, n, same) for (t, i), (same, n, first) in sorted(best.items())]


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """First, beyond and equal words of the stretch with most of +1 for equal and -3 for other words."""
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -3))])
    lowest = np.minimum.accumulate(score)
    beyond = int(np.argmax(score - lowest))
    first = int(np.flatnonzero(score[: beyond + 1] == lowest[beyond])[-1])
    return first, beyond, int(equal[first:beyond].sum())


def blocks_of(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[list[tuple]]:
    """The items in blocks of about ``BLOCK_WORDS`` words: each is small enough to go to every task.

    A benchmark of any size is worked through block by block, with one pass over the documents each.
    """
    items = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text") - F.length(F.translate("text", " \n\t", "")) + 1).alias("n")).first()["n"] or 0
    count = max(1, -(-int(size) // BLOCK_WORDS))
    for k in range(count):
        block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) if count > 1 else items
        yield sorted(((r["item"], r["text"]) for r in block.collect()), key=lambda r: (str(r[0]), r[1]))


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, first_word, n_words, n_equal``: the best overlap of each document and each row of ``benchmark``.

    An overlap counts with 10 equal words (all, for a shorter item) and at least 0.8 of the words
    equal, at the ends of texts and items as well. Items of under 5 words are too little evidence and
    never match; of 5 to 9 words, only the whole item does. Null and empty texts overlap with nothing; repeated rows give repeated results.
    The documents are read once for each block of items; nothing of them is shuffled.
    """
    small_batches(docs.sparkSession)
    ready = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = ready.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    out = None
    for rows in blocks_of(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        found = ready.mapInArrow(overlap_rows(shared), f"doc_id {kind}, item_id {item_kind}, first_word int, n_words int, n_equal int")
        out = found if out is None else out.unionAll(found)
    return out


def overlap_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds.of(shared.value)
        for batch in pieces(batches):
            found = seeds.overlaps(*words_of(texts_of(batch)))
            if found:
                columns = [batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int32())), pa.array([seeds.items[f[1]] for f in found])]
                columns += [pa.array([f[k] for f in found], pa.int32()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "first_word", "n_words", "n_equal"])

    return run


def without_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has no overlap with an item."""
    small_batches(docs.sparkSession)
    own = fresh(docs, "text_to_search")
    for rows in blocks_of(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = Seeds.of(shared.value)
            for batch in pieces(batches, own):
                keep = np.ones(len(batch), bool)
                keep[[f[0] for f in seeds.overlaps(*words_of(texts_of(batch, own)))]] = False
                yield batch.filter(pa.array(keep)).drop_columns([own])

        docs = docs.withColumn(own, F.col(text).cast("string")).mapInArrow(run, docs.schema)
    return docs


cloudpickle.register_pickle_by_value(sys.modules[__name__])
