"""Language of texts by cross-parsing: phrases needed to copy a text out of a language's sample.

For each language a suffix automaton holds all substrings of its sample. A text is parsed from left to
right into longest matches; a text in the language needs few and long phrases. The language with the
fewest phrases for each letter wins.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from widecast.llm.common import fresh, pieces, remembered, small_batches, texts_of

SAMPLE_DOCS = 200
SAMPLE_LETTERS = 12_000
MOST_SYMBOLS = 254
BLOCK = 256
UNDETERMINED = "und"
GAP, UNKNOWN = 0, 1
PHRASE = np.int32(1 << 30)


def letter_table() -> np.ndarray:
    """Which code points are letters, with their lower case; 0 for others."""

    def make() -> np.ndarray:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        return table

    return remembered(("lower letters",), make)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with one 0 for each gap between words, and each text's end."""
    joined = "\n".join(texts) + "\n"
    points = letter_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    is_letter = points > 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return points[keep], np.cumsum(keep)[ends - 1] if len(texts) else np.zeros(0, np.int64)


def suffix_automaton(sequence: list[int], width: int) -> np.ndarray:
    """Transitions of the minimal automaton of all substrings, one row of ``width`` for each state; -1: none."""
    table = np.full((2 * len(sequence) + 1, width), -1, np.int32)
    link, size = [-1], [0]
    moves: list[dict[int, int]] = [{}]
    last = 0
    for symbol in sequence:
        state = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in moves[p]:
            moves[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = moves[p][symbol]
            if size[q] == size[p] + 1:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(symbol) == q:
                    moves[p][symbol] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    for state, row in enumerate(moves):
        for symbol, target in row.items():
            table[state, symbol] = target
    return table[: len(moves)]


@dataclass
class LanguageModel:
    """Alphabet and one parsing table for all languages.

    The tables lie one behind the other. An entry holds the next state; where the match can't go on,
    the state after the symbol from the start, marked as a new phrase.
    """

    languages: list[str]
    alphabet: np.ndarray
    shift: int
    roots: np.ndarray
    table: np.ndarray

    @staticmethod
    def fit(samples: dict[str, list[str]], most_letters: int = SAMPLE_LETTERS) -> LanguageModel:
        languages = sorted(samples)
        found, counts = {}, Counter()
        for language in languages:
            flat, _ = letters(samples[language])
            found[language] = flat[:most_letters]
            counts.update(found[language][found[language] > 0].tolist())
        known = sorted(sorted(counts), key=lambda c: -counts[c])[:MOST_SYMBOLS]
        alphabet = np.full(sys.maxunicode + 1, UNKNOWN, np.uint8)
        alphabet[0] = GAP
        alphabet[known] = np.arange(2, len(known) + 2)
        shift = max(1, (len(known) + 1).bit_length())
        tables, roots, used = [], [], 0
        for language in languages:
            table = suffix_automaton(alphabet[found[language]].tolist(), 1 << shift)
            # One more state, between phrases: whatever comes begins one, and a symbol that the sample
            # doesn't have is one of its own.
            between = len(table)
            table[:, UNKNOWN] = -1
            start = np.where(table[0] >= 0, table[0], between)
            table = np.concatenate([table, np.full((1, 1 << shift), -1, np.int32)])
            full = np.where(table >= 0, table + used, (start + used) | PHRASE)
            tables.append(full.astype(np.int32))
            roots.append(used + between)
            used += len(table)
        return LanguageModel(languages, alphabet, shift, np.array(roots, np.int32), np.concatenate([np.zeros((0, 1 << shift), np.int32), *tables]).ravel())

    def phrases(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of every text (rows) in every language (columns).

        Texts are parsed in blocks of ``BLOCK`` letters, all blocks side by side, each beginning with a
        new phrase: the same small addition for every language.
        """
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        number = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(ends)), number)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        first = starts[owner] + nth * BLOCK
        length = np.minimum(BLOCK, ends[owner] - first)
        order = np.argsort(-length, kind="stable")
        first, length, owner = first[order], length[order], owner[order]
        count = np.zeros((len(self.languages), len(first)), np.int32)
        state = np.repeat(self.roots[:, None], len(first), axis=1)
        live = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")
        for step in range(BLOCK):
            n = int(live[step])
            if not n:
                break
            at = (state[:, :n] << self.shift) + symbols[first[:n] + step]
            moved = self.table[at]
            count[:, :n] += moved >> 30
            state[:, :n] = moved & (PHRASE - 1)
        out = np.zeros((len(ends), len(self.languages)), np.int64)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, count[k], len(ends))
        return out

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language (its number, -1: none) and score of every text.

        The score is the share that the best language has of the posterior if each phrase costs the
        bits of a position in the sample: 1 / (1 + sum of 2^(-bits * surplus phrases)); ties go to the
        language first in order.
        """
        flat, ends = letters(texts)
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts))
        phrases = self.phrases(self.alphabet[flat], ends)
        best = phrases.argmin(axis=1)
        surplus = (phrases - phrases.min(axis=1, keepdims=True)).astype(float)
        score = 1 / np.exp2(-np.minimum(surplus, 60) * 1.0).sum(axis=1)
        sizes = np.diff(ends, prepend=0)
        best[sizes == 0] = -1
        score[sizes == 0] = 0.0
        return best, score


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_letters: int = SAMPLE_LETTERS) -> LanguageModel:
    """Learn from about ``sample_docs`` distinct texts of each language, one at least, chosen by a hash of
    the text among the rows with ``learn``, and of these from the first ``sample_letters`` letters.

    Null languages and null texts are not learned from. With no language at all, every prediction is
    ``und``.
    """
    number = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).withColumn("number", number)
    # Copies of one text have one hash and are drawn together, so the share is of distinct texts. The
    # smallest hash is always in.
    known = rows.groupBy("lang", "number").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("n"), F.min("number").alias("least")).collect()
    if not known:
        return LanguageModel.fit({})
    below = F.lit(0)
    for r in known:
        share = min(1.0, (sample_docs + 4 * math.sqrt(sample_docs)) / r["n"])
        below = F.when(F.col("lang") == r["lang"], F.lit(max(math.ceil(share * (1 << 40)), r["least"] + 1))).otherwise(below)
    taken = rows.filter(F.col("number") < below).select("lang", "number", F.left("text", F.lit(sample_letters)).alias("text")).distinct().collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(taken, key=lambda r: (r["lang"], r["number"], r["text"])):
        samples.setdefault(r["lang"], [])
        if len(samples[r["lang"]]) < sample_docs:
            samples[r["lang"]].append(r["text"])
    return LanguageModel.fit(samples, sample_letters)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language of every whole text and its score (0 to 1) in columns ``names``.

    ``und`` with score 0 where the text is null or has no letter. Columns of ``docs`` with these names
    give way. One pass without a shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*names)
    own = fresh(docs, "text_to_parse")
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LanguageModel(**shared.value)
        labels = np.array([*known.languages, UNDETERMINED], dtype=object)
        for batch in pieces(batches, own):
            best, score = known.predict(texts_of(batch, own))
            rest = batch.drop_columns([own])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(labels[best], pa.string()), pa.array(score)], names=[*rest.schema.names, *names])

    schema = docs.withColumns({names[0]: F.lit("").cast("string"), names[1]: F.lit(0.0)}).schema
    return docs.withColumn(own, F.col(text).cast("string")).mapInArrow(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
