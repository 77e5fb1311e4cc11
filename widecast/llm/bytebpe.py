"""Byte-level BPE: splitting by a scan of transition functions, cached pair merging, decoding.

The split is that of the usual pattern for byte-level vocabularies: contractions ``'s 't 're 've 'm
'll 'd``, then runs of letters, of numbers and of other characters, each with at most one blank in
front, then white space, of which the last character is left to what follows.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from widecast.llm.common import ChunkTable, binaries, gather, pieces, remembered, small_batches, texts_of

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE = range(4)
# The white space of the pattern, and the contractions by length.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Letters and numbers of Unicode 16 that Python's table of 15.1 doesn't have yet: first and last of each range.
LETTERS_OF_UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_OF_UNICODE_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")

# Input symbols of the automaton: a class with what follows the character.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_INNER, S_BLANK, S_LAST = range(8)
# States: what the character before belongs to.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
START_OF_TEXT = 8
SCAN_STEPS = 128
BATCH_MERGE_BYTES = 40
NO_RANK = np.int32(2**31 - 1)


def class_table() -> np.ndarray:
    """Class of every code point."""
    return remembered(("code point classes",), made_class_table)


def made_class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8)
    for first, last in LETTERS_OF_UNICODE_16:
        table[first : last + 1] = LETTER
    for first, last in NUMBERS_OF_UNICODE_16:
        table[first : last + 1] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a token starts here", by 8 x symbol + state; symbols from 8 on start a text."""

    def step(symbol: int, state: int) -> tuple[int, bool]:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return FREE, False
        runs = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS}
        if symbol in (S_SHORT, S_LONG):
            if state in (IN_OTHERS, AFTER_BLANK):
                return IN_OTHERS, False
            return (ONE_LEFT if symbol == S_SHORT else TWO_LEFT), True
        if symbol in runs:
            return runs[symbol], state not in (runs[symbol], AFTER_BLANK)
        if symbol == S_INNER:
            return IN_SPACE, state != IN_SPACE
        return (AFTER_BLANK if symbol == S_BLANK else FREE), True

    return remembered(("split automaton",), lambda: made_automaton(step))


def made_automaton(step) -> tuple[np.ndarray, np.ndarray]:
    made = [step(symbol, state) for symbol in range(8) for state in range(8)]
    made += [step(symbol, FREE) for symbol in range(8) for _ in range(8)]
    return np.array([m[0] for m in made], np.uint8), np.array([m[1] for m in made], bool)


def symbols_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Input symbols of code points; ``first`` holds where texts begin. Shifts give what follows."""
    n = len(points)
    classes = class_table()[points]
    starts = np.zeros(n + 3, bool)
    starts[first] = True
    starts[n:] = True
    low = np.zeros(n + 2, np.uint32)
    low[:n] = points
    space = classes == SPACE
    out = classes.copy()  # letters, numbers and others keep their class as symbol
    followed = np.zeros(n, bool)  # by a character of the same text that is not white space
    followed[:-1] = ~space[1:] & ~starts[1:n]
    out[space] = np.where(followed, np.where(points == 32, S_BLANK, S_LAST), S_INNER)[space]
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        one, two = low[quotes + 1], low[quotes + 2]
        inside = ~starts[quotes + 1]
        short = inside & np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(quotes), bool)
        for a, b in LONG_ENDINGS:
            long |= (one == ord(a)) & (two == ord(b))
        long &= inside & ~starts[quotes + 2]
        out[quotes[short]] = S_SHORT
        out[quotes[long]] = S_LONG
    out[first] += START_OF_TEXT
    return out


def token_starts(symbols: np.ndarray) -> np.ndarray:
    """Where tokens start, by a blocked scan over the associative composition of transitions.

    Every block of symbols is a function from the state before it to the state after it. All blocks
    build theirs at once, the functions are composed in order, and a last pass runs each block from
    its true state.
    """
    move, begins = automaton()
    n = len(symbols)
    width = -(-n // SCAN_STEPS)
    padded = np.zeros(width * SCAN_STEPS, np.uint8)
    padded[:n] = symbols
    steps = np.ascontiguousarray(padded.reshape(width, SCAN_STEPS).T) << 3
    # A letter, number or white space decides the next state unless a contraction is running, so
    # functions of few steps already agree; still all eight states are carried.
    functions = np.repeat(np.arange(8, dtype=np.uint8)[:, None], width, axis=1)
    for row in steps:
        functions = move[row[None, :] | functions]
    state, entry = FREE, np.empty(width, np.uint8)
    for i, column in enumerate(functions.T.tolist()):
        entry[i] = state
        state = column[state]
    marks = np.empty((SCAN_STEPS, width), bool)
    for i, row in enumerate(steps):
        at = row | entry
        marks[i] = begins[at]
        entry = move[at]
    return np.flatnonzero(marks.T.reshape(-1)[:n])


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts joined, where tokens start in it, and where each text ends in it."""
    joined = "".join(texts)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    if not joined:
        return joined, np.zeros(0, np.int64), ends
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.unique(np.concatenate([[0], ends[:-1]]))
    return joined, token_starts(symbols_of(points, first[first < len(points)])), ends


def hashed(keys: np.ndarray, bits: int) -> np.ndarray:
    """A slot of 2^bits for each key, from the high bits of a product."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Vocabulary:
    """Ranks of byte strings, and the merging of one piece by them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values(), default=-1) + 1
        tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        # Every pair of tokens whose bytes together are a token.
        pairs = [(a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        keys = np.array([(a << 32) | b for a, b, _ in pairs], np.int64)
        values = np.array([rank for _, _, rank in pairs], np.int32)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slot_keys = np.full(1 << self.bits, -1, np.int64)
        self.slot_values = np.zeros(1 << self.bits, np.int32)
        slots = hashed(keys, self.bits)
        while len(keys):  # of those that want a free slot the last written has it; the others go on
            free = self.slot_keys[slots] < 0
            self.slot_keys[slots[free]] = keys[free]
            placed = self.slot_keys[slots] == keys
            self.slot_values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & ((1 << self.bits) - 1)
        self.byte_ids = np.array([self.ranks.get(bytes([i]), 0) for i in range(256)], np.int32)
        self.known = ChunkTable(self.rows_of, np.uint32)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the adjacent pair of lowest rank is merged until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 200:
            return self.merge_long(parts)
        found = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, rank in enumerate(found):
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at < len(found):
                found[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                found[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def merge_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap and linked parts, for long runs without a boundary."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or parts[i] is not a or parts[j] is not b:
                continue
            parts[i], live[j] = a + b, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (r := ranks.get(parts[before[i]] + parts[i])) is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
        return [ranks[p] for p, alive in zip(parts, live) if alive]

    def merge_batch(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` for many pieces of one length at once (rows of bytes): ids and their numbers."""
        n, width = words.shape
        ids = self.byte_ids[words]
        sizes = np.empty(n, np.int64)
        done = np.zeros((n, width), np.int32)
        ranks = np.full((n, width), NO_RANK, np.int32)
        ranks[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        rows = np.arange(n)
        for left in range(width, 0, -1):  # every live row has ``left`` parts
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            go = best != NO_RANK
            if not go.all():
                over = rows[~go]
                done[over, :left] = ids[~go]
                sizes[over] = left
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
            if not len(rows):
                break
            keep = np.ones(ids.shape, bool)
            row = np.arange(len(rows))
            keep[row, at + 1] = False
            ids[row, at] = best
            ids = ids[keep].reshape(len(rows), left - 1)
            keep[row, at + 1] = True
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(rows), left - 1)
            inner = np.flatnonzero(at < left - 2)
            ranks[inner, at[inner]] = self.pair_ranks(best[inner], ids[inner, at[inner] + 1])
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.pair_ranks(ids[inner, at[inner] - 1], best[inner])
        return done[np.arange(width) < sizes[:, None]].astype(np.uint32), sizes

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, by probing an open hash table."""
        keys = (left.astype(np.int64) << 32) | right
        slots = hashed(keys, self.bits)
        found = self.slot_keys[slots]
        out = np.where(found == keys, self.slot_values[slots], NO_RANK)
        open_ = (found != keys) & (found >= 0)
        while open_.any():
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_keys[slots]
            out = np.where(open_ & (found == keys), self.slot_values[slots], out)
            open_ &= (found != keys) & (found >= 0)
        return out

    def rows_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces: short ones in batches of one length, long ones by ``merge``."""
        encoded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.zeros(len(encoded), np.int64)
        singles, groups = [], []
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(encoded):
            rank = self.ranks.get(piece)
            if rank is not None:
                singles.append((i, rank))
            elif len(piece) > BATCH_MERGE_BYTES:
                ids = np.array(self.merge(piece), np.uint32)
                groups.append((np.array([i]), ids, np.array([len(ids)])))
            elif piece:
                by_length.setdefault(len(piece), []).append(i)
        if singles:
            at, ranks = np.array(singles, np.int64).T
            groups.append((at, ranks.astype(np.uint32), np.ones(len(at), np.int64)))
        for width, members in by_length.items():
            words = np.frombuffer(b"".join(encoded[i] for i in members), np.uint8).reshape(-1, width)
            groups.append((np.array(members), *self.merge_batch(words)))
        starts, flat, used = np.zeros(len(encoded), np.int64), [], 0
        for at, ids, lengths in groups:
            sizes[at] = lengths
            starts[at] = used + np.cumsum(lengths) - lengths
            used += len(ids)
            flat.append(ids)
        return gather(np.concatenate([np.zeros(0, np.uint32), *flat]), starts, sizes), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids end."""
        joined, starts, ends = split(texts)
        stops = np.append(starts[1:], len(joined))
        flat, lengths = self.known.values_of([joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())])
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return flat, upto[np.searchsorted(starts, ends)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.starts[ids], self.lengths[ids])


def vocabulary(path: str) -> Vocabulary:
    return remembered(("ranks", path), lambda: Vocabulary(path))


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every whole text by the ranks in ``path`` (a file every executor has at that place).

    Gives ``id_column``, ``n_tokens``, ``ids`` (unsigned 32-bit, little-endian) and ``ends`` (the
    offset in the text's bytes where each token ends, in the same form). A null text counts as empty
    and has no ids; repeated rows give repeated results; other columns are not carried. Needs no
    shuffle; memory is bounded by a run of rows of some megabytes or by the longest text.
    """
    small_batches(df.sparkSession)
    ready = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in pieces(batches):
            ids, ends = vocab.encode(texts_of(batch))
            byte_ends = np.cumsum(vocab.lengths[ids])
            first = np.concatenate([[0], ends[:-1]])
            counts = ends - first
            base = np.where(first > 0, byte_ends[first - 1] if len(ids) else 0, 0)
            byte_ends = (byte_ends - np.repeat(base, counts)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), binaries(ids, ends), binaries(byte_ends, ends)],
                names=["doc_id", "n_tokens", "ids", "ends"],
            )

    kind = ready.schema["doc_id"].dataType.simpleString()
    out = ready.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, ends binary")
    return out.withColumnRenamed("doc_id", id_column)


def decode(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Bytes of encoded rows as ``decoded``, next to the columns of ``encode``.

    Null ids give empty bytes. An id outside the vocabulary is an error.
    """
    small_batches(df.sparkSession)
    ready = df.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col("n_tokens"), F.lit(0)).alias("n_tokens"), F.coalesce(F.col(ids_column), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in pieces(batches, "ids"):
            column = batch.column("ids")
            ids = np.frombuffer(b"".join(column.to_pylist()), np.uint32)
            counts = np.fromiter((len(x.as_buffer()) // 4 for x in column), np.int64, len(column))
            if len(ids) and int(ids.max()) >= len(vocab.lengths):
                raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {len(vocab.lengths)}")
            upto = np.concatenate([[0], np.cumsum(vocab.lengths[ids])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"), column, binaries(vocab.decode(ids), upto[np.cumsum(counts)])],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    kind = ready.schema["doc_id"].dataType.simpleString()
    out = ready.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary")
    return out.withColumnRenamed("doc_id", id_column)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
