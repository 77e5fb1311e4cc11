"""Token ids in shard files, compressed by a Re-Pair grammar that allows random access.

A file row is one block: some documents of consecutive id. Frequent pairs of adjacent symbols are
replaced by new symbols, round after round; the row keeps the pairs (``rules``), how many ids each new
symbol stands for (``spans``) and what is left of the sequence (``symbols``). Symbols below ``base``
are ids. Pairs never reach over the end of a document, so every document is a run of symbols.
"""

from __future__ import annotations

import math
import os
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from widecast.llm.common import binaries, flat_bytes, gather, pieces, remembered, scratch, small_batches

BLOCK_IDS = 1_000_000
PART_BYTES = 32 << 20
#: A part has at least so many times the root of the table's bytes: a quarter of a GB at 100 TB.
GROWTH = 25
REMEMBERED = 1_000_000
MIN_COUNT = 4
PAIRS_A_ROUND = 10_000
WORDS_PER_CALL = 500
#: The lowest 0 to 8 bytes of a number.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SLACK = np.zeros(8, np.uint8)
FILE_SCHEMA = (
    "part int, block int, start_in_part bigint, n_tokens bigint, base int, doc_ids array<{kind}>, "
    "doc_ends binary, symbol_ends binary, rules binary, spans binary, symbols binary"
)


class Chunks:
    """Values of byte strings, remembered in arrays: an open hash table of verified entries.

    ``values_of`` gives the values of new strings, whose bytes lie one after the other, and their numbers.

    A string's hash is a difference of prefix sums of its bytes times powers of an odd number, so all
    strings of a buffer are hashed at once. Entries are compared byte by byte. At a bound of entries
    the quarter that was met most often stays; results do not depend on it.
    """

    BASE = 0x9E3779B97F4A7C15 | 1
    LONGEST = 256  # longer strings are not remembered
    SPAN = 1 << 18  # bytes hashed at once

    def __init__(self, values_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], dtype: type, most: int = REMEMBERED) -> None:
        self.values_of, self.dtype, self.most = values_of, dtype, most
        self.bits = (2 * most).bit_length()
        n = self.SPAN + self.LONGEST + 1
        inverse = pow(self.BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.BASE, np.uint64)]), dtype=np.uint64)
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.n = 0
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.hits, self.sizes, self.starts, self.lengths, self.offsets = (np.zeros(1 << 12, np.int32) for _ in range(5))
        self.bytes, self.byte_count = np.zeros(1 << 16, np.uint8), 0
        self.values, self.value_count = np.zeros(1 << 16, self.dtype), 0

    def hashed(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hashes of short strings in order of their places, which lie within ``SPAN`` bytes."""
        low = int(starts[0])
        part = data[low : int(starts[-1] + sizes[-1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * self.powers[: len(part)], out=sums[1:])
        at = starts - low
        h = (sums[at + sizes] - sums[at]) * self.inverses[at] + sizes.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def same(self, entry: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which strings are those of their entries, compared eight bytes at a time."""
        out = self.sizes[entry] == sizes
        low = int(starts[0])
        here, held = words_at(np.concatenate([data[low : int(starts[-1] + sizes[-1])], SLACK])), words_at(self.bytes)
        live = np.flatnonzero(out & (sizes > 0))
        done = 0
        while len(live):
            left = sizes[live] - done
            differ = here[starts[live] - low + done] ^ held[self.offsets[entry[live]] + done]
            equal = differ & MASKS[np.minimum(left, 8)] == 0
            out[live[~equal]] = False
            live = live[equal & (left > 8)]
            done += 8
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        mask = (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        entry = self.slots[at].astype(np.int64)
        live = np.flatnonzero((entry >= 0) & (self.hashes[entry] != hashes))
        while len(live):
            at[live] = (at[live] + 1) & mask
            entry[live] = self.slots[at[live]]
            live = live[(entry[live] >= 0) & (self.hashes[entry[live]] != hashes[live])]
        return entry

    def place(self, hashes: np.ndarray, first: int) -> None:
        """Put new entries, of different hashes, into free slots."""
        mask = (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        live = np.arange(len(hashes))
        while len(live):
            free = live[self.slots[at[live]] < 0]
            self.slots[at[free]] = first + free
            live = live[self.slots[at[live]] != first + live]
            at[live] = (at[live] + 1) & mask

    def store(self, hashes: np.ndarray, raw: np.ndarray, sizes: np.ndarray, flat: np.ndarray, lengths: np.ndarray, hits: np.ndarray | None = None) -> None:
        first, m = self.n, len(hashes)
        for name in ("hashes", "hits", "sizes", "starts", "lengths", "offsets"):
            held = getattr(self, name)
            if len(held) < first + m:
                setattr(self, name, np.concatenate([held, np.zeros(max(len(held), m), held.dtype)]))
        if len(self.bytes) < self.byte_count + len(raw) + len(SLACK):
            self.bytes = np.concatenate([self.bytes, np.zeros(max(len(self.bytes), len(raw)), np.uint8), SLACK])
        if len(self.values) < self.value_count + len(flat):
            self.values = np.concatenate([self.values, np.zeros(max(len(self.values), len(flat)), self.dtype)])
        here = slice(first, first + m)
        self.hashes[here], self.sizes[here], self.lengths[here] = hashes, sizes, lengths
        self.offsets[here] = self.byte_count + np.cumsum(sizes) - sizes
        self.starts[here] = self.value_count + np.cumsum(lengths) - lengths
        self.hits[here] = 0 if hits is None else hits
        self.bytes[self.byte_count : self.byte_count + len(raw)] = raw
        self.values[self.value_count : self.value_count + len(flat)] = flat
        self.n, self.byte_count, self.value_count = first + m, self.byte_count + len(raw), self.value_count + len(flat)
        self.place(hashes, first)

    def forget(self) -> None:
        kept = np.sort(np.argpartition(-self.hits[: self.n], self.n // 4)[: self.n // 4])
        held = [x[kept] for x in (self.hashes, self.sizes, self.lengths, self.hits)]
        raw, flat = gather(self.bytes, self.offsets[kept], held[1]), gather(self.values, self.starts[kept], held[2])
        self.clear()
        self.store(held[0], raw, held[1], flat, held[2], held[3] // 2)

    def short(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of short strings that lie within ``SPAN`` bytes, and their numbers."""
        if self.n > self.most:
            self.forget()
        hashes = self.hashed(data, starts, sizes)
        entry = self.find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, at = np.unique(hashes[new], return_index=True)
            chosen = np.sort(new[at])
            raw = gather(data, starts[chosen], sizes[chosen])
            self.store(hashes[chosen], raw, sizes[chosen], *self.values_of(raw, sizes[chosen]))
            entry[new] = self.find(hashes[new])
        self.hits[: self.n] += np.bincount(entry, minlength=self.n).astype(np.int32)
        lengths, at = self.lengths[entry], self.starts[entry]
        flat = gather(self.values, at, lengths)
        wrong = np.flatnonzero(~self.same(entry, data, starts, sizes))
        if len(wrong):  # another string of the same hash
            flat, lengths = spliced(flat, lengths, wrong, *self.values_of(gather(data, starts[wrong], sizes[wrong]), sizes[wrong]))
        return flat, lengths

    def values_at(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all strings, one after the other, and the number of each one's values."""
        long = np.flatnonzero(sizes > self.LONGEST)
        some = np.flatnonzero(sizes <= self.LONGEST)
        span = (starts[some] - (starts[some[0]] if len(some) else 0)) // self.SPAN
        cuts = np.flatnonzero(np.diff(span)) + 1
        parts = [self.short(data, starts[k], sizes[k]) for k in np.split(some, cuts) if len(k)]
        flat = np.concatenate([np.zeros(0, self.dtype), *(f for f, _ in parts)])
        lengths = np.zeros(len(starts), np.int64)
        lengths[some] = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
        if len(long):
            flat, lengths = spliced(flat, lengths, long, *self.values_of(gather(data, starts[long], sizes[long]), sizes[long]))
        return flat, lengths


def words_at(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray(len(padded) - len(SLACK) + 1, "<u8", padded, strides=(1,))


def letters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are of unaccented or precomposed Latin letters, and which of those are of small ones."""
    lead = raw == 0xC3
    behind = np.concatenate([[False], lead[:-1]])
    small = (raw >= 97) & (raw <= 122)
    plain = small | (raw >= 65) & (raw <= 90)
    accent = behind & (raw >= 0x80) & (raw <= 0xBF) & (raw != 0x97) & (raw != 0xB7)
    small_accent = accent & (raw >= 0x9F)
    return plain | accent | np.concatenate([accent[1:], [False]]), small | small_accent | np.concatenate([small_accent[1:], [False]])


def sums_of(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many flags are set in each of the runs that lie one after the other."""
    upto = np.concatenate([[0], np.cumsum(flags)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def spliced(flat: np.ndarray, lengths: np.ndarray, at: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` with those at ``at`` exchanged for runs of ``other``."""
    starts, ends = np.cumsum(lengths) - lengths, lengths.copy()
    starts[at], ends[at] = len(flat) + np.cumsum(sizes) - sizes, sizes
    return gather(np.concatenate([flat, other]), starts, ends), ends


def chunk_places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes between blanks, newlines and the texts' ends: starts, sizes, and how many come before each text's end."""
    inside = (data != 32) & (data != 10)
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | cut[:-1]))
    stops = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | cut[1:])) + 1
    return starts, stops - starts, np.searchsorted(starts, bounds[1:], side="left")


class TextIds:
    """Ids of texts by the ``tokenizers`` library, which is asked once for each distinct piece."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = None
        if suffix:
            self.closes = np.zeros(self.size, bool)
            self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.parts = Chunks(self.library, self.kind, 3 * REMEMBERED // 5)
        self.chunks = Chunks(self.split, self.kind)

    def library(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in small letters go in long strings, cut again where an id closes a word; all else one by one."""
        sizes = sizes.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        plain = (sums_of(letters(raw)[1], sizes) == sizes) & (sizes > 0) & (self.closes is not None)
        n = int(plain.sum())
        ends = np.cumsum(sizes[plain] + 1)
        spaced = np.full(int(ends[-1]) if n else 0, 32, np.uint8)
        inside = np.ones(len(spaced), bool)
        inside[ends - 1] = False
        spaced[inside] = gather(raw, starts[plain], sizes[plain])
        cuts = [0, *ends[WORDS_PER_CALL - 1 : -1 : WORDS_PER_CALL].tolist(), len(spaced)] if n else []
        joined = [spaced[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])]
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, self.kind), *(np.array(e.ids, self.kind) for e in found)])
        closing = np.flatnonzero(self.closes[flat]) + 1 if n else np.zeros(0, np.int64)
        if len(closing) != n:
            raise ValueError("the vocabulary doesn't close each word")
        whole = raw.tobytes()
        others = [whole[a : a + k].decode() for a, k in zip(starts[~plain].tolist(), sizes[~plain].tolist())]
        rest = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        lengths = np.zeros(len(sizes), np.int64)
        lengths[plain] = np.diff(closing, prepend=0)
        lengths[~plain] = [len(x) for x in rest]
        places = np.zeros(len(sizes), np.int64)
        places[plain] = closing - lengths[plain]
        places[~plain] = len(flat) + np.cumsum(lengths[~plain]) - lengths[~plain]
        return gather(np.concatenate([flat, *rest]), places, lengths), lengths

    def split(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in small letters and the signs behind them apart, since each repeats in many chunks.

        A chunk of Latin letters and closing signs, neither digits nor the straight apostrophe among
        them, is those two pieces to any normaliser; every other chunk stays whole.
        """
        sizes = sizes.astype(np.int64)
        ends = np.cumsum(sizes)
        letter, _ = letters(raw)
        sign = (raw >= 33) & (raw <= 126) & (raw != 39) & ~((raw >= 48) & (raw <= 57)) & ~letter
        other = np.concatenate([np.flatnonzero(~letter), [len(raw)]])
        word = np.minimum(other[np.searchsorted(other, ends - sizes)], ends) - (ends - sizes)
        simple = (word > 0) & (sums_of(sign, sizes) == sizes - word)
        capital = np.repeat(simple, sizes) & letter
        capital &= (raw >= 65) & (raw <= 90) | (raw >= 0x80) & (raw <= 0x9E)
        first = np.where(simple, word, sizes)
        parts = np.stack([first, sizes - first], axis=1).ravel()
        flat, lengths = self.parts.values_at(raw + capital.astype(np.uint8) * np.uint8(32), np.cumsum(parts) - parts, parts)
        return flat, lengths.reshape(-1, 2).sum(axis=1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), and where each text's ids end."""
        data, bounds = flat_bytes(column)
        starts, sizes, upto = chunk_places(data, bounds)
        flat, lengths = self.chunks.values_at(data, starts, sizes)
        return flat, np.concatenate([[0], np.cumsum(lengths)])[upto]


def text_ids(path: str) -> TextIds:
    return remembered(("text ids", path), lambda: TextIds(path))


def with_ends(flat: np.ndarray, ends: np.ndarray, end_id: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` behind each text's."""
    return np.insert(flat.astype(kind), ends, end_id), ends + np.arange(1, len(ends) + 1)


def compress(ids: np.ndarray, last: np.ndarray, base: int, min_count: int = MIN_COUNT):
    """Re-Pair of one block: what is left of ``ids``, the end marks of documents in it, rules, spans.

    A round replaces up to ``PAIRS_A_ROUND`` pairs at once, the most frequent first; the others have a
    later round. A symbol is either left or right in the pairs of one round, so that no two
    replacements overlap; a pair of equal symbols has its symbol to itself and replaces every other
    position of a run. It ends when no pair occurs ``min_count`` times.

    The count of a pair only falls once its symbols exist. So a round counts only positions whose pair
    was frequent in the round before or has a new symbol; the sequence is a chain in which replaced
    symbols are passed over, and is gathered at the end.
    """
    n = len(ids)
    seq, last = ids.astype(np.int64), last.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    stays = np.ones(n, bool)
    size = 1 << 12
    known = np.ones(base + size, np.int64)
    lefts, rights = [], []
    following = base
    spots = np.flatnonzero(~last[:-1])  # where a frequent pair may begin
    while len(spots):
        keys = (seq[spots] << 32) | seq[after[spots]]
        # Slots of a hash hold at least a pair's count: most rare pairs go before the sort.
        slots = max(12, len(keys).bit_length())
        slot = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * following)) >> np.uint64(64 - slots)
        frequent = np.bincount(slot.view(np.int64), minlength=1 << slots)[slot] >= min_count
        spots, keys = spots[frequent], keys[frequent]
        if not len(keys):
            break
        sorted_keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        counts = np.diff(at, append=len(sorted_keys))
        often = counts >= min_count
        pairs, counts = sorted_keys[at[often]], counts[often]
        if not len(pairs):
            break
        order = np.argsort(-counts, kind="stable")[:PAIRS_A_ROUND]
        taken = bytearray(following)  # 0 free, 1 left, 2 right, 3 paired with itself
        chosen = []
        for pair, a, b in zip(pairs[order].tolist(), (pairs[order] >> 32).tolist(), (pairs[order] & 0xFFFFFFFF).tolist()):
            if a == b:
                if not taken[a]:
                    taken[a] = 3
                    chosen.append(pair)
            elif taken[a] < 2 and not taken[b] & 1:
                taken[a], taken[b] = 1, 2
                chosen.append(pair)
        chosen = np.sort(np.array(chosen, np.int64))
        side = np.frombuffer(taken, np.uint8)
        left, right = side[keys >> 32], side[keys & 0xFFFFFFFF]
        maybe = np.flatnonzero((left == 1) & (right == 2) | (left == 3) & (keys >> 32 == keys & 0xFFFFFFFF))
        rule = np.minimum(np.searchsorted(chosen, keys[maybe]), len(chosen) - 1)
        hit = chosen[rule] == keys[maybe]
        found, rule = spots[maybe[hit]], rule[hit]
        index = np.arange(len(found))
        run_start = np.maximum.accumulate(np.where(np.concatenate([[True], after[found[:-1]] != found[1:]]), index, 0))
        odd = (index - run_start) % 2 == 0
        found, rule = found[odd], rule[odd]
        lefts.append(chosen >> 32)
        rights.append(chosen & 0xFFFFFFFF)
        while len(known) < following + len(chosen):
            known = np.concatenate([known, np.ones_like(known)])
        known[following : following + len(chosen)] = known[lefts[-1]] + known[rights[-1]]
        gone = after[found]
        seq[found] = following + rule
        last[found] = last[gone]
        after[found] = after[gone]
        inside = after[found] < n
        before[after[found[inside]]] = found[inside]
        stays[gone] = False
        following += len(chosen)
        ahead = before[found]
        # The old ones, a new symbol's among them, and those before a new symbol.
        marked = np.zeros(n, bool)
        marked[spots] = True
        marked[ahead[ahead >= 0]] = True
        spots = np.flatnonzero(marked)
        spots = spots[stays[spots] & ~last[spots]]
    empty = np.zeros(0, np.int64)
    rules = np.stack([np.concatenate([empty, *lefts]), np.concatenate([empty, *rights])], axis=1)
    return seq[stays].astype(np.uint32), last[stays], rules.astype(np.uint32), known[base:following].astype(np.uint32)


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for. The rules are written out level by level, then copied."""
    total = int(spans.astype(np.int64).sum())
    out = np.arange(base, base + len(rules), dtype=np.int64)
    pairs = rules.astype(np.int64)
    while len(out) < total:
        double = out >= base
        starts = np.cumsum(1 + double) - (1 + double)
        longer = np.empty(len(out) + int(double.sum()), np.int64)
        longer[starts] = out
        longer[starts[double]] = pairs[out[double] - base, 0]
        longer[starts[double] + 1] = pairs[out[double] - base, 1]
        out = longer
    written = np.concatenate([np.arange(base), out]).astype(np.uint32)
    known = np.concatenate([np.ones(base, np.int64), spans.astype(np.int64)])
    return gather(written, (np.cumsum(known) - known)[symbols], known[symbols])


def expand_span(symbols: np.ndarray, base: int, rules: np.ndarray, spans: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a sequence of symbols; only the symbols over them are expanded."""
    known = np.concatenate([np.ones(base, np.int64), spans.astype(np.int64)])
    ends = np.cumsum(known[symbols])
    first, beyond = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
    before = int(ends[first - 1]) if first else 0
    return expand(symbols[first:beyond], base, rules, spans)[start - before : stop - before]


def number_of_parts(df: DataFrame, part_bytes: int) -> int:
    """Parts of ``part_bytes`` of text. Of very large tables both the number and the size of parts grow."""
    size = df.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    return max(1, -(-size // max(part_bytes, GROWTH * math.isqrt(size))))


def write(df: DataFrame, path: str, folder: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", block_ids: int = BLOCK_IDS, part_bytes: int = PART_BYTES) -> None:
    """Write the ids of all texts to ``folder`` in ascending id order.

    Texts are dealt out by ranges of their ids, of any type that has an order, null ids first; rows of one
    id are in the order of their text's hash, so also a null or repeated id is dealt over many tasks.
    Each task encodes its texts in that order and compresses them in blocks of about ``block_ids`` ids,
    which bounds memory whatever a part holds; a longer document is a block of its own. Null texts count
    as empty. An empty table gives an empty folder of files.
    """
    small_batches(df.sparkSession)
    ready = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    parts = number_of_parts(ready, part_bytes)
    base = max(text_ids(path).size, end_id + 1)
    ids_kind = np.uint32 if base > 1 << 16 else np.uint16
    kind = ready.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FILE_SCHEMA.split(", ")]
        held_ids: list = []
        held: list[np.ndarray] = []
        state = {"ids": 0, "part": None, "block": 0, "start": 0}

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held)
            ends = np.cumsum([len(x) for x in held])
            last = np.zeros(len(ids), bool)
            last[ends - 1] = True
            symbols, marks, rules, spans = compress(ids, last, base)
            row = [state["part"], state["block"], state["start"], len(ids), base, list(held_ids), ends.astype(np.uint32).tobytes(), (np.flatnonzero(marks) + 1).astype(np.uint32).tobytes(), rules.tobytes(), spans.tobytes(), symbols.tobytes()]
            state.update(block=state["block"] + 1, start=state["start"] + len(ids), ids=0)
            held.clear()
            held_ids.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(id_type), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        kept = text_ids(path)
        for batch in pieces(batches):
            id_type = batch.schema.field("doc_id").type
            flat, ends = with_ends(*kept.encode(batch.column("text")), end_id, ids_kind)
            for part, doc_id, start, stop in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                if held and (state["ids"] + stop - start > block_ids or part != state["part"]):
                    yield block()
                if part != state["part"]:
                    state.update(part=part, block=0, start=0)
                held.append(flat[start:stop])
                held_ids.append(doc_id)
                state["ids"] += stop - start
        if held:
            yield block()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    # Rows equal in both are one text repeated; a number of their own lets the ranges part them too.
    dealt = ready.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(parts, *order, F.col("own"))
    placed = dealt.sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    placed.mapInArrow(run, FILE_SCHEMA.format(kind=kind)).write.mode("overwrite").parquet(folder)


def part_starts(files: DataFrame) -> DataFrame:
    """Where each part starts in the whole; reads two columns and gives a row for each part."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def read(spark: SparkSession, folder: str, doc_ids: Sequence | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the documents in the files of ``folder``.

    ``start`` counts the ids of all documents before; ``ids`` is binary, unsigned 32-bit,
    little-endian. With ``doc_ids``, only blocks that hold one of them are opened, and of those only
    the wanted documents are expanded.
    """
    small_batches(spark)
    files = spark.read.parquet(folder)
    starts = part_starts(files)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        files = files.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(x) for x in wanted])) if wanted else F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends, symbol_ends, spans, symbols = (np.frombuffer(row[c], np.uint32).astype(np.int64) for c in ("doc_ends", "symbol_ends", "spans", "symbols"))
                rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
                starts = np.concatenate([[0], ends[:-1]])
                docs = np.arange(len(ends))
                if wanted is None:
                    ids = expand(symbols, row["base"], rules, spans)
                else:
                    docs = np.array([i for i, d in enumerate(row["doc_ids"]) if d in wanted], np.int64)
                    ids = np.concatenate([np.zeros(0, np.uint32), *(expand_span(symbols, row["base"], rules, spans, int(starts[i]), int(ends[i])) for i in docs)])
                n = (ends - starts)[docs]
                doc_type = batch.schema.field("doc_ids").type.value_type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), row["part"], np.int32)), pa.array([row["doc_ids"][i] for i in docs], doc_type), pa.array(starts[docs] + row["start_in_part"]), pa.array(n), binaries(ids, np.cumsum(n))],
                    names=["part", "doc_id", "start", "n_tokens", "ids"],
                )

    rows = files.drop("n_tokens").mapInArrow(run, f"part int, doc_id {kind}, start bigint, n_tokens bigint, ids binary")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def file_folder(spark: SparkSession) -> str:
    return scratch(spark, "token-files")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
