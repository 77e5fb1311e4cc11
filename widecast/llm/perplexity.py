"""Quality rules with n-gram perplexity: an interpolated modified Kneser-Ney model for each language.

The model's symbols are the bytes of the text, A-Z as a-z, white space as one blank, with a boundary sign
before and after; so it has no vocabulary to cap and suits every script. Spark counts all n-grams of all
texts, derives the continuation counts, discounts and back-off weights by grouping, windows and joins, and
so gives each n-gram of the highest order its cost in bits. Tasks look costs up in arrays sorted by hash.
The arrays hold the most frequent n-grams up to a fixed number; what is left is joined by Spark.

A text's entropy is its mean cost per byte, the logarithm of its perplexity. Each language has a band of
entropies by the quartiles of its texts; those outside are rejected.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from widecast.llm.common import gather, pieces, remembered, small_batches, stored, texts_of

ORDER = 5
BOUNDARY = b"\n"
SYMBOLS = 257
HEAD_GRAMS = 2_000_000
MERGE_GRAMS = 4_000_000
EMIT_ROWS = 100_000
FEW_LANGUAGES = 10_000
#: The band reaches so many interquartile ranges beyond the quartiles, of at least so many bits each.
BAND_REACH = 4.0
LEAST_RANGE = 0.02
LEAST_TEXTS = 30
LEAST_WORDS = 50
MOST_REPEATED = 50  # in a hundred words
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# White space between words, signs that count as symbols.
BLANKS = bytes([32, *range(9, 14)])
SIGNS = b"#*$%&|<>"
INSIDE = bytes(range(0x80, 0xC0))
MISSING_DISCOUNTS = (0.5, 1.0, 1.5)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) ** 3 >= 1 << 62:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(numbers) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    at = np.concatenate([order[1:][same], order[:-1][same]])
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[at + k] = True
    return int(marked.sum())


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """The values of ``BASE``."""
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    return len(words), len(raw.translate(None, BLANKS + INSIDE)), len(raw) - len(raw.translate(None, SIGNS)), len(lines) - len(set(lines)), repeated_words(words)


def gram_keys(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the highest order, eight bits a symbol, and how many each text has."""
    before = BOUNDARY * (ORDER - 1)
    flat = np.frombuffer(b"".join(before + x + BOUNDARY for x in bodies), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    keys = np.zeros(len(flat) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        keys <<= np.uint64(8)
        keys |= flat[k : k + len(keys)]
    ends = np.cumsum(sizes + ORDER)
    return gather(keys, ends - sizes - ORDER, sizes + 1), sizes + 1


def body(words: list[bytes]) -> bytes:
    return b" ".join(words).lower()


def runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(at, append=len(keys)) if counts is None else np.add.reduceat(counts, at)


def prepared(docs: DataFrame, text: str, language: str | None, *more: Column) -> DataFrame:
    of = F.coalesce(F.col(language).cast("string"), F.lit("")) if language else F.lit("")
    return docs.select(F.col(text).cast("string").alias("text"), of.alias("language"), *more)


def count_grams(docs: DataFrame, text: str = "text", language: str | None = "lang") -> DataFrame:
    """``language, gram, n``: n-grams of the highest order of all texts, summed in each task, then shuffled."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return runs(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

        for batch in pieces(batches):
            keys, sizes = gram_keys([body(t.encode().split()) for t in texts_of(batch)])
            of = np.array([places.setdefault(x, len(places)) for x in batch.column("language").to_pylist()], np.uint64)
            held.append(runs(keys | np.repeat(of << np.uint64(8 * ORDER), sizes)))
            n += len(held[-1][0])
            if n > MERGE_GRAMS:
                held = [merged()]
                n = 0
        if held:
            keys, counts = merged()
            names = np.array(list(places), object)
            for i in range(0, len(keys), EMIT_ROWS):
                part = keys[i : i + EMIT_ROWS]
                of = pa.array(names[(part >> np.uint64(8 * ORDER)).astype(np.int64)], pa.string())
                yield pa.RecordBatch.from_arrays([of, pa.array((part & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64)), pa.array(counts[i : i + EMIT_ROWS])], names=["language", "gram", "n"])

    found = prepared(docs, text, language).mapInArrow(run, "language string, gram bigint, n bigint")
    return found.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def few(df: DataFrame) -> DataFrame:
    """A table with a row for each language, broadcast if there are few, as there should be."""
    return F.broadcast(df) if df.count() <= FEW_LANGUAGES else df


def discounts(counted: DataFrame) -> DataFrame:
    """``language, d1, d2, d3``: what is taken off n-grams counted once, twice and more often."""
    number = lambda k: F.count(F.when(F.col("n") == k, 1)).cast("double").alias(f"n{k}")
    of = counted.groupBy("language").agg(*(number(k) for k in (1, 2, 3, 4)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    own = [k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")) for k in (1, 2, 3)]
    # Tables too small for an estimate give none, or one out of its range.
    return of.select("language", *(F.when(known & (d >= 0) & (d <= k), d).otherwise(fixed).alias(f"d{k}") for k, (d, fixed) in enumerate(zip(own, MISSING_DISCOUNTS), 1)))


def discounted(counted: DataFrame) -> DataFrame:
    """``language, gram, n, own, rest``: the discounted share of each n-gram in its context, and what the context's discounts leave to lower orders.

    Windows go over the n-grams of one context, of which there are at most as many as symbols.
    """
    n = F.col("n").cast("double")
    context = Window.partitionBy("language", F.shiftright("gram", 8))
    often = lambda cond: F.sum(F.when(cond, 1.0).otherwise(0.0)).over(context)
    d1, d2, d3 = F.col("d1"), F.col("d2"), F.col("d3")
    taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    left = d1 * often(F.col("n") == 1) + d2 * often(F.col("n") == 2) + d3 * often(F.col("n") > 2)
    total = F.sum(n).over(context)
    known = counted.join(few(stored(discounts(counted), "ngram-discounts")), "language")
    return known.select("language", "gram", "n", ((n - taken) / total).alias("own"), (left / total).alias("rest"))


def suffix(order: int) -> Column:
    """The key without its first symbol, of n-grams of ``order``."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))


def model(docs: DataFrame, text: str = "text", language: str | None = "lang") -> DataFrame:
    """``language, gram, n, bits``: the cost of every n-gram of the highest order in the texts.

    Counts of the highest order are of occurrences; lower ones count the different symbols before.
    """
    counted = {ORDER: stored(count_grams(docs, text, language), f"ngrams-{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        above = counted[order + 1].select("language", suffix(order + 1).alias("gram"))
        counted[order] = stored(above.groupBy("language", "gram").agg(F.count("*").alias("n")), f"ngrams-{order}")
    found = discounted(counted[1]).select("language", "gram", "n", (F.col("own") + F.col("rest") / SYMBOLS).alias("p"))
    for order in range(2, ORDER + 1):
        # Each lower n-gram meets at most as many upper ones as there are symbols.
        lower = found.select("language", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        upper = discounted(counted[order]).withColumn("suffix", suffix(order))
        found = upper.join(lower, ["language", "suffix"]).select("language", "gram", "n", (F.col("own") + F.col("rest") * F.col("lower")).alias("p"))
    return stored(found.select("language", "gram", "n", (-F.log2("p")).alias("bits")), "ngram-model")


def language_hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def mixed(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams of languages."""
    h = (keys + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ of
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Costs:
    """Costs in an array sorted by hash, found by the hash's first bits and a few steps on."""

    def __init__(self, hashes: np.ndarray, bits: np.ndarray) -> None:
        self.hashes = np.concatenate([hashes, [np.uint64(2**64 - 1)]])
        self.bits = np.concatenate([bits, np.zeros(1, np.float32)])
        self.shift = np.uint64(64 - max(1, len(hashes).bit_length()))
        heads = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.starts = np.searchsorted(hashes, heads)
        self.n = len(hashes)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The costs, and which of them are known."""
        at = self.starts[(wanted >> self.shift).astype(np.int64)]
        live = np.flatnonzero(self.hashes[at] < wanted)
        while len(live):
            at[live] += 1
            live = live[self.hashes[at[live]] < wanted[live]]
        return self.bits[at], (self.hashes[at] == wanted) & (at < self.n)


def head(costs: DataFrame, most: int) -> tuple[DataFrame, Column, bool]:
    """The most frequent n-grams, ``most`` at the most, by a condition on ``n``; whether these are all."""
    grade = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["grade"], r["k"]) for r in costs.groupBy(grade.alias("grade")).agg(F.count("*").alias("k")).collect()), reverse=True)
    taken, least = 0, None
    for g, k in sizes:
        if taken + k > most:
            break
        taken, least = taken + k, g
    chosen = F.lit(False) if least is None else grade >= least
    return costs.filter(chosen), chosen, taken == sum(k for _, k in sizes)


def entropies(docs: DataFrame, costs: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str | None = "lang", head_grams: int = HEAD_GRAMS) -> DataFrame:
    """``doc_id, language, row, text_hash``, the values of ``BASE`` and ``entropy`` of every row.

    ``costs`` must be the model of these texts, so it has all their n-grams. The most frequent ones go to
    all tasks as arrays of at most ``head_grams`` entries; others leave the task by text and n-gram, each
    once, and are joined. Those are rare by definition, so the join has no hot key.
    """
    spark = docs.sparkSession
    small_batches(spark)
    top, chosen, complete = head(costs, head_grams)
    rows = top.select("language", "gram", "bits").toArrow()
    names = rows.column("language").combine_chunks().dictionary_encode()
    known = np.array([language_hash(x) for x in names.dictionary.to_pylist()], np.uint64)
    of = known[names.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
    hashes = mixed(rows.column("gram").to_numpy().astype(np.uint64), of)
    order = np.argsort(hashes)
    sent = spark.sparkContext.broadcast((hashes[order], rows.column("bits").to_numpy().astype(np.float32)[order]))
    mark = uuid.uuid4().hex
    ready = prepared(docs, text, language, F.col(doc_id).alias("doc_id")).withColumn("text_hash", F.xxhash64("text"))
    names = ["doc_id", "language", "text_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        kept = remembered(("costs",), dict)
        if mark not in kept:
            kept.clear()
            kept[mark] = Costs(*sent.value)
        costs = kept[mark]
        for batch in pieces(batches):
            raws = [t.encode() for t in texts_of(batch)]
            words = [x.split() for x in raws]
            base = np.array([base_counts(x, w) for x, w in zip(raws, words)], np.int64).reshape(-1, len(BASE))
            keys, sizes = gram_keys([body(w) for w in words])
            of = np.array([language_hash(x) for x in batch.column("language").to_pylist()], np.uint64)
            bits, there = costs.find(mixed(keys, np.repeat(of, sizes)))
            text_of = np.repeat(np.arange(len(batch)), sizes)
            sums = np.bincount(text_of, np.where(there, bits, 0).astype(np.float64), minlength=len(batch))
            rest = [None] * len(batch)
            lost = np.flatnonzero(~there)
            if len(lost):
                for i, some in by_text(text_of[lost], keys[lost]):
                    rest[i] = some
            columns = [
                *(batch.column(c) for c in names), pa.array(row + np.arange(len(batch))), *(pa.array(base[:, k]) for k in range(len(BASE))),
                pa.array(sums), pa.array(sizes), pa.array(rest, pa.list_(pa.struct([("gram", pa.int64()), ("times", pa.int64())]))),
            ]
            row += len(batch)
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "row", *BASE, "bits", "symbols", "rest"])

    kind = ready.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, language string, text_hash bigint, row bigint, {', '.join(c + ' bigint' for c in BASE)}, bits double, symbols bigint, rest array<struct<gram:bigint,times:bigint>>"
    found = stored(ready.mapInArrow(run, schema), "costs-of-texts")
    if not complete:
        rare = costs.filter(~chosen).select("language", "gram", F.col("bits").alias("cost"))
        wanted = found.select("row", "language", F.explode("rest").alias("rest")).select("row", "language", "rest.gram", "rest.times")
        more = wanted.join(rare, ["language", "gram"]).groupBy("row").agg(F.sum(F.col("cost") * F.col("times")).alias("more"))
        found = found.join(more, "row", "left").withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0.0)))
    return found.select("doc_id", "language", "row", "text_hash", *BASE, (F.col("bits") / F.col("symbols")).alias("entropy"))


def by_text(texts: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, list[dict]]]:
    """Each text with its different n-grams and their numbers."""
    order = np.lexsort((keys, texts))
    texts, keys = texts[order], keys[order]
    at = np.flatnonzero(np.concatenate([[True], (texts[1:] != texts[:-1]) | (keys[1:] != keys[:-1])]))
    times, texts, keys = np.diff(at, append=len(keys)), texts[at], keys[at].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(texts)]):
        yield int(texts[a]), [{"gram": g, "times": t} for g, t in zip(keys[a:b].tolist(), times[a:b].tolist())]


def base_failed() -> Column:
    """Texts too short to judge, or mostly repetition."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(scored: DataFrame, reach: float = BAND_REACH, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """``language, lower, upper``: the entropies that are kept, from the quartiles of different texts that pass the other rules.

    Copies count once: a text copied into a third of all rows mustn't move its language's band. A
    language of fewer than ``least_texts`` such texts has no band.
    """
    texts = scored.filter(~base_failed()).groupBy("language", "text_hash").agg(F.min("entropy").alias("entropy"))
    quartiles = texts.groupBy("language").agg(F.percentile_approx("entropy", [0.25, 0.75], 10_000).alias("q"), F.count("*").alias("n")).filter(F.col("n") >= least_texts)
    low, high = F.col("q")[0], F.col("q")[1]
    width = reach * F.greatest(high - low, F.lit(LEAST_RANGE))
    return quartiles.select("language", (low - width).alias("lower"), (high + width).alias("upper"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str | None = "lang", reach: float = BAND_REACH, least_texts: int = LEAST_TEXTS, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """``doc_id``, the values of ``BASE``, ``base_failed``, ``kept`` and ``entropy`` of every row.

    A text is kept if it passes the base rules and its entropy lies in its language's band; without a band
    the base rules decide. Null texts are empty texts, which fail the base rules. Null languages are
    one language of their own (as the empty name). Repeated rows are judged alike, ties with a band's
    edge are kept, an empty table gives an empty result, other columns are left out. Texts of any length
    are counted and scored whole.
    """
    costs = model(docs, text, language)
    scored = entropies(docs, costs, doc_id, text, language, head_grams)
    limits = few(stored(bands(scored, reach, least_texts), "bands"))
    inside = F.col("lower").isNull() | F.col("entropy").between(F.col("lower"), F.col("upper"))
    judged = scored.join(limits, "language", "left").withColumn("base_failed", base_failed())
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "entropy")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
