"""SimHash fingerprints, their self-join by a binary trie, and the groups that the links make.

Two fingerprints of 64 bits that differ in at most four agree in one of five blocks of bits. For each
block the bits are rotated so that it comes first; equal first blocks are the top of a binary trie,
below which pairs of nodes are walked together with the number of bits they differ in so far.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from widecast.llm.common import fresh, pieces, small_batches, stored, texts_of

BITS = 64
SHINGLE = 4
SEED = 42
BUDGET = 4
BUCKET = 1 << 18
FRONTIER = 200_000
DIRECT = 256


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the text's word shingles in order; a shorter text is one, and none is without words."""
    # Bytes know no letters but A-Z and no white space but the six ASCII signs.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    slices = map(joined.__getitem__, map(slice, starts, ends[shingle - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(seed)), np.uint64, len(starts))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits that are set in over half of the hashes of the text's word shingles; 0 without words."""
    hashes = shingle_hashes(text, shingle, seed)
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(octets) < 64:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        bit = (np.arange(256)[:, None] >> np.arange(8)) & 1
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ bit for k in range(8)])
    return int(np.packbits(2 * ones > len(octets), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text as a signed long; null counts as empty."""
    small_batches(docs.sparkSession)
    ready = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return ready.mapInArrow(run, f"doc_id {ready.schema['doc_id'].dataType.simpleString()}, fp bigint")


def block_starts(budget: int) -> list[int]:
    """First bit of each of ``budget`` + 1 blocks, and the end."""
    return [BITS * k // (budget + 1) for k in range(budget + 2)]


def rotated(values: np.ndarray, by: int) -> np.ndarray:
    """Bit ``by`` (counted from the highest) becomes the first."""
    return values if by == 0 else (values << np.uint64(by)) | (values >> np.uint64(BITS - by))


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of ``i`` and ``j``; a set's label is its smallest member."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def trie_links(values: np.ndarray, first: np.ndarray, beyond: np.ndarray, depth: int, budget: int, cross: tuple | None = None) -> np.ndarray:
    """Labels of sets of linked values, by walking pairs of trie nodes.

    ``values`` are sorted inside each range ``first:beyond``, whose members agree in ``depth`` bits. A
    node is a range at some depth; a pair carries the bits it differs in so far and is dropped beyond
    ``budget``, or when both nodes lie wholly in one set already. Small pairs are compared directly.
    ``cross`` gives pairs of different ranges (second first, second beyond, differing bits) to walk
    instead of each range with itself. The frontier is worked off in bounded pieces, depth first.
    """
    n = len(values)
    label = np.arange(n)
    ones: dict[int, np.ndarray] = {}
    start = (first, beyond, *(cross if cross else (first, beyond, np.zeros(len(first), np.int64))))
    stack = [(depth, *start)]
    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack.append((depth, *(x[half:] for x in (al, ah, bl, bh, diff))))
            stack.append((depth, *(x[:half] for x in (al, ah, bl, bh, diff))))
            continue
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        whole = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (label[al] == label[bl])
        al, ah, bl, bh, diff = (x[~whole] for x in (al, ah, bl, bh, diff))
        size = (ah - al) * (bh - bl)
        small = (size <= DIRECT) | (depth >= BITS)
        while small.any():
            # So many pairs at a time that memory stays bounded.
            upto = np.cumsum(np.where(small, size, 0))
            now = small & (upto <= max(8 * FRONTIER, int(upto[np.argmax(small)])))
            count, width = size[now], (bh - bl)[now]
            owner = np.repeat(np.arange(int(now.sum())), count)
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            i, j = al[now][owner] + nth // width[owner], bl[now][owner] + nth % width[owner]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            unite(label, i[near], j[near])
            small &= ~now
            size = np.where(now, 0, size)
        large = ((ah - al) * (bh - bl) > DIRECT) & (depth < BITS)
        if not large.any():
            continue
        al, ah, bl, bh, diff = (x[large] for x in (al, ah, bl, bh, diff))
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        upto = ones[depth]
        am, bm = ah - (upto[ah] - upto[al]), bh - (upto[bh] - upto[bl])
        same = (al == bl) & (ah == bh)
        apart = ~same
        children = [
            (al, am, bl, bm, diff),
            (am, ah, bm, bh, diff),
            (al, am, bm, bh, diff + 1),
            tuple(x[apart] for x in (am, ah, bl, bm, diff + 1)),
        ]
        joined = [np.concatenate(x) for x in zip(*children)]
        live = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= budget)
        stack.append((depth + 1, *(x[live] for x in joined)))
    return label


def chained(values: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link from each member of a set to the set's first."""
    other = np.flatnonzero(label != np.arange(len(label)))
    return values[label[other]], values[other]


def links(distinct: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links of distinct fingerprints ``fp`` that connect all which differ in at most ``budget`` bits.

    Every fingerprint goes to one bucket for each block. A bucket of over ``bucket`` members is cut
    into nodes further down its trie; each pair of nodes within the budget is then a group of its own,
    so no task gets more than about two nodes' members. Linked pairs are joined into sets inside the
    task, and a set of m gives m - 1 links: dense groups don't give all their pairs.
    """
    spark = distinct.sparkSession
    edges = block_starts(budget)
    bits = [b - a for a, b in zip(edges, edges[1:])]
    turned = F.posexplode(F.array(*[_rotated_column("fp", e) for e in edges[:-1]])).alias("block", "turned")
    keyed = distinct.select("fp", turned).withColumn("top", _top("turned", "block", bits))
    # At most 2^13 buckets for each block, whatever the size of the table.
    large = [(r["block"], r["top"], r["n"]) for r in keyed.groupBy("block", "top").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).collect()]
    if large:
        rows = [(b, t, math.ceil(math.log2(n / bucket)) + 1) for b, t, n in large]
        depths = spark.createDataFrame(rows, "block int, top bigint, more int")
        keyed = keyed.join(F.broadcast(depths), ["block", "top"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
        most = max(m for _, _, m in rows)
        masks = [sum(1 << i for i in c) for k in range(budget + 1) for c in combinations(range(most), k)]
        table = F.array(*[F.lit(m).cast("bigint") for m in masks])
        node = F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("turned"), F.element_at(F.array(*[F.lit(b) for b in bits]), F.col("block") + 1)), F.lit(BITS) - F.col("more"))
        keyed = keyed.withColumn("node", F.when(F.col("more") > 0, node).otherwise(F.lit(0).cast("bigint")))
        keyed = keyed.withColumn("mask", F.explode(F.filter(table, lambda m: m < F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("more")))))
        other = F.col("node").bitwiseXOR(F.col("mask"))
        keyed = keyed.withColumns({"low": F.least("node", other), "high": F.greatest("node", other)})
    else:
        keyed = keyed.withColumns({"more": F.lit(0), "node": F.lit(0).cast("bigint"), "low": F.lit(0).cast("bigint"), "high": F.lit(0).cast("bigint")})
    ready = keyed.select("block", "top", "low", "high", "more", "turned")
    grouped = ready.repartition("block", "top", "low", "high").sortWithinPartitions("block", "top", "low", "high", "turned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        names = ["block", "top", "low", "high", "more", "turned"]

        def solved(columns: list[np.ndarray]) -> pa.RecordBatch:
            block, top, low, high, more, turned = columns
            # Signed order puts values with the highest bit first; the trie wants unsigned order.
            values = turned.view(np.uint64)
            order = np.lexsort((values, high, low, top, block))
            block, top, low, high, more, values = (x[order] for x in (block, top, low, high, more, values))
            new = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(top) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)]))
            beyond = np.append(new[1:], len(values))
            self_pair = low[new] == high[new]
            label = trie_links(values, new[self_pair], beyond[self_pair], 0, budget)
            crossed = np.flatnonzero(~self_pair)
            if len(crossed):
                # Below the top the two nodes of a pair stand one after the other.
                width = np.array(bits)[block[new[crossed]]]
                cut = []
                for k, w in zip(crossed, width):
                    a, b, m = new[k], beyond[k], int(more[new[k]])
                    node = (values[a:b] << np.uint64(w)) >> np.uint64(BITS - m)
                    cut.append(a + int(np.searchsorted(node, high[new[k]])))
                cut = np.array(cut)
                both = (cut > new[crossed]) & (cut < beyond[crossed])
                k = crossed[both]
                second = trie_links(values, new[k], cut[both], 0, budget, (cut[both], beyond[k], np.zeros(len(k), np.int64)))
                unite(label, np.arange(len(label)), second)
            turn = np.array(edges[:-1])[block]
            back = values.copy()
            for e in edges[1:-1]:
                mine = turn == e
                back[mine] = rotated(values[mine], BITS - e)
            a, b = chained(back, label)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            rest = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns)]
            if len(rest[0]) >= bucket // 4:
                key = [x[-1] for x in rest[:4]]
                open_ = np.logical_and.reduce([x == k for x, k in zip(rest[:4], key)])
                split = int(np.argmax(open_))  # the last group may go on in the next batch
                if split:
                    yield solved([x[:split] for x in rest])
                    rest = [x[split:] for x in rest]
        if rest is not None and len(rest[0]):
            yield solved(rest)

    return grouped.mapInArrow(run, "a bigint, b bigint")


def _rotated_column(column: str, by: int):
    c = F.col(column)
    return c if by == 0 else F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, BITS - by))


def _top(turned: str, block: str, bits: list[int]):
    out = F.shiftrightunsigned(turned, BITS - bits[0])
    for k, b in enumerate(bits[1:], 1):
        out = F.when(F.col(block) == k, F.shiftrightunsigned(turned, BITS - b)).otherwise(out)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``v, root``: for every end of a link ``a, b`` the smallest value of its connected set.

    Rounds: every set points to the smallest set it is linked to, pointers are followed to their ends,
    and links are rewritten between the new sets. Each round at least halves the sets that still have
    links. Tables are written to the shared folder, which ends their lineage.
    """
    both = stored(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    found = None
    while not both.isEmpty():
        point = stored(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "pointers")
        while True:
            ends = point.select(F.col("a").alias("p"), F.col("p").alias("q"))
            point = stored(point.join(ends, "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "pointers")
            if point.filter("moved").isEmpty():
                break
            point = point.drop("moved")
        point = point.select("a", "p")
        moved = point.select(F.col("a").alias("root"), F.col("p").alias("next"))
        found = stored(point.select(F.col("a").alias("v"), F.col("p").alias("root")) if found is None else found.join(moved, "root", "left").select("v", F.coalesce("next", "root").alias("root")), "sets")
        left = both.join(point, "a").select(F.col("p").alias("x"), F.col("b").alias("a"))
        both = stored(left.join(point, "a").select(F.col("x").alias("a"), F.col("p").alias("b")).filter("a <> b").distinct(), "links")
    return found if found is not None else both.select(F.col("a").alias("v"), F.col("b").alias("root"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """``doc_id, fp, component_id``: fingerprint of every row and the smallest id its links reach.

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other.
    Equal fingerprints are one node of the join, so copies cost nothing; each repeated row has its row.
    A null id is no group's name unless the group has no other (then the name is null).
    """
    rows = stored(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    sets = components(links(nodes.select("fp"), budget))
    member = nodes.join(sets.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = stored(member, "members")
    names = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = member.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which no group has more than one: its smallest id.

    Of repeated rows with that id and text one stays, of several texts with that id in the group one text;
    rows of one id in different groups all stay. Rows with a null id all stay, since nothing names them.
    """
    own, named = fresh(docs, "text_hash"), F.col(doc_id).isNotNull()
    hashed = docs.withColumn(own, F.xxhash64(F.col(text).cast("string")))
    rows = hashed.select(F.when(named, F.struct(F.col(doc_id).alias("id"), F.col(own).alias("text_hash"))).alias("doc_id"), F.col(text).alias("text"))
    kept = groups(rows, budget=budget).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.id").alias(doc_id), F.col("doc_id.text_hash").alias(own)).distinct()
    one = hashed.filter(named).join(kept, [doc_id, own], "left_semi").dropDuplicates([doc_id, own]).select(docs.columns)
    return one.unionAll(docs.filter(~named))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
