"""Repair of the structure of conversations by weighted interval parsing.

A sound conversation is ``(s?(ua)+)?`` in the initials of its roles. Its repair grammar, in Chomsky
normal form, has one nonterminal for each pair (p, q) of states of that pattern: the span's edits lead
from p to q. A span of one row is kept, given another role or deleted, with insertions closed over on both
sides; a longer span is any two adjacent spans that meet in a state. A cell of the chart holds the least
(cost, audit) of its nonterminal, the audit being the edits' initials in order.

Since nonterminals carry both borders of a span, every split of a span gives the same cells. So the chart
is filled bottom-up by span length with doubling lengths only, two neighbours at a time: a conversation
of n rows takes n - 1 combinations, and a long one is split over tasks, whose spans are joined at the end.
Equal costs with different audits never have one audit at the front of the other (an insertion costs
something), so the least audit of a whole has the least audits of its parts.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from widecast.llm.common import remembered, small_batches, stored

#: States: nothing yet, behind the system row, behind a user row, behind an assistant row.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
INITIALS = "sua"
#: A row's code: its initial (s, u, a, x for others) if sound, the capital if truncated, - if it must go.
GONE = "-"
REMEMBERED_SPANS = 200_000
NO_ROWS_SHA256 = hashlib.sha256(b"").hexdigest()
BLANKS = r"[\x20\x09-\x0D]"
TIE_SIGNS = 100
BATCH_SIZE = 50_000

Cells = dict[tuple[int, int], tuple[int, str]]


def insertions() -> Cells:
    """The cheapest runs of inserted rows between any two states."""
    best: Cells = {(p, p): (0, "") for p in range(4)}
    for p, n in itertools.product(range(4), range(1, 5)):
        for roles in itertools.product("ua", repeat=n):
            state: int | None = p
            for r in roles:
                state = MOVES.get((state, r))
            if state is not None and ((p, state) not in best or best[p, state] > (INSERT * n, "I" * n)):
                best[p, state] = (INSERT * n, "I" * n)
    return best


def joined(left: Cells, right: Cells) -> Cells:
    """Cells of two adjacent spans taken as one."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            more = right.get((r, q))
            if more is not None:
                both = cost + more[0]
                held = out.get((p, q))
                if held is None or both < held[0]:
                    out[p, q] = both, audit + more[1]
                elif both == held[0]:
                    out[p, q] = both, min(held[1], audit + more[1])
    return out


def row_cells(code: str, closure: Cells) -> Cells:
    """Cells of one row, insertions on both sides included."""
    own: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if code != GONE:
        extra = TRUNCATED if code.isupper() else 0
        for (p, c), q in MOVES.items():
            if c == code.lower():
                own[p, q] = min(own.get((p, q), (99, "")), (extra, "K"))
            elif c in NAMES:
                own[p, q] = min(own.get((p, q), (99, "")), (REROLE + extra, "R"))
    return joined(joined(closure, own), closure)


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of about ``BATCH_SIZE`` in total size."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_SIZE:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class Chart:
    """Cells of spans by the codes of their rows; short spans are remembered, as they repeat."""

    def __init__(self) -> None:
        closure = insertions()
        self.rows = {c: row_cells(c, closure) for c in "suaxSUAX-"}
        self.known: dict[str, Cells] = {}

    def cells(self, codes: str) -> Cells:
        """Cells of a span, from the cells of spans of half its length and so on down to rows."""
        spans = [(c, self.rows[c]) for c in codes]
        while len(spans) > 1:
            above = []
            for i in range(0, len(spans) - 1, 2):
                (a, left), (b, right) = spans[i], spans[i + 1]
                both = a + b
                found = self.known.get(both)
                if found is None:
                    found = joined(left, right)
                    if len(both) <= 16:
                        if len(self.known) >= REMEMBERED_SPANS:
                            self.known.clear()
                        self.known[both] = found
                above.append((both, found))
            if len(spans) % 2:
                above.append(spans[-1])
            spans = above
        return spans[0][1]


def chart() -> Chart:
    return remembered(("chart",), Chart)


def joined_all(spans: list[Cells]) -> Cells:
    """Adjacent spans as one, neighbours first, so that long audits are copied few times."""
    while len(spans) > 1:
        spans = [joined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def best(cells: Cells) -> tuple[int, str]:
    return min(cells[0, q] for q in FINAL if (0, q) in cells)


def edits_of(piece: str, place: int, opened: bool) -> Iterator[list[dict]]:
    """For each row of a piece of the audit, the rows that it leaves: edit and new role, None for its own.

    ``place`` counts the rows that come out before; ``opened`` says whether the whole repaired
    conversation has a system row, which is its first.
    """
    for chunk in re.findall(r"I*[KRD](?:I+$)?", piece):
        out = []
        for letter in chunk:
            if letter != "D":
                out.append({"edit": letter, "role": None if letter == "K" else NAMES["ua"[(place - opened) % 2]]})
                place += 1
        yield out


def sound(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns under their own names; null roles and texts are one blank."""
    blank = F.lit(" ")
    return rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), blank).alias("role"), F.coalesce(F.col(text).cast("string"), blank).alias("text")
    )


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``, a number that rises along each conversation, stored.

    Rows are dealt out by ranges of the whole order, not by conversation, so a very long one is split.
    Null turns come first; rows of one turn are ordered by role, the text's first signs and its hash. Rows
    equal in all these are the same row repeated; a number of their own lets the ranges part them too.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, TIE_SIGNS), F.xxhash64("text")]
    own = F.monotonically_increasing_id()
    dealt = rows.withColumn("own", own).repartitionByRange(*order, F.col("own")).sortWithinPartitions(*order)
    return stored(dealt.drop("own").withColumn("at", F.monotonically_increasing_id()), "conversations")


def faults(ordered: DataFrame) -> DataFrame:
    """``conv_id, turn, at, initial, fault, code`` of every row; ``fault`` is its first one or null.

    Duplicates are found by the first row of each (conversation, role, text), joined back by ``at``, which
    is unique: a text that fills a conversation is one group of a partial aggregation, nothing else.
    """
    digest = F.unhex(F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text"), 256))
    light = ordered.select("conv_id", "turn", "at", F.substring("role", 1, 1).alias("initial"), digest.alias("digest"), F.regexp_extract("text", rf"(?s)([^\x20\x09-\x0D]){BLANKS}*\z", 1).alias("last"))
    firsts = light.groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    known = light.join(firsts, "at", "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    plain = F.when(F.col("initial").isin(*INITIALS), F.col("initial")).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain)
    return known.withColumn("fault", fault).select("conv_id", "turn", "at", "initial", "fault", code.alias("code"))


def spans(found: DataFrame) -> DataFrame:
    """One row for each conversation and range: its first row, codes, illegal neighbours, cells."""
    kind = found.schema["conv_id"].dataType.simpleString()
    small_batches(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "initial", "code")))

        def found() -> Iterator[dict]:
            for (conv_id, part), group in itertools.groupby(rows(), key=lambda r: (r[0], r[1] >> 33)):
                held = list(group)
                initials = [r[2] for r in held]
                cells = chart().cells("".join(r[3] for r in held))
                yield {
                    "conv_id": conv_id, "part": part, "at": held[0][1], "n": len(held), "first": initials[0], "last": initials[-1],
                    "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                    "cells": [{"p": p, "q": q, "cost": c, "audit": x} for (p, q), (c, x) in cells.items()],
                }

        yield from in_batches(found(), schema, lambda r: 10 * r["n"])

    cell = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    ids = found.select("conv_id").limit(0).toArrow().schema.field("conv_id").type
    schema = pa.schema([("conv_id", ids), ("part", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("cells", pa.list_(cell))])
    together = found.select("conv_id", "at", "initial", "code").repartition(F.shiftright("at", 33)).sortWithinPartitions("at")
    return together.mapInArrow(run, f"conv_id {kind}, part bigint, at bigint, n bigint, first string, last string, illegal bigint, cells array<struct<p:int,q:int,cost:bigint,audit:string>>")


def parses(parts: DataFrame) -> DataFrame:
    """The cheapest parse of each conversation: one row for each of its ranges.

    ``piece`` is the range's part of the audit; insertions at a border belong to the row behind, at the
    end to the last one. ``place`` counts the rows that come out before. ``cost`` and ``illegal`` are on the
    first range's row, else 0.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    small_batches(parts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for i in range(len(batch)):
                    yield batch.slice(i, 1).to_pylist()[0]

        def found() -> Iterator[dict]:
            for conv_id, group in itertools.groupby(rows(), key=lambda r: r["conv_id"]):
                held, cells = [], []
                for r in group:
                    cells.append({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in r.pop("cells")})
                    held.append(r)
                cost, audit = best(joined_all(cells))
                opened = (len(audit) - audit.count("D")) % 2 == 1
                illegal = sum(r["illegal"] for r in held) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(held, held[1:]))
                row_ends = re.compile("[KRD]")
                start, place = 0, 0
                for k, r in enumerate(held):
                    stop = len(audit) if k == len(held) - 1 else next(itertools.islice(row_ends.finditer(audit, start), r["n"] - 1, None)).end()
                    piece = audit[start:stop]
                    yield {"conv_id": conv_id, "part": r["part"], "at": r["at"], "piece": piece, "place": place, "opened": opened, "cost": 0 if k else cost, "illegal": 0 if k else illegal}
                    place += len(piece) - piece.count("D")
                    start = stop

        yield from in_batches(found(), schema, lambda r: 100 + len(r["piece"]))

    ids = parts.select("conv_id").limit(0).toArrow().schema.field("conv_id").type
    schema = pa.schema([("conv_id", ids), ("part", pa.int64()), ("at", pa.int64()), ("piece", pa.string()), ("place", pa.int64()), ("opened", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64())])
    together = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return together.mapInArrow(run, f"conv_id {kind}, part bigint, at bigint, piece string, place bigint, opened boolean, cost bigint, illegal bigint")


def repaired_rows(ordered: DataFrame, parsed: DataFrame) -> DataFrame:
    """``conv_id, at, k, role, text, edit`` of the rows that the cheapest edits leave, in order of ``at, k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                left = list(edits_of(r["piece"], r["place"], r["opened"]))
                for i in range(0, len(left), 10_000):
                    some = left[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(range(r["at"] + i, r["at"] + i + len(some)), pa.int64()), pa.array(some, kept)], names=["at", "kept"])

    kept = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string())]))
    edits = parsed.select("at", "piece", "place", "opened").mapInArrow(run, "at bigint, kept array<struct<edit:string,role:string>>")
    rows = ordered.join(edits, "at").select("conv_id", "at", "role", "text", F.posexplode("kept").alias("k", "row"))
    return rows.select("conv_id", "at", "k", F.coalesce("row.role", "role").alias("role"), F.when(F.col("row.edit") == "I", "").otherwise(F.col("text")).alias("text"), F.col("row.edit").alias("edit"))


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of the rows ``role:text``, joined by newlines.

    A digest is one chain over a conversation, so one task reads it in order, row by row, and holds none.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()
    small_batches(repaired.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))

        def one() -> Iterator[tuple]:
            for conv_id, group in itertools.groupby(rows(), key=lambda r: r[0]):
                chain, between = hashlib.sha256(), b""
                for _, role, text in group:
                    chain.update(between + role.encode() + b":" + text.encode())
                    between = b"\n"
                yield conv_id, chain.hexdigest()

        found = one()
        while some := list(itertools.islice(found, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], ids), pa.array([d for _, d in some])], names=["conv_id", "repaired_sha256"])

    ids = repaired.select("conv_id").limit(0).toArrow().schema.field("conv_id").type
    together = repaired.select("conv_id", "at", "k", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "at", "k")
    return together.drop("at", "k").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


class Repair:
    """The results for a table of rows: ``report`` by conversation, ``rows`` as repaired.

    Null roles and texts are one blank; null turns come first; rows of a null conversation are one
    conversation; a repeated row is a duplicate of the first; other columns are left out; an empty table
    gives empty results. Texts of any length go through whole, one row at a time.
    """

    def __init__(self, rows: DataFrame, **columns: str) -> None:
        self.ordered = in_order(sound(rows, **columns))
        found = stored(faults(self.ordered), "conversation-faults")
        self.parsed = stored(parses(spans(found)), "conversation-parses")
        self.rows = repaired_rows(self.ordered, self.parsed)
        self.found = found

    @property
    def report(self) -> DataFrame:
        """One row for each conversation: gaps in its turns, faults, illegal neighbours, cost, audit and digest."""
        number = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
        counts = self.found.groupBy("conv_id").agg(gaps, number("blank"), number("duplicate"), number("truncated"))
        pieces = F.array_sort(F.collect_list(F.struct("part", "piece")))
        costs = self.parsed.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("audit"))
        out = same(counts, costs, ["illegal", "cost", "audit"])
        out = same(out, digests(self.rows), ["repaired_sha256"])
        return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(NO_ROWS_SHA256)))


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """``left`` with columns of ``right``'s row of the same conversation, null ids included."""
    b = right.select(F.col("conv_id").alias("other"), *columns)
    return left.join(b, F.col("conv_id").eqNullSafe(F.col("other")), "left").drop("other")


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of ``conv_id:turn``: dropped, emptied, cut signs, repeated, made user's."""
    plain = sound(rows)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    coded = plain.withColumn("code", F.crc32(key.cast("binary")) % 20).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return coded.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
