"""Repair of conversations against plain recomputation, all edits and the whole chart."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from widecast.llm import conversations as V, queries

SF = "/root/testdata/sf0.01"
LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def codes_of(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = LAST.search(text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[1] not in ".!?" else None)
        seen.add((role, text))
    return faults


def cheapest(rows, faults):
    """Least (cost, audit), row by row over the states of the pattern."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(3):
            for (state, (cost, audit)), r in itertools.product(list(best.items()), "ua"):
                to = moves.get((state, r))
                if to is not None and (to not in best or best[to] > (cost + 2, audit + "I")):
                    best[to] = (cost + 2, audit + "I")
        return best

    best = inserted({"": (0, "")})
    for (_, _, role, _), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit) in best.items():
            options = [(state, cost + 3, audit + "D")]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                options += [(moves.get((state, role[:1])), cost + more, audit + "K")]
                options += [(moves.get((state, r)), cost + 2 + more, audit + "R") for r in "ua"]
            for to, c, a in options:
                if to is not None and (to not in after or after[to] > (c, a)):
                    after[to] = (c, a)
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def repaired(rows, audit):
    size = len(audit) - audit.count("D")
    roles = iter(("s" if size % 2 else "") + "ua" * (size // 2))
    left, out = iter(rows), []
    for letter in audit:
        row = next(left) if letter != "I" else None
        if letter != "D":
            r = next(roles)
            assert letter != "K" or row[2][:1] == r
            out.append((row[2] if letter == "K" else {"u": "user", "a": "assistant"}[r]) + ":" + (row[3] if row else ""))
    assert next(left, None) is None
    return "\n".join(out)


def brute(rows, every):
    out = []
    for conv in every:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        turns = {r[1] for r in own} - {None}
        faults = codes_of(own)
        cost, audit = cheapest(own, faults)
        initials = [r[2][:1] for r in own]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(repaired(own, audit).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_registered_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = queries.op12_conversation_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert rows_of(got) == brute(brute_damage(rows), {r[0] for r in rows})


ODD = [
    (1, 0, "system", "You are kind."), (1, 1, "user", "Hi?"), (1, 2, "user", "Hi?"), (1, 3, "assistant", "cut off"), (1, None, "user", "early."), (1, None, None, None),
    (2, None, "tool", " \t "), (2, None, "", "x."), (3, 5, "assistant", "alone!"), (None, 1, "user", "no id."), (None, 9, "assistant", "fine."), (4, 0, "s", ""),
    (5, 0, "user", "Long. " * 30_000), (5, 2, "agent", "日本語。"), (6, 1, "user", "same."), (6, 1, "user", "same."), (6, 1, "user", "same."), (7, -3, "ua", "a.\x0b\n"), (8, 2, "Σ", " "),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = {c: F.lit(1) for c in ("at", "code", "fault", "cells", "piece", "k", "edit", "kept", "time")}
    return spark.createDataFrame(ODD, "conv_id bigint, turn bigint, role string, text string").withColumns(extra).repartition(4)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:100]))


def test_odd_rows(odd):
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ODD]
    got = V.Repair(odd).report
    assert rows_of(got) == brute(in_order(plain), {r[0] for r in ODD})
    assert rows_of(V.damage(odd)) == sorted(brute_damage(ODD), key=str)


def test_empty_table_and_lost_conversations(spark, odd, tmp_path):
    assert V.Repair(odd.filter("false")).report.count() == 0
    lost = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 0, "user", "gone."), (10_001, None, None, None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(got) == {lost, 10_001}


def test_a_conversation_over_many_tasks(spark):
    """One conversation of most rows, dealt over many ranges, repaired as one."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", " ", f"c{t}.", f"d{t}"])) for t in range(3000)]
    rows += [(c, t, "ua"[t % 2] + "x", f"{t}.") for c in (0, 2, 3) for t in range(7)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = V.Repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(9))
        assert made.parsed.filter("conv_id = 1").count() > 3
        assert rows_of(made.report) == brute(rows, {0, 1, 2, 3})
        left = made.rows.filter("conv_id = 2").orderBy("at", "k").collect()
        assert [(r.role, r.text, r.edit) for r in left] == [("ua"[t % 2] + "x", f"{t}.", "K") for t in range(7)] + [("assistant", "", "I")]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_cells_of_all_edits():
    """The chart's least cost and audit are those of all edit strings of short conversations."""
    own = V.Chart()
    for n in (1, 2, 3):
        for codes in itertools.product("suaxUS-", repeat=n):
            found = []
            for letters in itertools.product(itertools.product(("", "I", "II"), "KRD"), repeat=n):
                for end in ("", "I", "II"):
                    audit = "".join(i + e for i, e in letters) + end
                    size = len(audit) - audit.count("D")
                    roles, row, cost = iter(("s" if size % 2 else "") + "ua" * (size // 2)), 0, 0
                    if size == 1:
                        continue
                    for letter in audit:
                        code = codes[row] if letter != "I" else None
                        row += letter != "I"
                        r = next(roles) if letter != "D" else None
                        if letter in "KR" and (code == "-" or (letter == "K") != (code.lower() == r) and (letter == "K" or r == "s") or letter == "R" and r == "s"):
                            break
                        if letter == "I" and r == "s":
                            break
                        cost += {"K": 0, "R": 2, "D": 3, "I": 2}[letter] + (letter in "KR" and code.isupper())
                    else:
                        found.append((cost, audit))
            assert V.best(own.cells("".join(codes))) == min(found), codes


def test_any_split_gives_the_same_cells():
    """The whole chart over all spans and splits agrees with doubling spans."""
    rng = random.Random(1)
    for _ in range(30):
        codes = "".join(rng.choices("suaxSUAX-", k=rng.randint(1, 14)))
        own = V.Chart()
        cells = {(i, i + 1): own.rows[c] for i, c in enumerate(codes)}
        for size in range(2, len(codes) + 1):
            for i in range(len(codes) - size + 1):
                made = [V.joined(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
                assert all(m == made[0] for m in made)
                cells[i, i + size] = made[0]
        assert cells[0, len(codes)] == own.cells(codes)
