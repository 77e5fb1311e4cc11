"""Importance resampling against a plain recomputation."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from widecast.llm import queries, resample

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BIG = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "word Other, x1 " * 20_000 + "é" * 5000 + " " + "q" * 70 + " end"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "Same text, it's here. " * 6), (6, "Same text, it's here. " * 6), (6, "Same text, it's here. " * 6),
    (None, "no id at all " * 9), (None, None), (7, "日本語 текст ñ ß İ Σ 1２ x " * 5), (8, "a_b-c\x00d\x7fe A1 " * 8), (9, "z" * 64 + " " + "z" * 65 + " " + "z" * 700 + " k" * 30),
]


def buckets_of(text):
    w = WORD.findall((text or "").translate(BIG))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, share=(5, 100), least=20):
    made = [(d, *buckets_of(t)) for d, t in rows]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, _, f in made:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, buckets_of(text)[1], 1)
    all_s, all_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((y + 1) * (all_s + 10_000) / ((x + 1) * (all_t + 10_000)))) for x, y in zip(s.tolist(), t.tolist())]
    out, may = [], []
    for d, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= least:
            may.append(out[-1])
    may.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: share[0] * len(may) // share[1]], 1):
        r[4] = k
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x or 0) for x in r))


def test_registered_query(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = queries.op11_importance_resample(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and set(t for _, t in got.dtypes) == {"bigint"}
    assert ordered(got.collect()) == ordered(brute([(r.doc_id, r.text) for r in docs], [r.text for r in items]))


@pytest.mark.parametrize("share", [(5, 100), (50, 100), (1, 1)])
def test_odd_rows(spark, share):
    extra = {c: F.lit(1) for c in ("row", "weight", "score", "id", "worse", "rank", "range", "bucket")}
    df = spark.createDataFrame(ODD, "doc_id bigint, text string").withColumns(extra).repartition(5)
    target = ["same text here", None, "", "日本語 end"]
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), share, group_rows=2)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    assert ordered(got.select(columns).collect()) == ordered(brute(ODD, target, share))


def test_empty_tables(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string")
    none = docs.filter("false")
    assert resample.resample(none, docs).count() == 0
    assert ordered(resample.resample(docs, none, (1, 2)).select("doc_id", "n_features", "weight", "score", "rank").collect()) == ordered(brute(ODD, [], (1, 2)))


@pytest.mark.parametrize("group_rows", [3, 50, 1 << 18])
def test_cutoff_is_the_exact_key(spark, monkeypatch, group_rows):
    """Any rank, with many ties in score and id, whatever the groups; the keys are written anew on the way."""
    monkeypatch.setattr(resample, "SHRINK", 2)
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), i, rng.choice([5, 5, 5, 9, -2, rng.randint(-99, 99)])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, row bigint, score bigint").repartition(7)
    keys = sorted((-s, int(d is None), d or 0, i) for d, i, s in rows)
    for number in (1, 333, 700):
        assert resample.cutoff(df, number, group_rows) == keys[number - 1]
    assert resample.cutoff(df, 0) is None


def test_each_round_discards_a_quarter(spark):
    medians = [(1, n, -k, 0, 0, k) for k, n in enumerate([5, 1, 9, 4, 4, 1, 30, 2])]
    key = resample.weighted_median(medians)
    total = sum(r[1] for r in medians)
    assert sum(r[1] for r in medians if r[2:] <= key) * 2 >= total and sum(r[1] for r in medians if r[2:] >= key) * 2 >= total


def test_checksums_of_runs_of_words():
    rng = random.Random(2)
    words = [bytes(rng.choices(b"abcxyz019\xc3\xa9", k=n)) for n in (1, 2, 3, 5, 8, 13, 63, 64, 65, 66, 500, 5000) for _ in range(3)]
    rng.shuffle(words)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    found = list(resample.feature_buckets(raw, np.array([0, len(raw)]), 1 << 32))
    assert len(found) == 1
    _, buckets, there, ends = found[0]
    assert ends.tolist() == [len(words)]
    for k in (1, 2, 3):
        want = [zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
        assert buckets[k - 1][there[k - 1]].tolist() == want


def test_blocks_of_words_meet(monkeypatch):
    texts = ["a b c d e f", "", "g", "h i", "j k l m n o p q r s t"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    whole = [b[there].tolist() for _, found, there, _ in resample.feature_buckets(raw, bounds, 10_000) for b, there in zip(found, there)]
    monkeypatch.setattr(resample, "WORDS_AT_ONCE", 2)
    parts = list(resample.feature_buckets(raw, bounds, 10_000))
    assert [[x for _, found, there, _ in parts for x in found[k][there[k]].tolist()] for k in range(3)] == whole
