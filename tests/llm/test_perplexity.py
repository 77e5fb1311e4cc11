"""Perplexity rules against a plain modified Kneser-Ney model."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from widecast.llm import perplexity as P, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def base(text):
    raw = (text or "").encode()
    words = WORD.findall(raw)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line.encode()):
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


def grams(text, n=P.ORDER):
    body = b"\n" * (n - 1) + b" ".join(WORD.findall((text or "").encode())).lower() + b"\n"
    return [body[i : i + n] for i in range(len(body) - n + 1)]


def entropies(rows):
    """Mean bits a byte of every text under its language's model."""
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        counts[lang or ""].update(grams(text))
    found = {}
    for lang, top in counts.items():
        tables = {P.ORDER: top}
        for n in range(P.ORDER - 1, 0, -1):
            tables[n] = Counter(g[1:] for g in tables[n + 1])
        p = {}
        for n in range(1, P.ORDER + 1):
            of = Counter(tables[n].values())
            d = list(P.MISSING_DISCOUNTS)
            if of[1] and of[2] and of[3]:
                y = of[1] / (of[1] + 2 * of[2])
                own = [k - (k + 1) * y * of[k + 1] / of[k] for k in (1, 2, 3)]
                d = [x if 0 <= x <= k else f for k, (x, f) in enumerate(zip(own, P.MISSING_DISCOUNTS), 1)]
            context = defaultdict(list)
            for g, c in tables[n].items():
                context[g[:-1]].append(c)
            for g, c in tables[n].items():
                cs = context[g[:-1]]
                rest = sum(d[min(x, 3) - 1] for x in cs) / sum(cs)
                p[g] = (c - d[min(c, 3) - 1]) / sum(cs) + rest * (p[g[1:]] if n > 1 else 1 / P.SYMBOLS)
        found[lang] = {g: -math.log2(p[g]) for g in top}
    return [sum(found[lang or ""][g] for g in grams(text)) / len(grams(text)) for _, text, lang in rows]


def brute(rows, least_texts=P.LEAST_TEXTS, reach=P.BAND_REACH):
    bits = entropies(rows)
    bases = [base(t) for _, t, _ in rows]
    failed = [b[0] < 50 or 100 * b[4] > 50 * b[0] for b in bases]
    kept = []
    for (_, _, lang), e, f in zip(rows, bits, failed):
        texts = {t: x for (_, t, other), x, bad in zip(rows, bits, failed) if not bad and (other or "") == (lang or "")}
        inside = True
        if len(texts) >= least_texts:
            values = sorted(texts.values())
            low, high = (values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75))
            width = reach * max(high - low, P.LEAST_RANGE)
            inside = low - width - 1e-9 <= e <= high + width + 1e-9
        kept.append(not f and inside)
    return [(d, *b, f, k, e) for (d, _, _), b, f, k, e in zip(rows, bases, failed, kept, bits)]


def check(got, want):
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:8])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:8] for r in got] == [r[:8] for r in want]
    assert np.allclose([r[8] for r in got], [r[8] for r in want], rtol=1e-4)


def rows_of(df):
    return [(r.doc_id, r.text, r.lang) for r in df.select("doc_id", "text", "lang").collect()]


def test_registered_query(spark):
    rows = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    got = queries.op13_perplexity_rules(spark, SF)
    assert got.columns == ["doc_id", *P.BASE, "base_failed", "kept", "entropy"]
    check(got.collect(), brute(rows))


@pytest.mark.parametrize("head", [0, 500, P.HEAD_GRAMS])
def test_grams_outside_the_head_are_joined(spark, head):
    rows = rows_of(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    check(P.judge(df, head_grams=head, least_texts=5).collect(), brute(rows, least_texts=5))


LONG = "Word, other thing " * 20_000 + "x" * 5000
ODD = [
    (1, None, "en"), (2, "", None), (3, " \n\t \x0b", "en"), (4, LONG, "en"), (5, "Same text, it's here.", "en"), (6, "Same text, it's here.", "de"), (6, "Same text, it's here.", "de"),
    (None, "No id at all " + " ".join(f"w{i}" for i in range(80)), None), (None, None, None), (7, "日本語 текст\x85ñ ß İ Σ 1２ \x1c x", "xx"),
    (8, "a b\na b\na b \n\n \nA b\r\na b\r\nc a b a b a b|#", "en"), (9, " ".join(f"v{i}" for i in range(60)), "\n"),
]


@pytest.mark.parametrize("least_texts", [1, P.LEAST_TEXTS])
def test_odd_rows(spark, least_texts):
    extra = {c: F.lit(1) for c in ("row", "bits", "symbols", "language", "gram", "n", "kept", "entropy", "text_hash", "lower")}
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string").withColumns(extra).repartition(4)
    check(P.judge(df, least_texts=least_texts).collect(), brute(ODD, least_texts))
    assert P.judge(df.filter("false")).count() == 0


def test_junk_is_outside_the_band(spark):
    """Of labelled texts that pass the base rules, poor ones go and good ones stay."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op13_perplexity_rules(spark, sf).filter("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.995 and kept[0] < 0.95


def test_a_copied_text_does_not_move_the_band(spark):
    rng = random.Random(7)
    texts = [(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=60 + i)), "en") for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    scored = P.entropies(df, P.model(df))
    many = scored.unionByName(scored.filter("doc_id = 3").crossJoin(spark.range(500)).select(scored.columns))
    assert many.count() == 540 and P.bands(scored).collect() == P.bands(many).collect() != []


def test_discounted_shares_sum_to_one(spark):
    """Over all seen and unseen symbols, each context's shares and rest sum to one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counted = P.count_grams(docs)
    sums = P.discounted(counted).groupBy("language", F.shiftright("gram", 8).alias("context")).agg((F.sum("own") + F.max("rest")).alias("total"))
    assert sums.filter("abs(total - 1) > 1e-9").count() == 0
