"""The text operators against brute force, the libraries they must agree with, and edge cases."""

import base64
import hashlib
import random
import re
import zlib
from html import unescape

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from widecast.llm import bytebpe, decontaminate, html_text, langid, quality, queries, repair, shards, simhash, topk, toxicity
from widecast.llm.common import id_crc

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "word, other " * 20_000 + "x" * 5000
# Nulls in every column, empty and long texts, ties, repeated rows, extra columns with names the operators use.
ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "  \n\t ", "en", "a"), (4, LONG, "en", "a"), (5, "Same text, it's here.", "en", "b"),
    (6, "Same text, it's here.", "de", "b"), (6, "Same text, it's here.", "de", "b"), (None, "No id at all", "fr", "c"), (None, None, None, None),
    (7, "日本語 текст ñ ß İ Σ 1２   x", "xx", "a"), (8, "<|endoftext|> 'LL we'll\r\n\r\n  end  ", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    extra = {c: F.lit(1) for c in ("score", "ids", "fp", "lang_pred", "part", "text_to_score", "shard", "html", "n_tokens")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def key(row):
    return tuple((x is not None, x) if not isinstance(x, (list, bytes)) else (True, str(x)) for x in row)


# Re-Pair files


def text_hash(text):
    """The hash that orders rows of one id; a null text has the seed."""
    return 42 if text is None else int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64))


def expected_files(rows):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    out, start = [], 0
    made = [(d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], np.uint32), text_hash(t)) for d, t in rows]
    for d, ids, _ in sorted(made, key=lambda r: (r[0] is not None, 0 if r[0] is None else r[0], r[2])):
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("part_bytes", [1 << 25, 40_000])
def test_token_files_of_odd_rows(spark, odd, part_bytes, tmp_path):
    repair.write(odd, WORDS, str(tmp_path), 2, block_ids=3000, part_bytes=part_bytes)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in repair.read(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected_files([(r[0], r[1]) for r in ODD])


def test_token_files_of_string_ids_and_one_null_id(spark, tmp_path):
    rows = [(f"k{i % 90:03}" if i % 3 else None, f"text number {i}, " * 40) for i in range(300)]
    repair.write(spark.createDataFrame(rows, "doc_id string, text string"), WORDS, str(tmp_path), 2, block_ids=2000, part_bytes=20_000)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in repair.read(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected_files(rows)
    nulls = spark.read.parquet(str(tmp_path)).filter("exists(doc_ids, x -> x IS NULL)")
    assert nulls.select("part").distinct().count() > 2


def test_ids_of_chunks_of_odd_letters():
    """Chunks that are cut into word and signs, and those that only look alike, against the library."""
    rng = np.random.default_rng(7)
    signs = list("abzABZ.,!'`-09[]~") + list("ÀÖ×ØÞßàö÷øÿ") + ["Ā", "ſ", "İ", "e\u0301", "中", "Ω", "\t", "\xa0", "\u00c3"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 12)).tolist()) for _ in range(4000)]
    texts += ["x" * 300, "Ä" * 200 + "!" * 100, "", "é" * 128, "é" * 129]
    texts = [" ".join(texts[i : i + 9]) for i in range(0, len(texts), 9)]
    tokenizer = Tokenizer.from_file(WORDS)
    flat, ends = repair.TextIds(WORDS).encode(pa.array(texts))
    got = [flat[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_registered_query(spark, docs):
    got = sorted(map(tuple, queries.op1_repair_token_files(spark, SF).collect()))
    assert got == expected_files([(r.doc_id, r.text) for r in docs.collect()])


def test_token_files_random_access(spark, docs, tmp_path):
    repair.write(docs, WORDS, str(tmp_path), 2, block_ids=20_000)
    whole = {r.doc_id: r for r in repair.read(spark, str(tmp_path)).collect()}
    some = repair.read(spark, str(tmp_path), [3, 77, 150, 10**9]).collect()
    assert {r.doc_id for r in some} == {3, 77, 150}
    assert all(r == whole[r.doc_id] for r in some)


def test_token_files_of_an_empty_table(spark, empty, tmp_path):
    repair.write(empty, WORDS, str(tmp_path), 2)
    assert repair.read(spark, str(tmp_path)).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(5)
    for alphabet, n in ((1, 50), (2, 999), (5, 3000), (400, 5000)):
        ids = rng.integers(0, alphabet, n).astype(np.uint32)
        last = rng.random(n) < 0.02
        last[-1] = True
        symbols, marks, rules, spans = repair.compress(ids, last, 500)
        assert np.array_equal(repair.expand(symbols, 500, rules, spans), ids)
        known = np.concatenate([np.ones(500, int), spans])
        assert np.array_equal(np.cumsum(known[symbols])[marks], np.flatnonzero(last) + 1)
        assert alphabet > 5 or len(symbols) < n / 2
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2))
            if a < b:
                assert np.array_equal(repair.expand_span(symbols, 500, rules, spans, a, b), ids[a:b])


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(8)
    # Few pairs are frequent, so that no round shortens the block by much.
    ids = rng.permutation(30_000).astype(np.uint32)
    for k in range(300):
        at = rng.integers(0, len(ids) - 2, 5)
        ids[at], ids[at + 1] = 30_000 + 2 * k, 30_001 + 2 * k
    for block, base in ((ids, 31_000), (rng.zipf(1.3, 20_000).clip(max=400).astype(np.uint32), 401)):
        last = rng.random(len(block)) < 0.01
        last[-1] = True
        symbols, marks, rules, spans = repair.compress(block, last, base)
        assert np.array_equal(repair.expand(symbols, base, rules, spans), block)
        pairs = (symbols[:-1].astype(np.int64) << 32 | symbols[1:])[~marks[:-1]]
        assert np.unique(pairs, return_counts=True)[1].max() < repair.MIN_COUNT


# Byte-level BPE


def test_split_and_merge_agree_with_the_library(encoding):
    rng = random.Random(3)
    signs = "ab zé' \n\t　's've'll're1２!?.#'́​한\U0001f600stmdrevl  \x85\x1c"
    texts = ["".join(rng.choices(signs, k=rng.choice([0, 1, 2, 3, 5, 9, 30, 300]))) for _ in range(3000)]
    texts += ["x" + chr(c) + "'s " + chr(c) + " " + chr(c) * 2 + "1" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x800 or c % 61 == 0)]
    texts += ["a" * 1000 + "bcé" * 300, "!" * 500, " " * 400, "it's" * 100]
    ids, ends = bytebpe.vocabulary(RANKS).encode(texts)
    start = 0
    for text, end in zip(texts, ends):
        assert ids[start:end].tolist() == encoding.encode_ordinary(text), repr(text)
        start = end


def test_bpe_query(spark, docs, encoding):
    got = {r.doc_id: r for r in queries.op2_byte_bpe(spark, SF).collect()}
    for r in docs.collect():
        ids = np.array(encoding.encode_ordinary(r.text), np.uint32)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_bpe_of_odd_rows(odd, empty, encoding):
    encoded = bytebpe.encode(odd, RANKS)
    rows = encoded.collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in rows) == sorted((d is not None, d or 0, np.array(encoding.encode_ordinary(t or ""), np.uint32).tobytes()) for d, t, *_ in ODD)
    for r in rows:
        ends = np.frombuffer(r.ends, np.uint32).tolist()
        assert ends == np.cumsum([len(encoding.decode_single_token_bytes(i)) for i in np.frombuffer(r.ids, np.uint32)]).tolist()
    decoded = bytebpe.decode(encoded, RANKS).collect()
    assert sorted(bytes(r.decoded) for r in decoded) == sorted((t or "").encode() for _, t, *_ in ODD)
    assert bytebpe.decode(bytebpe.encode(empty, RANKS), RANKS).count() == 0


# Decontamination


def test_overlaps_survive_substitutions(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(20)] + [(20, "one two three four"), (21, "five words are just enough"), (22, None), (23, "")]
    rows = []
    for i, text in items[:20]:
        w = text.split()
        w[7], w[19] = "changed", "also"
        filler = rng.choices(words, k=40)
        rows += [(100 + i, " ".join(filler[:20] + w + filler[20:]).upper()), (200 + i, " ".join(filler)), (300 + i, " ".join(filler[:20] + w[:6] + filler[20:]))]
    rows += [(400, "say: five words, are JUST enough!"), (401, "one two three four"), (402, None), (403, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs, benchmark).collect()}
    assert set(got) == {(100 + i, i) for i in range(20)} | {(400, 21)}
    assert all((got[100 + i, i].first_word, got[100 + i, i].n_words, got[100 + i, i].n_equal) == (20, 30, 28) for i in range(20))
    kept = decontaminate.without_overlaps(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in got}
    assert decontaminate.overlaps(docs, benchmark.filter("false")).count() == 0
    assert decontaminate.overlaps(docs.filter("false"), benchmark).count() == 0


def test_ten_words_at_the_ends_of_texts_and_items():
    item = [f"i{k}" for k in range(30)]
    eleven = [f"e{k}" for k in range(11)]
    other = [f"o{k}" for k in range(50)]
    cases = [
        (item[-10:] + other, 0, 0), (other + item[:10], 0, 50), (item[-10:], 0, 0), (item[:10], 0, 0), (item[-11:-5] + ["x"] + item[-4:], 0, 0), (item[10:20], 0, 0),
        (other + item[-10:] + other, 0, 50), (other + item[:10] + other, 0, 50), (other + eleven[:5] + ["x"] + eleven[6:] + other, 1, 50), (eleven[1:], 1, 0), (other, None, 0), (item[-9:], None, 0), ([], None, 0),
    ]
    seeds = decontaminate.Seeds.of([(0, " ".join(item)), (1, " ".join(eleven))])
    texts = [" ".join(words) for words, _, _ in cases]
    want = [(t, i, first, 10) for t, (_, i, first) in enumerate(cases) if i is not None]
    assert [(t, i, first, n) for t, i, first, _, n in seeds.overlaps(*decontaminate.words_of(texts))] == want
    alone = [(t, *found[1:3], found[4]) for t, text in enumerate(texts) for found in seeds.overlaps(*decontaminate.words_of([text]))]
    assert alone == want


def test_overlaps_of_the_query_hold_every_whole_item(spark, docs):
    def plain(t):
        return " " + " ".join(re.findall(r"\w+", t.lower())) + " "

    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items if plain(i.text) in plain(d.text)}
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontaminate(spark, SF).collect()}
    assert want and want <= got


def test_masks_leave_every_pair_of_positions_out():
    for a in range(decontaminate.WINDOW):
        for b in range(decontaminate.WINDOW):
            assert any(a not in m and b not in m for m in decontaminate.MASKS)


def test_benchmark_blocks_give_the_same(spark, docs, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.overlaps(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 400)
    assert sorted(map(tuple, decontaminate.overlaps(docs, benchmark).collect())) == want


# Language


def brute_phrases(text, sample):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(2)
    samples = {"a": ["".join(rng.choices("abc ", k=300))], "b": ["".join(rng.choices("xyzab", k=200))]}
    model = langid.LanguageModel.fit(samples)
    texts = ["".join(rng.choices("abcxyz ", k=rng.randint(1, 200))) for _ in range(50)]
    flat, ends = langid.letters(texts)
    got = model.phrases(model.alphabet[flat], ends)
    start = 0
    for row, end in zip(got, ends):
        symbols = "".join(map(chr, flat[start:end]))
        for k, language in enumerate(model.languages):
            sample = "".join(map(chr, langid.letters(samples[language])[0]))
            assert row[k] == brute_phrases(symbols, sample)
        start = end


def test_language_query_and_odd_rows(spark, docs, odd, empty):
    rows = queries.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    got = langid.predict(odd, langid.fit(docs, id_crc() % 4 != 2)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, None}
    assert langid.predict(empty, langid.fit(empty, F.lit(True))).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty, F.lit(True))).collect()} == {"und"}


def test_a_small_language_with_many_copies_is_learned(spark):
    rng = random.Random(6)
    made = lambda signs, n: [" ".join("".join(rng.choices(signs, k=6)) for _ in range(30)) for _ in range(n)]
    large, small = made("abcdef", 300), made("uvwxyz", 3)
    rows = [("large", t) for t in large] + [("small", t) for t in small] + [("small", small[0])] * 60_000
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    model = langid.fit(df, F.lit(True))
    assert model.languages == ["large", "small"]
    assert {r.lang_pred for r in langid.predict(df.filter("lang = 'small'"), model).select("lang_pred").distinct().collect()} == {"small"}


# Pages

PAGES = [
    ("<html><body><nav><a href=x>menu</a></nav><div class='content with-sidebar'><h1>Title</h1><p>A long text, with commas, and more &amp; more &eacute;&#233;.</p><p>Short.</p>"
     "<div class=comments><p>I, think, this</p></div></div><div id=sidebar><p>side, bar, text</p></div><footer>f</footer></body></html>", "Title\nA long text, with commas, and more & more éé.\nShort."),
    ("<p>x<script>if (a<b) {}</script>y<br>z\n\n w</p>", "xy z w"), ("plain &lt;text&gt;", "plain <text>"), ("", ""), (None, ""), ("<p>cut <a href=\"q", "cut"),
    ("<body><header><h1>Site</h1></header><main><article><p>Text, one.</p><aside>no</aside><form>f<input></form></article></main>", "Text, one."),
    ("<nav>only</nav><footer>boilerplate</footer>", ""), ("<table><tr><td>a<td>b</table>", "a\nb"),
]


def test_main_text_of_small_pages(spark):
    df = spark.createDataFrame([(i, None, h) for i, (h, _) in enumerate(PAGES)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html_text.extract(df.filter("false")).count() == 0


def test_pages_of_many_elements_take_linear_time():
    """Nested elements, lists of links and ends that open nothing, a hundred thousand each."""
    import time

    n = 100_000
    lists = "<ul><li><a href=x>one</a></li><li><a>two</a><a>three</a></li></ul>" * n
    pages = ["<div><p>some words, here</p>" * n, "<article><p>" + "a long text, " * 50 + "</p>" + lists + "</article>", "<ul>" * n + "text" + "</nav></span>" * n]
    start = time.process_time()
    texts = [html_text.main_text(p) for p in pages]
    assert time.process_time() - start < 30
    assert texts[0].count("\n") > n // 2 and texts[1] == ("a long text, " * 50).strip() and texts[2] == "text"



def test_main_text_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op5_main_text(spark, SF).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*(?:>|\Z)", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# Shards


def brute_shards(rows, n, seed):
    def tie(r):
        d, t, _ = r
        text = "|".join([str(seed), "" if d is None else str(d), str(zlib.crc32((t or "").encode()))])
        return int(hashlib.md5(text.encode()).hexdigest()[:14], 16), (d is not None, d or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = []
    for mine in by.values():
        for k, r in enumerate(sorted(mine, key=tie), 1):
            order.append(((2.0 * k - 1) / (2.0 * len(mine)), tie(r), r))
    order.sort(key=lambda x: x[:2])
    firsts = {}
    out = []
    for position, (_, _, (d, t, s)) in enumerate(order):
        shard = position * n // len(rows)
        firsts.setdefault(shard, position)
        out.append((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s, shard, position - firsts[shard]))
    return sorted(out, key=key)


@pytest.mark.parametrize("rows_per_bucket", [50_000, 7])
def test_shards_against_brute_force(spark, docs, odd, empty, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(shards, "ROWS_PER_BUCKET", rows_per_bucket)
    for df in (docs, odd, docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source")))):
        rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
        got = sorted(map(tuple, shards.interleave(df, 16, 7).collect()), key=key)
        assert got == brute_shards(rows, 16, 7)
    assert shards.interleave(empty, 16, 7).count() == 0


# SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    values = np.array(prints, np.uint64)
    label = np.arange(len(rows))
    for i in range(len(rows)):
        simhash.unite(label, np.full(len(rows), i)[near := np.bitwise_count(values ^ values[i]) <= 4], np.arange(len(rows))[near])
    names = {}
    for (d, _), c in zip(rows, label):
        names[c] = min((x for x in (names.get(c), d) if x is not None), default=None)
    return sorted(((d, f"{p:016x}", names[c]) for (d, _), p, c in zip(rows, prints, label)), key=key)


def test_simhash_query(spark, docs):
    assert sorted(map(tuple, queries.op7_simhash_groups(spark, SF).collect()), key=key) == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_simhash_of_odd_rows(odd, empty):
    got = [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.groups(odd).collect()]
    assert sorted(got, key=key) == brute_groups([(d, t) for d, t, *_ in ODD])
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 0), (True, 1), (True, 4), (True, 5), (True, 7), (True, 8)]
    assert simhash.groups(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("bucket", [1 << 18, 6])
def test_trie_join_loses_no_link(spark, bucket):
    rng = np.random.default_rng(4)
    values = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)]
    for v in values[:20]:
        for _ in range(30):
            for b in rng.choice(64, rng.integers(1, 8), replace=False):
                v ^= 1 << int(b)
            values.append(v)
    values = np.unique(np.array(values, np.uint64))
    want = np.arange(len(values))
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4)
        simhash.unite(want, np.full(len(near), i), near)
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp bigint")
    place = {int(x): i for i, x in enumerate(values.view(np.int64))}
    found = simhash.components(simhash.links(df, 4, bucket)).collect()
    got = np.arange(len(values))
    simhash.unite(got, np.array([place[r.v] for r in found]), np.array([place[r.root] for r in found]))
    assert np.array_equal(got, want)


def test_other_texts_of_one_id_stay(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(rng.choices([f"w{k}" for k in range(900)], k=80)) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (3, a)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, kept.collect())) == sorted([(1, a), (1, b), (3, c)])


# Top-k


def test_topk_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (20, [1.0]), (21, [2.0]), (40, [1e15, -1.0]), (None, [1.0, 1.0]), (6, []), (5, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"rank": F.lit(0), "score": F.lit(0)})
    usable = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in usable:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in usable if c != q and len(b) == len(a))
            want += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:3], 1)]
    got = topk.search(df, F.col("vec_id") % 20 == 0, 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, 3, group_bytes=40).collect())) == sorted(want)
    assert topk.search(df.filter("false"), F.lit(True), 3).count() == 0


def test_topk_query(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, queries.op8_exact_topk(spark, SF).collect())) == sorted(con.execute(queries.TOPK_SQL).fetchall())


# Classifiers


def held_out_accuracy(run, labels, name, spark, sf):
    rows = run(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert rows and all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == r[name] for r in rows) / len(rows)


def test_held_out_accuracy(spark, labels):
    assert held_out_accuracy(queries.op9_pairwise_quality, labels, "quality", spark, "/root/testdata/sf0.1") > 0.98
    assert held_out_accuracy(queries.op10_weak_toxicity, labels, "toxic", spark, "/root/testdata/sf0.1") > 0.96


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(docs, labels, odd, empty, module, label):
    model = module.fit(docs, labels, F.lit(True), label)
    got = module.score(odd, model)
    assert set(got.columns) == set(odd.columns) and got.count() == len(ODD)
    rows = got.collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert module.score(empty, model).count() == 0
    assert module.fit(docs, labels.filter("false"), F.lit(True), label) is None
    assert len({r.score for r in module.score(odd, None).collect()}) == 1
    assert module.fit(docs, labels.withColumn(label, F.lit(None).cast("int")), F.lit(True), label) is None


def test_quality_learns_from_every_pair_and_row(spark):
    """Weights are those of all pairs of a good and a poor text, the cut has the fewest errors of all rows."""
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma,", "delta.", "##", "12", "||", "EPSILON", "zeta!", "a"]
    rows = []
    for i in range(600):
        good = i % 3 != 0
        noisy = rng.random() < (0.25 if good else 0.7)
        chosen = rng.choice(words if noisy else words[:4], int(rng.integers(0, 60)))
        rows.append((i, " ".join(chosen), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    x, y = np.array([quality.features(t) for _, t, _ in rows]), np.array([y for *_, y in rows]) == 1
    np.testing.assert_allclose(model.mean, x.mean(axis=0), atol=1e-8)
    np.testing.assert_allclose(model.scale, np.maximum(x.std(axis=0), 1e-6), atol=1e-8)
    z = (x - np.array(model.mean)) / np.array(model.scale)
    differences = (z[y][:, None] - z[~y][None]).reshape(-1, z.shape[1])
    slope = differences.T @ (quality.logistic(differences @ np.array(model.weights)) - 1) / len(differences) + quality.RIDGE * np.array(model.weights)
    assert np.abs(slope).max() < 2e-5  # the sum over every pair is at its least
    scores = np.round(z @ np.array(model.weights), 9)
    errors = {c: int((y & (scores < c)).sum() + (~y & (scores >= c)).sum()) for c in [*scores, np.inf]}
    assert errors[min(errors, key=lambda c: (errors[c], c))] == int((y & (scores < model.cut)).sum() + (~y & (scores >= model.cut)).sum())
    assert abs(model.steep - 4 / np.abs(scores - model.cut).mean()) < 1e-6


def test_quality_learns_from_more_rows_than_a_task_holds(spark):
    """Every one of 15,000 labelled rows counts, many of one score among them."""
    rows = spark.range(15_000).selectExpr("id AS doc_id", "repeat('word, ', CAST(id % 7 AS INT)) || IF(id % 5 = 0, '## 12', 'end.') AS text", "CAST(id % 5 > 0 AS INT) AS quality")
    model = quality.fit(rows.drop("quality"), rows.drop("text"), F.lit(True))
    texts = [(i, "word, " * (i % 7) + ("## 12" if i % 5 == 0 else "end.")) for i in range(35)]
    x = np.array([quality.features(t) for _, t in texts])
    # 15,000 rows are 428 rounds of 35 and 20 rows more.
    n = np.array([429 if i < 20 else 428 for i, _ in texts])
    np.testing.assert_allclose(model.mean, np.average(x, axis=0, weights=n), atol=1e-8)
    assert [s >= quality.CUT_SCORE for s in model.score(x)] == [i % 5 > 0 for i, _ in texts]


# Pipeline


def test_pipeline_stages(spark, docs, labels, encoding):
    """Each stage against plain recomputation on its own input."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near copies", "decontamination", "token ids"]
    good = corpus_pipeline.keep_good(spark, docs, SF)
    assert good.columns == docs.columns
    model = quality.fit(docs, labels, id_crc() % 5 != 0)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect() if model.score(np.array([quality.features(r.text)]))[0] >= 0.3}
    copies = corpus_pipeline.keep_one_of_each(spark, docs, SF)
    assert sorted(r.doc_id for r in copies.collect()) == sorted({c for _, _, c in brute_groups([(r.doc_id, r.text) for r in docs.collect()])})
    unseen = corpus_pipeline.keep_unseen(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in unseen.collect()} == {r.doc_id for r in queries.op3_decontaminate(spark, SF).collect()}
    final = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 0 < len(final) < len(texts)
    assert all(r.n_tokens == len(encoding.encode_ordinary(texts[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in final)


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (odd, empty):
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= df.count()
    known = corpus_pipeline.keep_known_languages(spark, odd, SF).collect()
    assert {r.doc_id for r in known} == {4, 5, 6, 7, 8, None}
