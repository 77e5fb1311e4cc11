"""Levels as a table, and boosting on categories of any number of levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from widecast.operators import boost, walk
from widecast.operators.boost import BoostLearner
from widecast.operators.encode import fit_levels, index_label
from widecast.operators.levels import Levels
from widecast.spec import TableSpec


def many_levels(spark):
    """1,200 rows in 120 levels; the level decides the label."""
    level = F.col("id") % 120
    return spark.range(1200).select(
        F.col("id").cast("string").alias("user"),
        F.concat(F.lit("v"), level.cast("string")).alias("brand"),
        F.when((level * 7919 % 31) % 2 == 0, "a").otherwise("b").alias("label"),
    )


def wrong(spark, **settings):
    table = many_levels(spark)
    spec = TableSpec.build("user", "label", picklist=["brand"])
    model = BoostLearner(spec=spec, rounds=2, depth=2, eta=0.5, **settings).fit(table)
    return model.transform(table).filter("predict <> label").count()


def test_no_level_is_pooled(spark):
    assert wrong(spark) == 0


def test_sparse_sums_agree_with_dense_ones(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, sizes = 3000, [7, 500]
    bins = np.stack([rng.integers(0, s, n) for s in sizes], axis=1).astype(np.int16)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2, dtype=np.int32)), pa.array(bins.ravel()))
    batch = pa.RecordBatch.from_arrays([lists, pa.array(rng.integers(0, 2, n, dtype=np.int32)), pa.array(np.ones(n))], names=[walk.BINS, "__y", "__w"])
    empty = (np.full(3, -1, np.int32), walk.joined_sets([np.zeros(0, np.int64)] * 3), np.zeros(3))
    start = np.log([0.4, 0.6])

    def cells(dense, loose):
        monkeypatch.setattr(walk, "DENSE_CELLS", dense)
        monkeypatch.setattr(walk, "LOOSE_CELLS", loose)
        made = walk.gradient_sums(start, [(c, *empty) for c in range(2)], 0, [[0, 1], [0, 1]], sizes, 2)
        found = {}
        for out in made(iter([batch.slice(i, 500) for i in range(0, n, 500)])):
            for row in zip(*(c.to_pylist() for c in out.columns)):
                found[row[:4]] = found.get(row[:4], np.zeros(3)) + np.array(row[4:])
        return found

    whole = cells(1 << 15, 1 << 20)
    for dense, loose in ((100, 1 << 20), (0, 50)):
        other = cells(dense, loose)
        assert whole.keys() == other.keys()
        assert all(np.allclose(whole[k], other[k]) for k in whole)


def test_sparse_sums_are_given_out_in_small_pieces():
    """No batch of a task has more rows than twice 32,768, however many levels there are."""
    import pyarrow as pa

    n = 200_000
    bins = np.random.default_rng(4).permutation(n).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(bins))
    batch = pa.RecordBatch.from_arrays([lists, pa.array((bins % 2).astype(np.int32)), pa.array(np.ones(n))], names=[walk.BINS, "__y", "__w"])
    empty = (np.full(3, -1, np.int32), walk.joined_sets([np.zeros(0, np.int64)] * 3), np.zeros(3))
    for taken, signs in ((None, 1), ([np.ones(1, bool)] * 2, 2)):
        made = walk.gradient_sums(np.log([0.4, 0.6]), [(c, *empty) for c in range(2)], 0, [[0], [0]], [n], 1, taken)
        got = list(made(iter([batch.slice(i, 10_000) for i in range(0, n, 10_000)])))
        assert max(b.num_rows for b in got) <= 1 << 16
        assert sum(b.num_rows for b in got) == 2 * n * signs
        seen = np.concatenate([b.column("bin").to_numpy()[b.column("node").to_numpy() == 0] for b in got])
        assert np.array_equal(np.bincount(seen, minlength=n), np.full(n, 2))


def test_walk_through_wide_sets():
    """Bins beyond a node's last word go right."""
    left = walk.joined_sets([walk.bin_set([0, 63, 64, 700])] + [np.zeros(0, np.int64)] * 2)
    bins = np.array([[0], [1], [63], [64], [700], [701], [5000]], np.int32)
    assert walk.walk(np.array([0, -1, -1]), left, bins, 1).tolist() == [1, 2, 1, 1, 1, 2, 2]


def test_numbers_of_200000_levels(spark):
    """All levels are numbered without gaps, in the order asked for, over several ranges."""
    n = 200_000
    df = spark.range(n + 50).select((F.col("id") % n).cast("string").alias("key"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("x"), F.col("id") % 2)).alias("few"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        levels = fit_levels(df, ["key", "few"], "frequencyDesc")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert levels.sizes == {"key": n, "few": 2}
    assert levels.tables["key"].selectExpr("count(DISTINCT index) AS n", "min(index) AS low", "max(index) AS high").first() == (n, 0, n - 1)
    assert levels.labels("key", 52) == [*sorted(map(str, range(50))), "100", "1000"]
    out = levels.transform(spark.createDataFrame([("49", "x0"), ("none", None), (str(n - 1), "x1")], "key string, few string")).collect()
    assert [r.few_index for r in out] == [*[float(levels.labels("few", 2).index("x0"))], 2.0, float(levels.labels("few", 2).index("x1"))]
    assert out[0].key_index < 50 and out[1].key_index == n


def test_levels_are_kept_and_null_labels_refused(spark, tmp_path):
    df = spark.createDataFrame([("b", "it's"), ("a", ""), (None, None), ("b", "it's")], "one string, two string")
    levels = fit_levels(df, ["one", "two"])
    levels.save(str(tmp_path / "l"))
    again = Levels.load(spark, str(tmp_path / "l"), levels.texts, levels.sizes)
    want = [(1.0, 1.0), (0.0, 0.0), (2.0, 2.0), (1.0, 1.0)]
    for found in (levels, again):
        assert [(r.one_index, r.two_index) for r in found.transform(df).collect()] == want
    assert fit_levels(df.filter("one IS NULL"), ["one"]).sizes == {"one": 0}
    with pytest.raises(Exception, match="null in one"):
        index_label(df, "one").collect()


def signal(spark, n=2000):
    level = F.col("id") * 7919 % 97
    return spark.range(n).select(
        F.col("id").cast("string").alias("user"), F.concat(F.lit("v"), level.cast("string")).alias("brand"), F.concat(F.lit("w"), F.col("id") % 5).alias("product"),
        F.when(F.col("id") % 11 > 0, (F.col("id") * 31 % 1000) / 10).alias("x"), F.when((level % 3 == 0) | (F.col("id") * 31 % 1000 > 800), "a").otherwise("b").alias("label"),
    )


SPEC = TableSpec.build("user", "label", real=["x"], picklist=["brand", "product"])


def scores(model, df):
    return {r["user"]: np.round(r["probabilities"], 9).tolist() for r in model.transform(df).collect()}


def test_splits_over_several_tasks_are_the_same(spark, monkeypatch):
    """Cells sorted in ranges, and sums of many tasks in two steps, give the trees of one window a column."""
    df = signal(spark).repartition(6)
    learner = BoostLearner(spec=SPEC, rounds=2, depth=3, eta=0.4, min_rows=3, mode="newton")
    whole = learner.fit(df)
    monkeypatch.setattr(boost, "WIDE_BINS", 3)
    monkeypatch.setattr(boost, "MIDDLE_TASKS", 2)
    parts = learner.fit(df)
    assert [t.feature.tolist() for t in parts.trees] == [t.feature.tolist() for t in whole.trees]
    assert all(np.array_equal(a, b) for t, u in zip(parts.trees, whole.trees) for a, b in zip(t.left, u.left))
    assert scores(parts, df) == scores(whole, df)


def test_sets_beyond_one_bitmap():
    """Levels 0, 40,000 and 70,000 in three numbered bitmaps are the bits of one set."""
    blocks = []
    for b in (0, 40_000, 70_000):
        bits = np.zeros(4096, np.uint8)
        bits[b % 32_768 // 8] |= 1 << (b % 8)
        blocks.append({"block": b // 32_768 + 1, "bits": bytes(bits)})
    assert boost.words_of_bitmaps(blocks[::-1]).tolist() == walk.bin_set([0, 40_000, 70_000]).tolist()


def test_edges_are_within_the_rank_error(spark):
    n, bins = 30_000, 16
    df = spark.range(n).select(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10 ** (i + 2))) / 7).alias(f"c{i}") for i in range(3)], F.lit(None).cast("double").alias("none"))
    edges = boost.bin_edges(df.repartition(9), ["c0", "c1", "c2", "none"], bins)
    assert edges["none"] == []
    rows = df.toPandas()
    for c in ("c0", "c1", "c2"):
        values = np.sort(rows[c].to_numpy())
        assert len(edges[c]) == bins - 1
        for j, e in enumerate(edges[c], 1):
            low, high = np.searchsorted(values, e, "left") / n, np.searchsorted(values, e, "right") / n
            assert low - boost.RANK_ERROR <= j / bins <= high + boost.RANK_ERROR


def test_a_level_costs_the_same_after_many_trees(spark, monkeypatch):
    """Six rounds of depth eight past two stored states: tasks of a level get the growing trees only."""
    sent, added = [], []

    def counted_sums(prior, growing, *rest):
        sent.append(len(growing))
        return walk.gradient_sums(prior, growing, *rest)

    def counted_margins(spark, prior, trees, *rest, **named):
        added.append(len(trees))
        return margin_column(spark, prior, trees, *rest, **named)

    margin_column = boost.margin_column
    df = signal(spark, 600).withColumn("label", F.when(F.xxhash64("user") % 2 == 0, "a").otherwise("b")).coalesce(1)
    monkeypatch.setattr(boost, "gradient_sums", counted_sums)
    monkeypatch.setattr(boost, "margin_column", counted_margins)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        model = BoostLearner(spec=SPEC, rounds=6, depth=8, eta=0.8, min_rows=1, checkpoint_interval=2).fit(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(sent) == {2} and added == [2, 4, 2, 4, 2] and len(sent) > 6 * 6
    assert len(model.trees) == 12 and model.transform(df).filter("predict <> label").count() < 150
