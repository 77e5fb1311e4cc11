import pytest
from pyspark.sql import functions as F

from widecast import fixtures as X
from widecast.operators import sample as S
from widecast.operators.evaluate import permuted


@pytest.fixture(scope="module")
def table(spark, small):
    return X.wide(spark, small).filter("label IS NOT NULL").persist()


def keys(df):
    return sorted(r["user"] for r in df.select("user").collect())


def test_split_is_a_partition_of_the_rows(table):
    parts = S.split(table, "user", [0.6, 0.3, 0.1], 5)
    assert sorted(k for p in parts for k in keys(p)) == keys(table)
    assert 0.5 < parts[0].count() / table.count() < 0.7


def test_samples_do_not_depend_on_partitions(table):
    other = table.repartition(7, "brand")
    assert keys(S.holdout(table, "user", 0.2, 1)[1]) == keys(S.holdout(other, "user", 0.2, 1)[1])
    a = {r["user"]: r["fold"] for r in S.assign_folds(table, "user", 5, 3).collect()}
    b = {r["user"]: r["fold"] for r in S.assign_folds(other, "user", 5, 3).collect()}
    assert a == b and set(a.values()) == set(range(5))
    assert keys(S.balance(table, "label", {"2-HIGH": 0.3}, "user", 2)) == keys(S.balance(other, "label", {"2-HIGH": 0.3}, "user", 2))


def test_balance_counts(table):
    before = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    factors = {"1-URGENT": 0.2, "2-HIGH": 2.5}
    after = {r["label"]: r["count"] for r in S.balance(table, "label", factors, "user", 1).groupBy("label").count().collect()}
    for c, n in before.items():
        factor = factors.get(c, 1.0)
        chance = factor % 1  # of one more copy; four standard deviations are allowed
        assert abs(after[c] - n * factor) <= 4 * (n * chance * (1 - chance)) ** 0.5
    assert after["5-LOW"] == before["5-LOW"]


def test_cap_scales_all_factors(table):
    factors = {c: 4.0 for c in X.PRIORITIES}
    capped = S.capped_factors(table, "label", factors, 2.0)
    assert all(v == pytest.approx(2.0) for v in capped.values())
    assert S.capped_factors(table, "label", {c: 1.0 for c in X.PRIORITIES}, 2.0)["5-LOW"] == 1.0


def test_row_samples_differ_between_rounds(table):
    a, b = (keys(S.row_sample(table, "user", 0.7, 1, r)) for r in (0, 1))
    assert a != b and 0.6 < len(a) / table.count() < 0.8


def test_column_sample():
    columns = [f"c{i}" for i in range(20)]
    one = S.column_sample(columns, 0.2, 1, 0, 0)
    assert len(one) == 4 and one == S.column_sample(columns, 0.2, 1, 0, 0)
    assert one != S.column_sample(columns, 0.2, 1, 1, 0)
    assert S.column_sample(columns, 0.001, 1) and S.column_sample(columns, 1.0, 1) == columns


def test_restore_prior(spark):
    df = spark.createDataFrame([([0.5, 0.5],)], "p array<double>")
    got = df.select(S.restore_prior(F.col("p"), [0.5, 0.5], [0.8, 0.2]).alias("q")).first()["q"]
    assert got == pytest.approx([0.2, 0.8])


@pytest.mark.parametrize("group_rows", [50, 100000])
def test_permutation_keeps_all_values(table, group_rows):
    mixed = permuted(table, "user", ["cust_point", "brand"], 1, group_rows)
    assert mixed.count() == table.count()
    a, b = (sorted(r[0] for r in mixed.select(c).collect()) for c in ("cust_point", "__shuffled_cust_point"))
    assert a == b
    assert mixed.filter("cust_point = __shuffled_cust_point").count() < table.count() * 0.05


def test_factors_must_match_classes():
    with pytest.raises(ValueError):
        S.class_factors(["a", "b"], [1.0])


def test_split_keeps_tiny_shares(spark):
    many = spark.range(100_000).selectExpr("concat('k', id) AS user")
    _, rare = S.split(many, "user", [0.9996, 0.0004], 5)
    assert 15 <= rare.count() <= 80
