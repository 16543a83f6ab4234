import pytest
from pyspark.sql import functions as F

from terrane.operators import encode
from terrane.sources.ingest import UnsupportedColumn, ingest, sample_exact, to_wide


def table(spark):
    """Drinks: numbers with and without gaps, a code, a colour and a size in its order."""
    rows = [(10, 0.33, 41.0, 7, "amber", "small", 4.5, None), (11, 0.5, 38.5, 7, "pale", "large", None, 12.0), (12, 0.33, 55.25, 9, "dark", "medium", 9.0, 12.5), (13, 0.75, 38.5, 9, "amber", "medium", float("nan"), None), (14, 1.0, 60.0, 7, "pale", "small", 5.2, 11.0), (15, 0.5, 41.0, 8, None, "large", 4.5, 10.0)]
    return spark.createDataFrame(rows, "sample_id int, litres double, bitterness double, code int, colour string, size string, strength double, wort double")


def test_roundtrip(spark):
    df = table(spark)
    data = ingest(df, "sample_id", categorical={"code"}, ordered={"size": ["small", "medium", "large"]})
    kinds = {r["name"]: (r["kind"], r["categories"], r["ordered"]) for r in data.variables.collect()}
    assert kinds["litres"] == ("continuous", None, False)
    assert kinds["colour"] == ("discrete", ["amber", "dark", "pale"], False)
    assert kinds["size"] == ("discrete", ["small", "medium", "large"], True)
    back = {r["sample_id"]: r for r in to_wide(data, df).collect()}
    for r in df.collect():
        for c in ("litres", "bitterness", "colour", "size", "wort"):
            assert back[r["sample_id"]][c] == r[c]
        assert back[r["sample_id"]]["code"] == str(r["code"])
    assert back[13]["strength"] is None


def test_unsupported(spark):
    with pytest.raises(UnsupportedColumn):
        ingest(spark.createDataFrame([(0, [1])], "sample_id int, xs array<int>"), "sample_id")
    with pytest.raises(UnsupportedColumn):
        ingest(spark.createDataFrame([(0, "a")], "sample_id int, s string"), "sample_id", strict=True)


def bins(spark, values, k):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "sample_id int, v double")
    data = ingest(df, "sample_id")
    return encode.discretize(data.numbers, data.variables, encode.bin_edges(data.numbers, k))


@pytest.mark.parametrize("k", [2, 3, 4, 6])
def test_every_bin_is_used(spark, k):
    values = [30.5, 31.0, 8.25, 8.5, 8.25, 17.0, 64.0, 45.75]
    found = bins(spark, values, k)
    assert found.indicators.count() == k
    assert found.membership.groupBy("sample_id").count().where("count = 1").count() == len(values)
    assert found.membership.select("ind_id").distinct().count() == k


def test_two_bins_constant_and_missing(spark):
    assert bins(spark, [9.0, 1.5, 4.0, 9.0, 2.0, 6.5], 2).indicators.count() == 2
    same = bins(spark, [7.25] * 8, 4)
    assert [r["rule"]["kind"] for r in same.indicators.collect()] == ["eq"] and same.membership.count() == 8
    assert bins(spark, [3.0, None, 8.0, float("nan"), 4.0, None], 2).membership.count() == 3


def test_more_levels_than_any_fixed_cap(spark):
    """The ids of one variable's indicators do not run into those of the next, however many levels it has."""
    n = 120_000
    df = spark.range(n).select(F.col("id").alias("sample_id"), F.concat(F.lit("k"), "id").alias("many"), (F.col("id") % 3).cast("string").alias("few"))
    found = encode.one_hot(*(lambda d: (d.levels, d.variables))(ingest(df, "sample_id")))
    assert found.indicators.select("ind_id").distinct().count() == n + 3
    assert found.membership.groupBy("ind_id").count().where("count > 1").count() == 3


def test_distributed_bins_agree(spark):
    df = spark.range(3000).select((F.rand(3) * F.rand(4)).alias("value"), F.lit(1).alias("n"))
    pdf = df.toPandas().sort_values("value")
    one = encode.kmeans_edges(pdf["value"].to_numpy(), pdf["n"].to_numpy(float), 5)
    far = encode._distributed_edges(spark.createDataFrame(pdf), 5)
    assert max(abs(a - b) for a, b in zip(one, far)) < 0.02


def test_one_hot(spark):
    df = spark.createDataFrame([(0, "0"), (1, None), (2, "1"), (3, "0"), (4, "1")], "sample_id int, d string")
    data = ingest(df, "sample_id", ordered={"d": ["0", "1", "2"]})
    found = encode.one_hot(data.levels, data.variables)
    assert found.indicators.count() == 3
    assert sorted(r["sample_id"] for r in found.membership.collect()) == [0, 2, 3, 4]
    assert encode.expand(data).indicators.count() == 2


def test_constant_columns_go(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0, "a", None), (1, 2.0, float("nan"), "a", None)], "id int, x double, y double, s string, z double")
    assert encode.informative_columns(df, "id") == ["x"]


def test_exact_sample(spark):
    df = spark.range(100)
    one, two = (sorted(r["id"] for r in sample_exact(df, 10, "id", 1).collect()) for _ in range(2))
    assert one == two and len(set(one)) == 10
    assert sample_exact(df, 500, "id").count() == 100


@pytest.mark.parametrize("k", [2, 5, 8])
def test_distributed_bins_are_the_same_where_even_bins_are_empty(spark, monkeypatch, k):
    """Long-tailed values, which leave most even centres without points, and fewer values than bins."""
    skewed = [round(1.01**i, 6) for i in range(600)] * 2 + [1e4, 1e5, 1e6]
    rows = [(i, v, float(i % 3), 7.0) for i, v in enumerate(skewed)]
    data = ingest(spark.createDataFrame(rows, "sample_id int, v double, few double, same double"), "sample_id")
    one = encode.bin_edges(data.numbers, k)
    monkeypatch.setattr(encode, "ONE_TASK", 0)
    far = encode.bin_edges(data.numbers, k)
    assert one.keys() == far.keys() and [len(one[v]) for v in sorted(one)] == [len(far[v]) for v in sorted(one)]
    assert all(far[v] == pytest.approx(one[v], rel=1e-9) for v in one)
