"""Operators that must stay exact when one key holds much of the data, against brute force."""

import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import aggregates, ordering, quality, ranks, sets, windows
from tarnlake.operators.keys import row_key


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key and one text."""
    rng = random.Random(5)
    data = [
        (i, 0 if i % 3 == 0 else rng.randrange(500), "x" * 100 if i % 3 == 0 else rng.choice("abc"))
        for i in range(6000)
    ]
    rng.shuffle(data)
    return spark.createDataFrame(data, "pos bigint, key bigint, txt string").repartition(5)


def test_duplicate_positions(hot):
    pdf = hot.toPandas().sort_values("pos")
    want = set(pdf[pdf.duplicated(["key", "txt"])]["pos"])
    got = windows.duplicate_positions(hot, "pos")
    assert {r["pos"] for r in got.collect()} == want
    first = pdf.groupby(["key", "txt"])["pos"].min().to_dict()
    assert all(first[r["key"], r["txt"]] == r["first_position"] for r in got.collect())


def test_numbered(hot):
    pdf = hot.toPandas().sort_values("pos")
    pdf["n"] = pdf.groupby("key").cumcount() + 1
    got = windows.numbered(hot, "key", "pos", F.floor(F.col("pos") / 500))
    assert {(r["pos"], r["number"]) for r in got.collect()} == set(zip(pdf["pos"], pdf["n"]))


@pytest.mark.parametrize("kind", ["bigint", "double", "date", "timestamp", "timestamp_ntz"])
def test_even_buckets(spark, kind):
    df = spark.range(300).selectExpr(
        "id % 2 AS key",
        f"CAST(id AS {kind}) AS pos" if kind in ("bigint", "double")
        else f"CAST(DATE'2024-01-01' + CAST(id AS INT) AS {kind}) AS pos",
    )
    got = rows(windows.numbered(df, "key", "pos").orderBy("key", "pos"))
    assert [r[2] for r in got] == list(range(1, 151)) * 2


def test_numbered_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "key bigint, pos bigint")
    got = windows.numbered(df, "key", "pos", F.floor(F.col("pos") / 2))
    assert set(rows(got)) == {(None, 1, 1), (None, 2, 2), (1, 3, 1)}


def test_versions(hot, spark):
    old = spark.createDataFrame([(0, 7), (1, 2)], "key bigint, version bigint")
    got = windows.add_versions(old, hot.select("key", "pos"), "key", "pos", F.floor(F.col("pos") / 700))
    low = dict(rows(got.groupBy("key").agg(F.min("version"))))
    assert low[0] == 8 and low[1] == 3 and low[2] == 1
    assert windows.latest_version(hot, "key", "pos").count() == hot.select("key").distinct().count()


def test_keep_first(hot):
    pdf = hot.toPandas().sort_values("pos").drop_duplicates(["key", "txt"])
    assert set(rows(sets.drop_duplicates(hot, "pos"))) == set(pdf.itertuples(index=False, name=None))


def test_row_scores(hot):
    df = hot.drop("pos")
    pdf = df.toPandas()
    assert quality.uniqueness(df).first()["duplicate_rows"] == int(pdf.duplicated().sum())
    counts = {r["column"]: r["distinct_count"] for r in aggregates.distinct_counts(df).collect()}
    assert counts == pdf.nunique().to_dict()


def test_keys_tell_rows_apart(spark):
    long = "x" * 70
    digest = spark.sql(f"SELECT '#' || sha2('{long}', 256)").first()[0]
    data = [("a", None), (None, "a"), ("", None), (None, ""), ("a,b", ""), ("a", "b"), (long, "y"), (digest, "y")]
    df = spark.createDataFrame(data, "s string, t string")
    assert df.select(row_key(df, ["s", "t"])).distinct().count() == len(data)
    assert quality.uniqueness(df.union(df)).first()["duplicate_rows"] == len(data)


def test_repeats_with_nulls_and_nan(spark):
    nan = float("nan")
    data = [(1, None, nan), (2, None, nan), (3, "a", 0.0), (4, "a", -0.0), (5, None, None), (6, "b", nan)]
    df = spark.createDataFrame(data, "pos int, s string, d double")
    got = windows.duplicate_positions(df, "pos").select("pos", "first_position")
    assert set(rows(got)) == {(2, 1), (4, 3)}


def test_equal_zeros(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "d double")
    assert quality.uniqueness(df).first()["duplicate_rows"] == 1
    assert aggregates.distinct_counts(df).first()["distinct_count"] == 2


@pytest.mark.parametrize("seed", range(4))
def test_exact_quantiles(spark, seed):
    rng = random.Random(seed)
    shapes = [
        [rng.gauss(0, 1) for _ in range(997)],
        [float(rng.choice([0, 0, 0, 5])) for _ in range(500)],
        [10.0 ** rng.uniform(-9, 12) for _ in range(1200)],
        [float("nan"), 3.0],
    ]
    values = shapes[seed]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i int")
    want = pd.DataFrame({"x": values, "i": range(len(values))}).describe()
    got = {r["column"]: r for r in aggregates.describe(df, ["x", "i"]).collect()}
    for c in ("x", "i"):
        for name, q in (("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("mean", "mean"), ("min", "min")):
            assert got[c][name] == pytest.approx(want[c][q], rel=1e-12)


SMALLEST = 5e-324
WILD = {
    "log-uniform": lambda rng: [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(2000)],
    "denormal": lambda rng: [k * SMALLEST for k in (0, 1, 2, 2, 3, 5, 8, 1000)] + [-SMALLEST, 1e-310],
    "infinite": lambda rng: [math.inf] * 30 + [-math.inf] * 20 + [rng.gauss(0, 1e5) for _ in range(200)],
    "full range": lambda rng: [1.7976931348623157e308, -1.7976931348623157e308, 0.0, -0.0, SMALLEST, -SMALLEST, 1.0, -1.0] * 40,
    "neighbours": lambda rng: [math.nextafter(1.0, 2.0) + k * 2.0**-52 for k in range(500)],
    "outlier": lambda rng: [1e300] + [rng.random() * 1e-5 for _ in range(999)],
    "whole": lambda rng: [float(rng.randrange(-(1 << 62), 1 << 62)) for _ in range(999)],
}


@pytest.mark.parametrize("shape", sorted(WILD))
def test_quantiles_end_in_a_few_passes(spark, monkeypatch, shape):
    values = WILD[shape](random.Random(7))
    df = spark.createDataFrame([(v,) for v in values], "x double")
    passes = []
    monkeypatch.setattr(ranks, "_histograms", lambda *a, f=ranks._histograms: passes.append(1) or f(*a))
    got = ranks.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])["x"]
    ordered = sorted(values)
    for p, found in zip((0.0, 0.25, 0.5, 0.75, 1.0), got, strict=True):
        at = p * (len(ordered) - 1)
        low, high = ordered[int(at)], ordered[min(int(at) + 1, len(ordered) - 1)]
        assert found == (low if low == high else low + (high - low) * (at - int(at)))
    assert len(passes) <= 7


def test_quantiles_of_large_whole_numbers(spark):
    values = [(1 << 53) + k for k in range(200)] + [-(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v, f"{v}.5") for v in values], "x bigint, t string").selectExpr("x", "CAST(t AS DECIMAL(30, 1)) AS d")
    want = sorted(map(float, values))
    for name in ("x", "d"):
        assert ranks.exact_quantiles(df, [name], [0.0, 1.0])[name] == [want[0], want[-1]]
        assert want[99] <= ranks.exact_quantiles(df, [name], [0.5])[name][0] <= want[103]


def test_later_passes_push_their_ranges(spark, tmp_path):
    spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x", "id AS n").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = ranks.open_values(df, [("x", 3.0, 4.0)])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(x,3.0)" in plan and "LessThanOrEqual(x,4.0)" in plan
    plan = ranks.open_values(df, [("n", 3.0, 4.0)])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n,-2045)" in plan and "LessThanOrEqual(n,2052)" in plan


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert ranks.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


@pytest.mark.parametrize("number", [0, 3, 60, 137, 199, 200, 900])
def test_deep_pages(hot, number):
    ordered = hot.toPandas().sort_values(["key", "pos"])["pos"].tolist()
    got = ordering.page(hot, number, 30, ["key", "pos"], shallow=50)
    assert [r["pos"] for r in got.collect()] == ordered[number * 30 : number * 30 + 30]


def test_deep_page_with_nulls(spark):
    df = spark.createDataFrame([(i if i % 2 else None, i) for i in range(400)], "a int, b int")
    want = [tuple(r) for r in df.orderBy("a", "b").collect()][210:220]
    assert rows(ordering.page(df, 21, 10, ["a", "b"], shallow=20)) == want


def test_text_order_pages(hot):
    ordered = [r["pos"] for r in hot.orderBy("txt", "pos").collect()]
    got = ordering.page(hot, 100, 30, ["txt", "pos"], shallow=50)
    assert [r["pos"] for r in got.collect()] == ordered[3000:3030]


def limits(df):
    """The limits of all TakeOrderedAndProject nodes of a plan."""
    return [int(n) for n in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", df._jdf.queryExecution().toString())]


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "timestamp_ntz", "decimal(20,3)", "double", "binary", "boolean"])
def test_deep_pages_by_any_type(spark, kind):
    """A third of the rows have one value, a tenth have none; tasks keep few rows."""
    value = {
        "date": "date_add(DATE'2024-01-01', CAST(id % 400 AS INT))",
        "timestamp": "TIMESTAMP'2024-10-27 00:00:00' + make_dt_interval(0, 0, CAST(id % 997 AS INT), 0.000001)",
        "timestamp_ntz": "TIMESTAMP_NTZ'2024-10-27 00:00:00' + make_dt_interval(0, 0, CAST(id % 997 AS INT), 0.000001)",
        "binary": "CAST(CAST(id % 900 AS STRING) AS BINARY)",
        "double": "CASE WHEN id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE id / 3.0 END",
        "boolean": "id % 2 = 0",
    }.get(kind, f"CAST(id % 900 AS {kind})")
    df = spark.range(5000).selectExpr(
        f"CAST(CASE WHEN id % 10 = 1 THEN NULL WHEN id % 3 = 0 THEN {value.replace('id ', '(id * 0 + 6) ')} ELSE {value} END AS {kind}) AS k",
        "id AS `i.d`",
    ).repartition(7)
    ordered = [r["i.d"] for r in df.orderBy("k", "`i.d`").collect()]
    for number in (3, 40, 250, 333, 499):
        got = ordering.page(df, number, 10, ["k", "i.d"], shallow=150)
        assert [r["i.d"] for r in got.collect()] == ordered[number * 10 : number * 10 + 10]
        assert limits(got) and max(limits(got)) <= 160
    assert ordering.page(df, 900, 10, ["k", "i.d"], shallow=150).collect() == []


def test_page_among_equal_rows(spark):
    df = spark.range(1000).selectExpr("1 AS k", "id")
    assert ordering.page(df, 30, 10, ["k"], shallow=50).count() == 10


def test_sort_with_nulls(spark):
    df = spark.createDataFrame([(2, "b"), (None, "a"), (1, "c"), (2, "a")], "x int, y string")
    assert rows(ordering.sort_nulls_last(df, "x")) == [(1, "c"), (2, "a"), (2, "b"), (None, "a")]
    assert rows(ordering.sort_nulls_last(df, "x", "desc")) == [(2, "a"), (2, "b"), (1, "c"), (None, "a")]
