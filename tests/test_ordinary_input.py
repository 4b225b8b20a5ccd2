"""Ordinary input that is not friendly: nested folders, several users, nulls in orders, exact numbers."""

import math
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tarnlake.functions import json, text, times
from tarnlake.operators import aggregates, cleaning, joins, keys, quality, sets, windows
from tarnlake.plans import loads
from tarnlake.sources import readers, writers


@pytest.fixture
def lake_db(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS odd_lake")
    yield "odd_lake"
    spark.sql("DROP DATABASE odd_lake CASCADE")


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        file.write(content)


def test_nested_and_mixed_folders(spark, tmp_path, lake_db):
    put(f"{tmp_path}/in/customers/top.csv", "id,name\n1,a\n")
    put(f"{tmp_path}/in/customers/2024/01/a.csv", "id,name\n2,b\n3,c\n")
    put(f"{tmp_path}/in/mixed/x.csv", "id,name\n1,a\n")
    put(f"{tmp_path}/in/mixed/deep/y.jsonl", '{"id": 2, "name": "b"}\n')
    loads.load_prefix(spark, f"{tmp_path}/in", lake_db, f"{tmp_path}/out").collect()
    assert sorted(map(tuple, spark.table("odd_lake.customers").select("id", "name").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted((int(r["id"]), r["name"]) for r in spark.table("odd_lake.mixed").collect()) == [(1, "a"), (2, "b")]


def test_two_users_and_a_tool_on_their_table(spark, tmp_path, lake_db):
    put(f"{tmp_path}/a.csv", "id,review\n1,great food\n2,terrible service\n")
    put(f"{tmp_path}/b.csv", "id,review\n3,good\n")
    for user, name in (("u7", "a"), ("u8", "b")):
        loads.ingest_file(spark, f"{tmp_path}/{name}.csv", lake_db, "reviews", user, f"{tmp_path}/reviews")
    rows = spark.table("odd_lake.reviews").select("id", "user_id").collect()
    assert sorted(map(tuple, rows)) == [(1, "u7"), (2, "u7"), (3, "u8")]
    writers.staged_overwrite(spark.read.parquet(f"{tmp_path}/reviews"), f"{tmp_path}/reviews", f"{tmp_path}/staging", loads.PARTITION_KEYS)
    spark.catalog.recoverPartitions("odd_lake.reviews")
    spark.catalog.refreshTable("odd_lake.reviews")
    assert spark.table("odd_lake.reviews").count() == 3
    assert not os.path.exists(f"{tmp_path}/staging")
    assert os.path.isdir(f"{tmp_path}/reviews/user_id=u7")


def test_null_orders_lose_no_row(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", None, 2), ("b", 3, 4)], "k string, v int, z int")
    assert sorted(map(tuple, windows.latest_version(rows, "k", "v").collect())) == [("a", None, 1), ("b", 3, 4)]
    assert sorted(map(tuple, quality.latest_quality(rows, "k", "v").collect())) == [("a", None, 1), ("b", 3, 4)]
    kept = sets.drop_duplicates(spark.createDataFrame([("a", None), ("a", 2), ("b", None)], "k string, v int"), "v")
    assert sorted(map(tuple, kept.collect())) == [("a", 2), ("b", None)]


def test_keys_of_maps_and_times(spark):
    twice = spark.sql("SELECT * FROM VALUES (map('a', 1, 'b', 2), 'x'), (map('b', 2, 'a', 1), 'x') AS v(m, t)")
    assert sets.drop_duplicates(twice).count() == 1
    near = spark.sql("SELECT struct(t) AS s FROM VALUES (timestamp'2024-01-01 00:00:00.000001'), (timestamp'2024-01-01 00:00:00.000002') AS v(t)")
    assert sets.drop_duplicates(near).count() == 2
    assert near.select(text.md5_of_fields(F.col("s")).alias("d")).distinct().count() == 2
    inside = spark.sql("SELECT struct(m) AS s FROM VALUES (map('a', 1, 'b', 2)), (map('b', 2, 'a', 1)) AS v(m)")
    assert inside.selectExpr(*[f"{k} AS k" for k in keys.row_keys(inside)]).distinct().count() == 1


def test_exact_numbers(spark):
    df = spark.createDataFrame([("9007199254740993",), ("7",), (None,)], "n string")
    assert [r[0] for r in cleaning.convert_types(df, ["n"]).collect()] == [9007199254740993, 7, 0]
    df = spark.createDataFrame([("1e30",), ("7",), (None,)], "n string")
    assert [r[0] for r in cleaning.convert_types(df, ["n"]).collect()] == [1e30, 7.0, None]


def test_a_failing_job_is_not_a_step_that_does_not_apply(spark, monkeypatch):
    def fails(df, columns, parameters):
        raise PySparkException("the job failed")

    monkeypatch.setitem(cleaning.STEPS, "convert_types", fails)
    step = {"strategy": "convert_types", "columns": ["id"], "parameters": {}, "confidence": 0.9, "description": "numbers"}
    assert cleaning.step_problem(step) is None
    with pytest.raises(PySparkException, match="the job failed"):
        cleaning.apply_cleaning(spark.range(1), [step], defaults=False)


def test_one_job_decides_for_all_conversions(spark, monkeypatch):
    """Columns that an earlier step changes are decided for after it; a step that does not apply spoils no other."""
    df = spark.createDataFrame([("1", "1.5", "x", None, [1]), ("2", "7", "8", "3", [2])], "a string, b string, c string, d string, e array<int>")
    step = lambda strategy, *columns, **parameters: {
        "strategy": strategy, "columns": list(columns), "parameters": parameters, "confidence": 0.9, "description": "s"
    }
    calls = []
    monkeypatch.setattr(cleaning, "whole_columns", lambda d, c, f=cleaning.whole_columns: calls.append(sorted(c)) or f(d, c))
    plan = [step("convert_types", "a", "b"), step("handle_nulls", "d", fill_value="0.5"), step("convert_types", "d"), step("convert_types", "c")]
    out, applied = cleaning.apply_cleaning(df, plan, defaults=False)
    assert len(applied) == 4 and [c for c in calls if c] == [["a", "b", "c"], ["d"]]
    assert [tuple(r)[:4] for r in out.collect()] == [(1, 1.5, 0, 0.5), (2, 7.0, 8, 3.0)]
    out, applied = cleaning.apply_cleaning(df, [step("convert_types", "e"), step("convert_types", "a")], defaults=False)
    assert [a["columns"] for a in applied] in ([["a"]], [["e"], ["a"]]) and dict(out.dtypes)["a"] == "bigint"


def test_dates(spark):
    df = spark.createDataFrame([("1/5/2024",), ("5.1.2024",), ("12:30",), ("2024-01-05",)], "d string")
    got = [str(r[0]) for r in df.select(times.parse_time(F.col("d"))).collect()]
    assert got == ["2024-01-05 00:00:00", "2024-01-05 00:00:00", "None", "2024-01-05 00:00:00"]


def test_join_of_tables_that_share_a_name(spark):
    people = spark.createDataFrame([(1, "Ann", 10)], "id long, name string, department_id long")
    departments = spark.createDataFrame([(10, "Ops")], "id long, name string")
    got = joins.inner_join(people, departments, "department_id", "id")
    assert got.columns == ["id", "name", "department_id", "name_right"]
    assert [tuple(r) for r in got.collect()] == [(1, "Ann", 10, "Ops")]
    assert joins.inner_join(departments, departments, "id", "id").columns == ["id", "name", "name_right"]


def test_quartiles_with_infinities(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, math.inf, -math.inf, 1.7e308, -1.7e308)], "x double")
    row = aggregates.describe(df, ["x"]).collect()
    assert "2.0" in str(row) and "inf" in str(row)


def test_numbers_in_a_hot_key_with_an_outlier(spark):
    df = spark.range(5000).selectExpr("'k' AS key", "if(id = 0, -1000000000, id) AS pos")
    got = windows.numbered(df, "key", "pos").orderBy("pos").collect()
    assert [r["number"] for r in got] == list(range(1, 5001))
    words = spark.createDataFrame([("k", "b"), ("k", "a"), (None, "c")], "key string, pos string")
    got = windows.numbered(words, "key", "pos").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("k", "a", 1), ("k", "b", 2), (None, "c", 1)], key=str)


def test_lines_are_all_read_and_all_checked(spark, tmp_path):
    put(f"{tmp_path}/many.jsonl", "".join(f'{{"a": {i}}}\n' for i in range(1500)))
    assert readers.read_jsonl(spark, f"{tmp_path}/many.jsonl").count() == 1500
    put(f"{tmp_path}/bad.jsonl", '{"a": 1}\n' * 20 + "{bad\n")
    assert not readers.validate_file(spark, f"{tmp_path}/bad.jsonl").first()["is_valid"]
    assert readers.validate_file(spark, f"{tmp_path}/many.jsonl").first()["is_valid"]
    with pytest.raises(ValueError, match="not supported"):
        readers.detect_format("old.xls")


def test_repair_leaves_strings_alone(spark):
    broken = ['{"t": "at 10:05", k: 1}', '{"s": "a, b: c", k: 1}', '{"u": "is TRUE, .5 }{ 007", "v": "", k: None,}']
    df = spark.createDataFrame([(b,) for b in broken], "b string")
    assert [r[0] for r in df.select(json.repair_json(F.col("b"))).collect()] == [
        '{"k":1,"t":"at 10:05"}', '{"k":1,"s":"a, b: c"}', '{"k":null,"u":"is TRUE, .5 }{ 007","v":null}',
    ]


def test_dotted_names(spark):
    """Columns as flattening names them, in every operator that takes names."""
    df = spark.createDataFrame([("x", 1.0, "k1"), ("x", 3.0, "k2"), ("y", 5.0, "k1")], "`a.b` string, `v w` double, `key.id` string")
    other = spark.createDataFrame([("k1", 2.0), ("k1", 4.0)], "`other.id` string, `m.n` double")
    rows = lambda f: [tuple(r) for r in f.collect()]
    assert rows(aggregates.group_report(df, ["a.b"], "v w", "n.n", "av.g")) == [("x", 2, 2.0), ("y", 1, 5.0)]
    assert rows(aggregates.group_average(df, ["a.b"], "v w", "av.g", 3)) == [("y", 5.0)]
    assert sorted(rows(aggregates.distribution(df, "a.b"))) == [("x", 2), ("y", 1)]
    assert sorted(rows(aggregates.chart_query(df, "a.b", ["v w"], "max", "key.id"))) == [("x", "k1", 1.0), ("x", "k2", 3.0), ("y", "k1", 5.0)]
    assert rows(aggregates.validity_counts(df, "a.b", {}))[0] == (3, 2)
    assert rows(aggregates.null_percentage(df, "a.b"))[0][1] == 0
    assert rows(aggregates.column_statistic(df, "v w", "sum")) == [(9.0,)]
    report = joins.left_report(df, other, "key.id", "other.id", "m.n", ["a.b"], "n", "to.tal")
    assert rows(report) == [("x", 2, 6.0), ("y", 2, 6.0)]
    assert sorted(rows(joins.compare_columns(df, df.limit(0), ["a.b"]))) == [("x", "only_left"), ("y", "only_left")]
    assert rows(sets.schema_sets(df, df, "a.b")) == [("x", "common"), ("y", "common")]
