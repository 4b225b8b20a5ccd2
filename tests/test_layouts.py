"""Files of one table that differ: headers, formats, types, folders and names."""

import datetime as dt
import os

import pytest
from pyspark.sql import types as T

from tarnlake.operators import lattice, sets
from tarnlake.plans import loads
from tarnlake.sources import layouts


@pytest.fixture
def base(spark, tmp_path):
    spark.sql("CREATE DATABASE layouts_lake")
    yield tmp_path
    spark.sql("DROP DATABASE layouts_lake CASCADE")


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        file.write(content)


def load(spark, base):
    report = loads.load_prefix(spark, f"{base}/in", "layouts_lake", f"{base}/out")
    return {r["table_name"]: r["row_count"] for r in report.collect()}


def rows(spark, table, *columns):
    return sorted((tuple(r) for r in spark.table(f"layouts_lake.{table}").select(*columns or "*").collect()), key=str)


def types(spark, table):
    return dict(spark.table(f"layouts_lake.{table}").dtypes)


def test_columns_in_another_order(spark, base):
    put(f"{base}/in/t/a.csv", "id,name\n1,x\n")
    put(f"{base}/in/t/b.csv", "name,id\ny,2\n")
    put(f"{base}/in/t/c.csv", "\n\nNAME,more\nz,3.5\n")
    put(f"{base}/in/t/empty.csv", "")
    assert load(spark, base) == {"t": 3}
    assert rows(spark, "t", "id", "name", "more") == [(1, "x", None), (2, "y", None), (None, "z", 3.5)]


def test_json_documents_and_lines_in_one_folder(spark, base):
    put(f"{base}/in/t/document.json", '{\n  "id": 1,\n  "tags": ["a"]\n}\n')
    put(f"{base}/in/t/array.json", '[\n{"id": 2},\n{"id": 3}\n]\n')
    put(f"{base}/in/t/lines.json", '{"id": 4}\n{"id": 5.5}\n')
    put(f"{base}/in/t/one.json", '[{"id": 6}, {"id": 7}]')
    put(f"{base}/in/t/more.ndjson", '{"id": 8}\n')
    assert load(spark, base) == {"t": 8}
    assert rows(spark, "t", "id") == [(float(i) if i != 5 else 5.5,) for i in range(1, 9)]
    assert types(spark, "t") == {"id": "double", "tags": "array<string>"}


@pytest.mark.parametrize("content", ['{"id": 1}\n{"id": \n', '{\n "id": 1\n', "nothing\n"])
def test_a_corrupt_record_fails_the_load(spark, base, content):
    put(f"{base}/in/t/a.json", content)
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        load(spark, base)


def test_partition_folders_are_columns(spark, base):
    put(f"{base}/in/t/user_id=u1/day=2024-01-05/a.csv", "v\n1\n")
    put(f"{base}/in/t/deep/user_id=a%3Ab+c/day=2024-01-06/b.csv", "v\n2\n")
    put(f"{base}/in/t/user_id=__HIVE_DEFAULT_PARTITION__/day=2024-01-07/c.csv", "v\n3\n")
    put(f"{base}/in/t/plain.csv", "v\n4\n")
    assert load(spark, base) == {"t": 4}
    day = lambda n: dt.date(2024, 1, n)
    assert rows(spark, "t", "v", "user_id", "day") == [
        (1, "u1", day(5)), (2, "a:b+c", day(6)), (3, None, day(7)), (4, None, None)]


def test_a_written_table_is_loaded_whole(spark, base):
    put(f"{base}/x.csv", "id,name\n1,a\n")
    for user in ("u1", "u2"):
        loads.ingest_file(spark, f"{base}/x.csv", "layouts_lake", "w", user, f"{base}/in/copies")
    assert load(spark, base) == {"copies": 2}
    assert rows(spark, "copies", "id", "name", "user_id") == [(1, "a", "u1"), (1, "a", "u2")]
    assert types(spark, "copies")["year"] == "bigint"


def test_differing_types_widen(spark, base):
    put(f"{base}/in/c.csv", "id,n,when,flag\n1,1,2024-01-05,true\n")
    put(f"{base}/in/c.2024.csv", "id,n,when,flag\nK7,2.50,soon,3\n007,1e3,2024-01-06,false\n")
    put(f"{base}/in/c.more/x.jsonl", '{"id": 9007199254740993, "n": 7, "when": 1.50}\n')
    assert load(spark, base) == {"c": 4}
    assert types(spark, "c") == {"id": "string", "n": "double", "when": "string", "flag": "string"}
    assert rows(spark, "c") == sorted(
        [("1", 1.0, "2024-01-05", "true"), ("K7", 2.5, "soon", "3"), ("007", 1000.0, "2024-01-06", "false"),
         ("9007199254740993", 7.0, "1.50", None)], key=str)


def test_parquet_files_without_a_common_schema(spark, base):
    for i, columns in enumerate(("1 AS id", "CAST(2 AS BIGINT) AS id", "'x' AS id, 3 AS n", "named_struct('a', 1) AS s", "named_struct('b', 'z') AS s")):
        spark.sql(f"SELECT {columns}").write.parquet(f"{base}/in/t/p{i}")
    assert load(spark, base) == {"t": 5}
    assert types(spark, "t") == {"id": "string", "n": "int", "s": "struct<a:int,b:string>"}
    assert rows(spark, "t", "id", "n", "s.a", "s.b") == sorted(
        [("1", None, None, None), ("2", None, None, None), ("x", 3, None, None), (None, None, 1, None), (None, None, None, "z")], key=str)


def test_names_are_no_wildcards(spark, base):
    put(f"{base}/in/b[1].csv", "id\n1\n")
    put(f"{base}/in/b1.csv", "id\n2\n")
    put(f"{base}/in/star {{x}} 50%/a*.csv", "id\n3\n")
    put(f"{base}/in/star {{x}} 50%/ab+é.csv", "id\n4\n")
    assert load(spark, base) == {"b_1": 1, "b1": 1, "star_x_50": 2}
    assert rows(spark, "b_1") == [(1,)] and rows(spark, "star_x_50") == [(3,), (4,)]


def test_many_small_files_need_few_jobs(spark, base):
    for i in range(300):
        put(f"{base}/in/t/{i}.csv", f"id,name\n{i},x\n" if i % 2 else f"name,id\nx,{i}\n")
    spark.sparkContext.setJobGroup("many", "many")
    try:
        frame = layouts.read_tables(spark, f"{base}/in")["t"]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("many")) < 20
    assert frame.count() == 300 and frame.agg({"id": "sum"}).first()[0] == sum(range(300))


def test_nothing_to_load(spark, base):
    put(f"{base}/in/t/notes.txt", "not a table")
    put(f"{base}/in/empty.csv", "")
    assert load(spark, base) == {}


def test_lattice():
    kind = lambda a, b: lattice.widened(a, b).simpleString()
    whole, real, text, day = T.LongType(), T.DoubleType(), T.StringType(), T.DateType()
    assert [kind(whole, real), kind(whole, text), kind(day, text), kind(day, T.TimestampType())] == [
        "double", "string", "string", "timestamp"]
    assert kind(T.IntegerType(), whole) == "bigint" and kind(T.BooleanType(), whole) == "string"
    assert kind(T.DecimalType(20, 0), T.DecimalType(10, 4)) == "decimal(24,4)"
    assert kind(T.DecimalType(38, 0), T.DecimalType(10, 4)) == "double"
    assert kind(T.ArrayType(whole), T.ArrayType(text)) == "array<string>"
    assert kind(T.ArrayType(whole), whole) == "string" and kind(T.NullType(), day) == "date"


def test_concatenation_of_differing_types(spark):
    """Nested fields by name, numbers beside texts, dates beside times, a column only one side has."""
    left = spark.sql("SELECT 1 AS id, DATE'2024-01-05' AS at, named_struct('a', 1, 'b', 'x') AS s, array(1) AS l, map('k', 1) AS m, 1.5BD AS d")
    right = spark.sql("SELECT 'K7' AS ID, TIMESTAMP'2024-01-06 10:00:00' AS at, named_struct('b', 7, 'c', 2D) AS s, array('z') AS l, map('k', 2L) AS m, 2 AS d, true AS only")
    both = sets.concatenate([left, right])
    assert dict(both.dtypes) == {"id": "string", "at": "timestamp", "s": "struct<a:int,b:string,c:double>", "l": "array<string>",
                                 "m": "map<string,bigint>", "d": "decimal(21,1)", "only": "boolean"}
    assert [(r["id"], str(r["at"]), tuple(r["s"]), r["l"], r["m"], float(r["d"]), r["only"]) for r in both.collect()] == [
        ("1", "2024-01-05 00:00:00", (1, "x", None), ["1"], {"k": 1}, 1.5, None),
        ("K7", "2024-01-06 10:00:00", (None, "7", 2.0), ["z"], {"k": 2}, 2.0, True)]
    nested = sets.concatenate([spark.sql("SELECT array(1, 2) AS x"), spark.sql("SELECT 'text' AS x")])
    assert [r[0] for r in nested.collect()] == ["[1,2]", "text"]


@pytest.mark.parametrize("limit", [layouts.WHOLE_BYTES, 100])
def test_documents_are_read_once(spark, base, monkeypatch, limit):
    """Numbers read as text keep their digits, and the file is not read again for each; documents beyond the limit are streamed."""
    monkeypatch.setattr(layouts, "WHOLE_BYTES", limit)
    texts = ["-0", "1.50", "12345678901234567890.10e5", *map(str, range(3000))]
    records = ",\n".join(f'{{"id": {t}, "n": {{"a" : 1.0}}}}' for t in texts)
    put(f"{base}/in/t/a.json", f"[\n{records}\n]\n")
    put(f"{base}/in/t/b.json", '{\n "id": "x",\n "n": "y"\n}\n')
    put(f"{base}/in/t/c.csv", "document\nz\n")
    put(f"{base}/in/t/d.json", '[\n{"id": 9.0}, {"id": 9.00}\n]\n')
    (table,) = layouts.read_tables(spark, f"{base}/in").values()
    found = sorted((r["id"], r["n"]) for r in table.filter("document IS NULL").fillna("none").collect())
    assert found == sorted([*((t, '{"a" : 1.0}') for t in texts), ("x", "y"), ("9.0", "none"), ("9.00", "none")])
    files = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    read = lambda: sum(s.getBytesRead() for s in files if s.getScheme() == "file")
    before = read()
    table.write.format("noop").mode("overwrite").save()
    if limit > 100:  # of a stream, some kilobytes for each number
        assert read() - before < 20 * len(records)
