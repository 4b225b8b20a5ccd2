"""Readers, writers and loads on files."""

import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarnlake.checks.files import _workbook
from tarnlake.operators.enrich import tool_named
from tarnlake.plans import catalog, loads
from tarnlake.sources import files, readers, writers, xlsx


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def database(spark, tmp_path):
    name = "db_" + tmp_path.name.replace("-", "_").replace(".", "_").lower()
    writers.use_database(spark, name, str(tmp_path / "db"))
    return name


def test_detect_format():
    assert readers.detect_format("s3://b/k/a.CSV") == "csv"
    assert readers.detect_format("a.xlsm") == "excel"
    for bad in ("a.pdf", "plain"):
        with pytest.raises(ValueError):
            readers.detect_format(bad)


def test_csv_and_preview(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,name,pay\n1,A,1.5\n2,B,\n3,,2\n")
    df = readers.read_any(spark, str(path))
    assert df.dtypes == [("id", "int"), ("name", "string"), ("pay", "double")]
    assert readers.preview_file(spark, str(path), 2).count() == 2
    typed = readers.read_csv(spark, str(path), "id bigint, name string, pay string")
    assert dict(typed.dtypes)["pay"] == "string"


def test_json_array_and_lines(spark, tmp_path):
    doc, lines = tmp_path / "a.json", tmp_path / "b.jsonl"
    doc.write_text(json.dumps([{"a": 1, "b": {"c": "x"}}, {"a": 2}], indent=1))
    lines.write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert readers.read_any(spark, str(doc)).count() == 2
    assert readers.read_jsonl(spark, str(lines), 2).count() == 2
    assert readers.read_any(spark, str(lines)).count() == 3


def test_parquet_reads_every_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(4).write.parquet(path)
    assert readers.read_parquet(spark, path).count() == 100
    listed = files.table_files(spark.read.parquet(path))
    assert listed.count() == 4 and listed.agg(F.sum("rows")).first()[0] == 100


def test_validate_file(spark, tmp_path):
    good, bad = tmp_path / "g.csv", tmp_path / "b.json"
    good.write_text("a,b\n1,2\n")
    bad.write_text('{"a": ')
    ok = readers.validate_file(spark, str(good)).first()
    assert ok["is_valid"] and json.loads(ok["sample"]) == [{"a": 1, "b": 2}]
    broken = readers.validate_file(spark, str(bad)).first()
    assert not broken["is_valid"] and broken["error"]
    assert readers.validate_file(spark, "x.pdf").first()["file_type"] == "unknown"
    assert not readers.validate_file(spark, str(tmp_path / "none.csv")).first()["is_valid"]


def test_malformed_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('Name,Lead(s),HQ\nA,B,Austin, TX\nC,D,"Austin, TX"\n')
    kept = spark.read.option("header", True).csv(str(path))
    assert rows(kept)[1] == ("C", "D", "Austin, TX")
    assert not readers.validate_file(spark, str(path)).first()["is_valid"]


def _typed_workbook() -> bytes:
    """Shared strings, numbers, booleans, gaps and two sheets."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="People" sheetId="1" r:id="r1"/>'
            '<sheet name="More" sheetId="2" r:id="r2"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="r1" Type="t" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="r2" Type="t" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        )
        z.writestr(
            "xl/sharedStrings.xml",
            f"<sst {main}><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>ok</t></si>"
            "<si><t>Ann</t></si></sst>",
        )
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c>'
            '<c r="C1" t="s"><v>2</v></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>3</v></c>'
            '<c r="C2" t="b"><v>1</v></c></row><row r="4"><c r="A4"><v>2.5</v></c><c r="C4" t="b"><v>0</v></c></row>'
            "</sheetData></worksheet>",
        )
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData/></worksheet>")
    return out.getvalue()


def test_excel(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    path.write_bytes(_typed_workbook())
    df = readers.read_any(spark, str(path))
    assert df.columns == ["id", "name", "ok"]
    assert sorted(rows(df)) == [("1", "Ann", "true"), ("2.5", None, "false")]
    cells = xlsx.unpack(spark.read.format("binaryFile").load(str(path)))
    described = xlsx.describe_sheets(cells).collect()
    assert [(r["sheet"], r["header"], r["row_count"], r["column_count"]) for r in described] == [
        ("People", ["id", "name", "ok"], 2, 3)
    ]
    assert xlsx._column_number("AB7") == 27


def test_number_formats():
    shows = {
        "d": ["yyyy-mm-dd", "[$-409]d mmm yyyy;@", "mmm-yy", '"on" dd.mm.yy', "m"],
        "t": ["dd/mm/yyyy hh:mm", "yyyy\\-mm\\-dd\\ h:mm AM/PM"],
        "h": ["h:mm AM/PM", "[h]:mm:ss", "mm:ss.0", "hh:mm"],
        "n": ["General", "0.00", "[Red]0.00", "[White]#,##0", '0 "days"', "0.00E+00", "# ?/?", "0\\d", "_-* #,##0_-", "[Blue]General"],
    }
    for kind, codes in shows.items():
        assert {c: xlsx.shown_as(c) for c in codes} == dict.fromkeys(codes, kind)


def test_moments():
    assert xlsx.moment(45296.0, "d", False) == ("2024-01-05", "d")
    assert xlsx.moment(45296.75, "d", False) == ("2024-01-05 18:00:00", "t")
    assert xlsx.moment(1.0, "d", False) == ("1900-01-01", "d")
    assert xlsx.moment(61.0, "d", False) == ("1900-03-01", "d")
    assert xlsx.moment(43834.0, "d", True) == ("2024-01-05", "d")
    assert xlsx.moment(0.5, "h", False) == ("12:00:00", "s") and xlsx.moment(1.5, "h", False) == ("36:00:00", "s")
    assert xlsx.moment(-3.0, "d", False) == ("-3", "w") and xlsx.moment(1e9, "t", False) == ("1000000000", "w")


def test_excel_dates_and_types(spark, tmp_path):
    import datetime

    day = datetime.date(2024, 1, 5)
    path = tmp_path / "dates.xlsx"
    path.write_bytes(_workbook(["day", "n", "mixed"], [(day, 1, day), (day, 2.5, "soon"), (day, 3, 7)], ["x"]))
    plain = readers.read_any(spark, str(path))
    assert dict(plain.dtypes) == {"day": "date", "n": "string", "mixed": "string"}
    assert rows(plain) == [(day, "1", "2024-01-05"), (day, "2.5", "soon"), (day, "3", "7")]
    assert dict(readers.read_excel(spark, str(path), typed=True).dtypes) == {"day": "date", "n": "double", "mixed": "string"}
    assert rows(readers.read_excel(spark, str(path), "Notes")) == [("x",)]


def test_excel_in_many_batches(spark, tmp_path, monkeypatch):
    values = [(i, f"n{i} <&>") for i in range(5000)]
    (tmp_path / "big.xlsx").write_bytes(_workbook(["id", "name"], values, []))
    df = readers.read_excel(spark, str(tmp_path / "big.xlsx"))
    assert df.count() == 5000
    assert df.filter("id = '4321'").first()["name"] == "n4321 <&>"


def test_avro_without_module(spark, tmp_path):
    with pytest.raises(RuntimeError):
        readers.read_avro(spark, str(tmp_path))


def test_discover(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("a.csv", "b.JSON", "c.txt", "sub/d.parquet"):
        (tmp_path / "in" / name).write_text("x")
    got = {(r["name"], r["format"], r["size"]) for r in files.discover_files(spark, str(tmp_path / "in")).collect()}
    assert got == {("a.csv", "csv", 1), ("b.JSON", "json", 1), ("d.parquet", "parquet", 1)}
    only = files.discover_files(spark, str(tmp_path / "in"), [".csv"])
    assert [r["name"] for r in only.collect()] == ["a.csv"]
    assert files.file_digests(spark, str(tmp_path / "in" / "a.csv")).first()["md5"] == "9dd4e461268c8034f5c8564e155c67a6"


def test_convert_and_export(spark, tmp_path):
    source = tmp_path / "s.csv"
    source.write_text('id,t\n1,"a, ""q"""\n2,\n')
    for target in ("parquet", "orc", "json", "csv"):
        out = writers.convert(spark, str(source), str(tmp_path / target), target)
        assert out.count() == 2
    df = readers.read_csv(spark, str(source), escape='"')
    writers.export_csv(df, str(tmp_path / "export"))
    assert rows(readers.read_csv(spark, str(tmp_path / "export"), escape='"')) == rows(df)


def test_staged_overwrite_keeps_target_on_failure(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "staging")
    spark.range(10).write.parquet(path)
    bad = spark.read.parquet(path).selectExpr("assert_true(id < 5) AS a", "id")
    with pytest.raises(Exception):
        writers.staged_overwrite(bad, path, staging)
    assert spark.read.parquet(path).count() == 10
    out = writers.staged_overwrite(spark.read.parquet(path).filter("id < 5"), path, staging)
    assert out.count() == 5
    assert not (tmp_path / "staging").exists()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_replaced_table_survives_a_failure(spark, tmp_path, database, monkeypatch, keys):
    """What fails after the write leaves the old rows, and the new files go; then the table is replaced with one write."""
    df = spark.range(20).selectExpr("id", "CONCAT('a b', id % 2) AS k")
    columns = {"id": "bigint", "k": "string"}
    writers.create_or_update_table(spark, database, "r", columns, location=str(tmp_path / "r0"), partitions=keys)
    writers.write_partitioned(df, str(tmp_path / "r0"), keys) if keys else writers.append(df, database, "r")
    if keys:
        spark.catalog.recoverPartitions(f"{database}.r")
    table = lambda: sorted((r["id"], r["k"]) for r in spark.table(f"{database}.r").collect())
    before = table()
    half = spark.table(f"{database}.r").filter("id < 10").selectExpr("id", "id * 2 AS twice", "k")
    point, calls = writers._point, []

    def fails(*args):
        calls.append(args)
        point(*args)
        if len(calls) == 1:
            raise OSError("lost")

    monkeypatch.setattr(writers, "_point", fails)
    with pytest.raises(OSError, match="lost"):
        writers.replace_table(half, database, "r", str(tmp_path / "versions"))
    assert table() == before and not list((tmp_path / "versions").iterdir())
    after = writers.replace_table(half, database, "r", str(tmp_path / "versions"))
    assert sorted((r["id"], r["twice"], r["k"]) for r in after.collect()) == [(i, 2 * i, f"a b{i % 2}") for i in range(10)]
    assert len(list((tmp_path / "versions").iterdir())) == 1 and not (tmp_path / "r0").exists()
    assert [c.name for c in spark.catalog.listColumns(f"{database}.r") if c.isPartition] == keys


def test_staged_overwrite_puts_the_target_back(spark, tmp_path, monkeypatch):
    path, staging = str(tmp_path / "t"), str(tmp_path / "staging")
    spark.range(10).write.parquet(path)
    rename = writers._rename
    monkeypatch.setattr(writers, "_rename", lambda s, a, b: a != staging and rename(s, a, b))
    with pytest.raises(OSError, match="cannot rename"):
        writers.staged_overwrite(spark.read.parquet(path).filter("id < 5"), path, staging)
    assert spark.read.parquet(path).count() == 10


def test_dynamic_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(100).selectExpr("id", "id % 3 AS k")
    writers.write_partitioned(df, path, ["k"])
    writers.write_partitioned(df.filter("k = 1 AND id < 10"), path, ["k"], dynamic=True)
    got = dict(rows(spark.read.parquet(path).groupBy("k").count()))
    assert got == {0: 34, 1: 3, 2: 33}


def test_table_life(spark, tmp_path, database):
    columns = {"id": "int64", "day": "date"}
    location = str(tmp_path / "life")
    assert writers.create_or_update_table(
        spark, database, "life", columns, location=location, comments={"id": "it's the key"}
    ) == "created"
    writers.append(spark.sql("SELECT DATE'2024-01-01' AS day, 1 AS id"), database, "life")
    assert writers.create_or_update_table(spark, database, "life", {"ID": "string", "note": "string"}) == "updated"
    assert rows(spark.table(f"{database}.life")) == [(1, datetime(2024, 1, 1).date(), None)]
    inventory = catalog.column_inventory(spark, database).collect()
    assert [(r["column"], r["type"], r["comment"]) for r in inventory] == [
        ("id", "bigint", "it's the key"), ("day", "date", None), ("note", "string", None),
    ]
    assert all(r["location"].endswith("/life") for r in inventory)
    before = catalog.version_of(spark, database, "life")
    kept = before.collect()
    writers.add_table_columns(spark, database, "life", {"more": "double"})
    assert catalog.version_of(spark, database, "life").collect() != kept
    assert readers.table(spark, database, "life", 1).count() == 1
    names = catalog.infer_schema(spark.table(f"{database}.life")).collect()
    assert (names[0]["name"], names[0]["type"], names[0]["sample"]) == ("id", "bigint", "1")


def test_partitioned_table(spark, tmp_path, database):
    source = tmp_path / "in.csv"
    source.write_text("a,b\n1,x\n2,y\n")
    table = loads.ingest_file(
        spark, str(source), database, "t", "u1", str(tmp_path / "out"), now=datetime(2024, 5, 6, 7)
    )
    assert table.filter("user_id = 'u1' AND year = 2024 AND month = 5 AND day = 6").count() == 2
    assert (tmp_path / "out" / "user_id=u1" / "year=2024").exists()


def test_load_twice(spark, tmp_path, database):
    source = tmp_path / "in.csv"
    source.write_text("a,b\n1,x\n2,y\n")
    first = loads.load_file(spark, str(source), database, "l", str(tmp_path / "l")).first()
    second = loads.load_file(spark, str(source), database, "l").first()
    assert (first["rows_before"], first["rows_after"], first["complete"]) == (0, 2, True)
    assert (second["rows_before"], second["rows_after"], second["complete"]) == (2, 4, True)


def test_load_prefix_files(spark, tmp_path, database):
    base = tmp_path / "in"
    base.mkdir()
    (base / "People.v1.csv").write_text("id,name\n1,A\n")
    (base / "People.v2.csv").write_text("name,age\nB,3\n")
    (base / "pets.json").write_text('[{"n": "cat"}, {"n": "dog"}]')
    report = {r["table_name"]: r for r in loads.load_prefix(spark, str(base), database, str(tmp_path / "out")).collect()}
    assert (report["people"]["column_count"], report["people"]["row_count"]) == (3, 2)
    assert report["pets"]["row_count"] == 2


def test_load_prefix_nested_and_mixed_folders(spark, tmp_path, database):
    base = tmp_path / "in"
    for folder in ("sheets/2024/01", "people/old"):
        (base / folder).mkdir(parents=True)
    (base / "sheets/top.xlsx").write_bytes(_typed_workbook())
    (base / "sheets/2024/01/more.XLSX").write_bytes(_typed_workbook())
    (base / "sheets/2024/notes.csv").write_text("note\nkeep\n")
    (base / "people/a.csv").write_text("id,name\n1,A\n")
    (base / "people/B.CSV").write_text("id,name\n2,B\n")
    (base / "people/old/c.Json").write_text('{"id": 3, "name": "C"}\n')
    loads.load_prefix(spark, str(base), database, str(tmp_path / "out")).collect()
    people = spark.table(f"{database}.people").collect()
    assert sorted((r["id"], r["name"]) for r in people) == [(1, "A"), (2, "B"), (3, "C")]
    one = readers.read_excel(spark, str(base / "sheets/top.xlsx"))
    sheets = spark.table(f"{database}.sheets")
    assert sheets.filter("note IS NULL").count() == 2 * one.count() > 0
    assert [r["note"] for r in sheets.filter("note IS NOT NULL").collect()] == ["keep"]


def test_rejected_load(spark, tmp_path, database):
    df = spark.createDataFrame([(1, None), (2, "x")], "id bigint, name string")
    contract = [{"name": "id", "nullable": False}, {"name": "name", "nullable": False}]
    gate = loads.run_etl(spark, df, contract, {"completeness": 0.5}, database, "target", str(tmp_path / "s")).first()
    assert (gate["status"], gate["issues"], gate["loaded_rows"]) == ("rejected", 1, 0)
    assert not spark.catalog.tableExists(f"{database}.target")


def test_upload(spark, tmp_path, database):
    path = tmp_path / "book.xlsx"
    path.write_bytes(_typed_workbook())
    table, record = loads.upload(spark, str(path), database, "up", str(tmp_path / "up"))
    assert table.count() == 2 and record["columns"][1]["type"] == "string"


def test_enriched_table(spark, tmp_path, database):
    path = str(tmp_path / "companies")
    df = spark.createDataFrame([(1, "uses an llm"), (2, "  "), (3, "bakery")], "id int, about string")
    writers.write_table(df, database, "companies", path)
    out = loads.enrich_table(
        spark, database, "companies", "ai_company_classifier", ["about"], path, str(tmp_path / "st")
    )
    assert sorted((r["id"], r["about_classification"]) for r in out.collect()) == [(1, "AI"), (3, "Non-AI")]
    assert set(tool_named("ai_company_classifier")["output"]) == {"classification", "confidence", "reasoning"}


def test_store_doc(spark, tmp_path):
    path = str(tmp_path / "docs")
    for i in range(2):
        writers.store_doc(spark, path, "metrics", "t", {"score": i}, datetime(2024, 1, 1 + i))
    newest = spark.read.parquet(path).orderBy(F.desc("at")).first()
    assert json.loads(newest["doc"]) == {"score": 1} and newest["kind"] == "metrics"
