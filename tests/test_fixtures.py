"""Small tables with known answers."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tarnlake import types
from tarnlake.functions import json as js
from tarnlake.functions import repair, text
from tarnlake.operators import aggregates, cleaning, columns, contracts, enrich, filters, joins, quality
from tarnlake.operators.scorers import batch_category
from tarnlake.plans import catalog, reports


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def salaries(spark):
    return spark.createDataFrame(
        [
            (1, "John", "Engineering", 90000, "2022-01-01"),
            (2, "Jane", "Sales", 80000, "2021-06-15"),
            (3, "Bob", "Engineering", 110000, "2020-03-10"),
            (4, "Alice", "Marketing", 70000, "2023-01-20"),
            (5, "Charlie", "Sales", 85000, "2022-08-01"),
        ],
        "id bigint, name string, department string, salary bigint, hire_date string",
    )


def test_salary_bands(salaries):
    band = columns.bucketize(F.col("salary"), [100000, 80000], ["High", "Medium", "Low"])
    out = (
        salaries.withColumn("band", band)
        .groupBy("department", "band")
        .agg(F.count("*"), F.avg("salary"))
        .orderBy("department", "band")
    )
    assert rows(out) == [
        ("Engineering", "High", 1, 110000.0),
        ("Engineering", "Medium", 1, 90000.0),
        ("Marketing", "Low", 1, 70000.0),
        ("Sales", "Medium", 2, 82500.0),
    ]


def test_salary_validity(salaries):
    checks = {"valid_salary": F.col("salary") > 0, "valid_date": columns.to_date(F.col("hire_date")).isNotNull()}
    assert rows(aggregates.validity_counts(salaries, "id", checks)) == [(5, 5, 5, 5)]


def test_having(salaries):
    out = aggregates.group_average(salaries, ["department"], "salary", "average", 82500)
    assert rows(out) == [("Engineering", 100000.0)]


def test_left_report(spark):
    people = spark.createDataFrame(
        [(1, "John"), (2, "Jane"), (3, "Bob"), (4, "Alice"), (5, "Charlie")], "id int, name string"
    )
    orders = spark.createDataFrame(
        [(1, 1, 1000.0), (2, 2, 800.0), (3, 1, 500.0), (4, 3, 300.0), (5, 4, 100.0)],
        "order_id int, customer_id int, amount double",
    )
    out = joins.left_report(people, orders, "id", "customer_id", "amount", ["name"])
    assert rows(out) == [
        ("John", 2, 1500.0), ("Jane", 1, 800.0), ("Bob", 1, 300.0), ("Alice", 1, 100.0), ("Charlie", 0, None),
    ]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            ("John", "25", "john@example.com", "2023-01-01"),
            ("Jane", "30", "jane@example.com", "2023-02-01"),
            (None, "unknown", "invalid_email", "invalid_date"),
            ("Bob", "35", "bob@example.com", "2023-03-01"),
            ("Alice", "40", "alice@example.com", "2023-04-01"),
        ],
        "name string, age string, email string, date string",
    )


def test_cleaning_plan(people):
    plan = [
        {"strategy": "handle_nulls", "description": "", "columns": ["name"], "parameters": {}, "confidence": 0.9},
        {"strategy": "handle_nulls", "description": "", "columns": ["age"], "parameters": {}, "confidence": 0.2},
        {"strategy": "semantic", "description": "", "columns": ["age"], "parameters": {}, "confidence": 0.9},
        {"strategy": "convert_types", "columns": ["age"]},
    ]
    # the malformed step still counts as planned for age, so no default step is added for it
    cleaned, applied = cleaning.apply_cleaning(people, plan[:3], today=date(2024, 2, 1))
    assert [s["strategy"] for s in applied] == [
        "handle_nulls", "clean_strings", "convert_types", "validate_dates",
    ]
    assert dict(cleaned.dtypes)["age"] == "bigint"
    assert rows(cleaned)[2] == ("UNKNOWN", 0, "unknown@example.com", datetime(2024, 2, 1))
    assert rows(cleaned)[0] == ("John", 25, "john@example.com", datetime(2023, 1, 1))
    assert cleaning.step_problem(plan[3]) is not None
    check = contracts.validate_cleaning(people, cleaned)
    assert {tuple(r)[3:] for r in check.collect()} == {(True, True)}


def test_money_stays_text(spark):
    df = spark.createDataFrame([("$50,000", "1.5"), (None, "2")], "salary string, age string")
    out = cleaning.clean_strings(cleaning.convert_types(df, ["age"]), ["salary"])
    assert out.dtypes == [("salary", "string"), ("age", "double")]
    assert rows(out) == [("$50,000", 1.5), (None, 2.0)]


def test_convert_types_without_values(spark):
    df = spark.createDataFrame([("nan",), (None,)], "x string")
    assert rows(cleaning.convert_types(df, ["x"], fill=7)) == [(7,), (7,)]


def test_gate_table(spark):
    df = spark.createDataFrame(
        [(1, "test1", date(2024, 1, 1)), (2, "test2", date(2024, 1, 2)), (3, None, date(2024, 1, 3))],
        "id int, name string, date date",
    )
    score = quality.completeness(df).first()["completeness"]
    assert score < 1 and abs(score - 8 / 9) < 1e-9
    gate = quality.quality_gate(df, {"completeness": 0.95}).first()
    assert gate["passed"] is False
    issues = rows(contracts.validate_schema(df, [{"name": "name", "type": "string", "nullable": False}]))
    assert {(i[0], i[1]) for i in issues} == {
        ("extra_column", "id"), ("extra_column", "date"), ("null_violation", "name"),
    }


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert rows(quality.completeness(df)) == [(0, 0, None)]
    assert rows(quality.uniqueness(df)) == [(0, 0, None)]
    assert rows(contracts.validate_schema(df, [{"name": "a"}, {"name": "b"}]))[0][0] == "empty_table"
    assert quality.quality_record(df).first()["row_count"] == 0
    assert [tuple(r)[1:3] for r in quality.column_quality(df).collect()] == [(None, None)] * 2
    assert aggregates.overall_quality(df.selectExpr("CAST(a AS DOUBLE) AS s"), ["s"]).first()["s"] == 0.0
    assert aggregates.describe(df, ["a"]).first()["q50"] is None


def test_scores_match_pandas(spark):
    nan = float("nan")
    data = [(1, 1.0, "a", None), (2, nan, "bb", "x"), (2, nan, "bb", "x"), (3, None, None, "x"), (1, 1.0, "a", None)]
    df = spark.createDataFrame(data, "i bigint, d double, s string, t string")
    pdf = df.toPandas()
    want = 1 - pdf.isnull().sum().sum() / pdf.size
    assert abs(quality.completeness(df).first()["completeness"] - want) < 1e-12
    by_column = {r["column"]: r for r in quality.column_quality(df).collect()}
    for c in pdf.columns:
        assert abs(by_column[c]["completeness"] - (1 - pdf[c].isnull().mean())) < 1e-12
        assert abs(by_column[c]["uniqueness"] - (1 - pdf[c].duplicated().mean())) < 1e-12
    assert quality.uniqueness(df).first()["duplicate_rows"] == 2
    ranges = {r["column"]: r for r in quality.range_report(df).collect()}
    assert abs(ranges["i"]["std"] - pdf["i"].std()) < 1e-12
    assert ranges["d"]["mean"] == 1.0


def test_negative_mean(spark):
    df = spark.createDataFrame([(-1.0,), (-9.0,)], "x double")
    assert quality.consistency(df).first()["consistency"] == 1.0
    assert quality.consistency(df, absolute=True).first()["consistency"] == 0.0


def test_unicode_email_pattern(spark):
    df = spark.createDataFrame([("jürgen@müller.de",)], "s string")
    assert quality.pattern_report(df).first()["email_pattern"] is True


def test_quality_bands(spark):
    df = spark.createDataFrame([(0.95, 0.8, 0.5)], "completeness double, accuracy double, consistency double")
    assert rows(quality.quality_status(df))[0][3:] == ("success", "warning", "error")


def test_companies(spark):
    df = spark.createDataFrame(
        [
            ("C1", "Builds machine learning models and generative AI"),
            ("C2", "Sells shoes and paid ads"),
            ("C3", None),
            ("C4", "  "),
        ],
        "company_id string, description string",
    )
    out = enrich.categorize(df, enrich.tool_named("ai_company_classifier"), ["description", "company_id"])
    got = {r["company_id"]: r for r in out.collect()}
    assert [got[c]["description_classification"] for c in ("C1", "C2", "C3", "C4")] == [
        "AI", "Non-AI", "Non-AI", "Non-AI",
    ]
    assert got["C1"]["description_reasoning"] == "Matched: generative ai, machine learning, ai"
    assert got["C3"]["description_confidence"] == 0.0
    assert got["C3"]["description_reasoning"] == "No text provided for analysis"
    # the second column has its own result
    assert got["C1"]["company_id_classification"] == "Non-AI"
    with pytest.raises(ValueError):
        enrich.categorize(df, enrich.tool_named("ai_company_classifier"), ["absent"])
    with pytest.raises(ValueError):
        enrich.apply_tool(df, "no_such_tool", ["description"])


def test_failing_batch_scorer(spark):
    import pandas as pd

    def score(texts):
        if texts.str.contains("bad").any():
            raise RuntimeError("model down")
        return pd.DataFrame({"classification": "AI", "confidence": 0.9, "reasoning": "ok"}, index=texts.index)

    df = spark.createDataFrame([("good",), ("bad",), ("fine",)], "t string").coalesce(1)
    tool = enrich.tool_named("ai_company_classifier")
    out = enrich.categorize(df, tool, ["t"], batch_category(score, "Non-AI"))
    assert rows(out) == [
        ("good", "AI", 0.9, "ok"), ("bad", "Non-AI", 0.0, "Error: model down"), ("fine", "AI", 0.9, "ok"),
    ]


def test_review_labels(spark):
    df = spark.createDataFrame([(0.9,), (0.1,), (0.5,)], "score double")
    labels = df.withColumn("label", enrich.label_score(F.col("score")))
    summary = aggregates.enrichment_summary(labels, "label", "score", "positive", "negative").first()
    assert (summary["total_records"], summary["positive"], summary["negative"], summary["neutral"]) == (3, 1, 1, 1)


def test_prompt_of_a_tool(spark):
    """A scorer that takes the whole prompt; an empty text is not sent."""
    seen = lambda c: F.struct(c.alias("classification"), F.lit(1.0).alias("confidence"), F.lit("seen").alias("reasoning"))
    tool = {"options": ["Yes", "No"], "factors": ["one", "two"], "terms": {}, "output": {k: "{source_col}_" + k for k in ("classification", "confidence", "reasoning")}}
    df = spark.createDataFrame([("the text",), (" ",)], "c string")
    out = enrich.categorize(df, tool, ["c"], seen, "{classification_options}? {text} by {classification_factors}")
    assert [r["c_classification"] for r in out.collect()] == ["Yes or No? the text by one\ntwo", "No"]


def test_sentiment(spark):
    df = spark.createDataFrame(
        [("The food quality was great, staff friendly",), ("Terrible price",), ("",), (None,)], "c string"
    )
    tool = enrich.tool_named("customer_sentiment_analysis")
    got = rows(enrich.sentiment(df, tool, "c").drop("c", "c_sentiment_reason"))
    assert got == [(1.0, 1.0, 0.0, 1.0), (0.0, 0.0, 0.0, 0.0), (0.0,) * 4, (0.0,) * 4]


def test_sentiment_of_aspects(spark):
    texts = {
        "great product but terrible service": (1.0, 0.0, 0.0, 0.5),
        "The staff was rude, however the food was delicious and fresh": (1.0, 0.0, 0.0, 2 / 3),
        "Terrible price and friendly staff": (0.0, 1.0, 0.0, 0.5),
        "Slow service. The quality? Excellent": (1.0, 0.0, 0.0, 0.5),
        "The item came. The price too": (0.5, 0.0, 0.5, 0.5),
        "great great price; bad, bad, bad": (0.0, 0.0, 1.0, 0.5),
    }
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = enrich.sentiment(df, enrich.tool_named("customer_sentiment_analysis"), "c").drop("c_sentiment_reason")
    assert {r[0]: tuple(round(x, 9) for x in r[1:]) for r in got.collect()} == {
        t: tuple(round(x, 9) for x in want) for t, want in texts.items()
    }


NESTED = """{"employees":[{"id":1,"personal_info":{"name":"A","contact":{"email":"a@x.org"}},
"employment":{"salary":75000.5,"is_active":true,"skills":["x","y"]}},
{"id":2,"personal_info":{"name":null,"contact":{"email":"b@x.org"}},
"employment":{"salary":1.0,"is_active":false,"skills":[]}}]}"""


def test_nested_employees(spark, tmp_path):
    path = tmp_path / "employees.json"
    path.write_text(NESTED)
    df = js.unwrap(spark.read.option("multiLine", True).json(str(path)))
    schema = {r["name"]: (r["type"], r["nullable"]) for r in catalog.relational_schema(df).collect()}
    assert schema["id"] == ("INTEGER", False)
    assert schema["personal_info.name"] == ("VARCHAR(255)", True)
    assert schema["employment.salary"] == ("FLOAT", False)
    assert schema["employment.is_active"] == ("BOOLEAN", False)
    assert schema["employment.skills"] == ("JSON", False)
    flat = js.flatten(df).orderBy("id")
    assert flat.select("`employment.skills`").first()[0] == '["x","y"]'


MALFORMED = [
    ('{\n "name": "Total", "type": "float",\n "description": "Total funding amount\n}', "description", "Total funding amount"),
    ("{\n name: \"Test\",\n value: 123\n}", "name", "Test"),
    ('{\n "name": "Test",\n "value": 123,\n}', "value", "123"),
    ('```json\n{"ok": TRUE, "n": 007}\n```', "n", "7"),
    ('[{"a": 1} {"a": 2}]', "[1].a", "2"),
    (
        '{"columns": [{name: "Last", quality_metrics: {completeness: 1.0, validity: 1.0,}},\n'
        '{name: "Total",\n type: "float",\n description: "Total funding amount\n}]}',
        "columns[1].type", "float",
    ),
]


@pytest.mark.parametrize("bad, path, want", MALFORMED)
def test_repair_json(spark, bad, path, want):
    df = spark.createDataFrame([(bad,)], "doc string").select(js.repair_json(F.col("doc")).alias("doc"))
    dotted = "$" + (path if path.startswith("[") else "." + path)
    assert df.select(F.get_json_object("doc", dotted)).first()[0] == want


REPAIRED = {
    "{'a': 'it\\'s', \"b\": 'say \"x\"'}": {"a": "it's", "b": 'say "x"'},
    '{"a": "open\n, "b": ["c\n]}': {"a": "open", "b": ["c"]},
    '{"a": "open': None,
    '{a: -007.50, b: .5, c: 5., d: 1e3, e: -0, f: 1.2.3, g: 5d}': {"a": -7.5, "b": 0.5, "c": 5.0, "d": 1000.0, "e": 0, "f": "1.2.3", "g": "5d"},
    '{"a" 1}': None,
    '{"a": 1 "b": 2, , "c": [1 2,, 3,],}': {"a": 1, "b": 2, "c": ["1 2", 3]},
    '{"a": , "b":}': {"a": None, "b": None},
    '{"a", "b"}': {"a": None, "b": None},
    '{x: two words, y: [True, none here, NULL]}': {"x": "two words", "y": [True, "none here", None]},
    '{"a": 1]': None, '{"a": 1}}': None, '[1] [2]': None, '{"a": {"b": [}]}': None, "": None, "[": None, "]": None, ":": None,
    '{"a": ""': None, '{"a": "", "b": ["", ""],}': {"a": None, "b": ["", ""]}, "[[], {},]": [[], {}],
}


def test_repaired_texts():
    for bad, want in REPAIRED.items():
        found = repair.repaired(bad)
        assert (None if found is None else json.loads(found)) == want, bad


def test_repair_leaves_valid_text(spark):
    good = '{"a": "x, y: TRUE, {b: 1,}", "e": ""}'
    df = spark.createDataFrame([(good,), ("not json at all {",), (None,)], "doc string")
    assert rows(df.select(js.repair_json(F.col("doc")))) == [(good,), (None,), (None,)]


def test_tolerant_values(spark):
    from tarnlake.functions.numbers import to_number
    from tarnlake.functions.times import parse_time

    days = ["2024-01-31", "2024/01/31", "20240131", "01/31/2024", "31.01.2024", "31-Jan-2024", "Jan 31, 2024",
            "January 31, 2024", "31 Jan 2024", "2024-01-31T00:00:00"]
    df = spark.createDataFrame([(d,) for d in days], "t string")
    assert {r[0] for r in df.select(parse_time(F.col("t"))).collect()} == {datetime(2024, 1, 31)}
    bad = spark.createDataFrame([("31/31/2024",), ("soon",), ("",), (None,)], "t string")
    assert {r[0] for r in bad.select(parse_time(F.col("t"))).collect()} == {None}
    texts = [" 1.5 ", "1d", "2.5F", "1e3", "0x10", "NaN", "-7", "1,000", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(to_number(F.col("t"))).collect()]
    assert got == [1.5, None, None, 1000.0, None, None, -7.0, None, None]


def test_names(spark):
    assert columns.standard_names(["LeadInvestor(s)", " A--b ", "a_b", "###", "Ü"]) == [
        "leadinvestor_s", "a_b", "a_b_2", "col_3", "col_4",
    ]
    df = spark.createDataFrame(
        [("My File (1).CSV",), ("archive.tar.GZ",), (".hidden",), ("noext",), ("_a_.Txt",)], "n string"
    )
    got = [r[0] for r in df.select(text.sanitize_file_name(F.col("n"))).collect()]
    assert got == ["my_file_1.csv", "archive_tar.gz", "hidden", "noext", "a.txt"]


def test_consistent_schema(spark):
    df = spark.createDataFrame([(1, 2.0)], "`Employee ID` int, `Pay (USD)` double")
    out, described, mapping = columns.consistent_schema(df)
    assert out.columns == ["employee_id", "pay_usd"]
    assert described[0] == {
        "name": "employee_id", "type": "bigint", "description": "Original column name: Employee ID",
    }
    assert out.schema["pay_usd"].metadata["comment"] == "Original column name: Pay (USD)"
    assert mapping["Pay (USD)"] == "pay_usd"


def test_types():
    assert types.spark_type("int64") == "bigint"
    assert types.spark_type("VARCHAR(20) NULL") == "string"
    assert types.spark_type("datetime64[ns]") == "timestamp"
    assert types.spark_type("decimal(12,3)") == "decimal(12,3)"
    assert types.spark_type("array<string>") == "array<string>"
    assert types.spark_type("whatever") == "string"


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, " "), (None, None, None)], "i int, s string, t string")
    assert filters.drop_empty_rows(df).count() == 2
    # a null is not blank, so only a row with blanks in every text column goes
    blank = spark.createDataFrame([(1, " ", "\t\n"), (2, None, " "), (3, "x", "")], "i int, s string, t string")
    assert [r["i"] for r in filters.drop_blank_rows(blank).collect()] == [2, 3]
    assert filters.search(df, "", ["s"]).count() == 3
    with pytest.raises(ValueError):
        filters.condition({"column": "i", "operator": "~", "value": 1})


def test_funding_report(spark):
    df = spark.createDataFrame(
        [("A", 5.0, "1-10", "2024-01-01"), ("B", None, "1-10", None), ("C", 9.0, "11-50", "2024-01-01")],
        "organization_name string, amount double, empl_count string, day string",
    )
    top = reports.report_query(
        df, filters=[{"column": "amount", "operator": "is_not_null"}],
        columns=["organization_name", "amount"], order=[("amount", "desc")], limit=10,
    )
    assert rows(top) == [("C", 9.0), ("A", 5.0)]
    assert rows(aggregates.trend(df, F.col("day"), "amount", "day", "total")) == [("2024-01-01", 14.0)]
    # nulls of every column type survive a JSON-safe projection
    assert columns.json_safe(df).filter("organization_name = 'B'").first()["amount"] is None


def test_schema_changes(spark):
    old = spark.createDataFrame([("a", "int"), ("b", "string"), ("c", None)], "name string, type string")
    new = spark.createDataFrame([("a", "bigint"), ("c", None), ("d", "date")], "name string, type string")
    got = {r["name"]: r["change"] for r in catalog.schema_changes(old, new, ["name"]).collect()}
    assert got == {"a": "modified", "b": "removed", "c": "unchanged", "d": "added"}
    merged = {r["name"]: r["type"] for r in catalog.merge_schemas(old, new, ["name"], datetime(2024, 1, 1)).collect()}
    assert merged == {"a": "bigint", "c": None, "d": "date"}


def test_schema_hash_ignores_order(spark):
    a = spark.createDataFrame([("t", "x", "int"), ("t", "y", "string")], "table string, name string, type string")
    b = a.orderBy(F.desc("name"))
    c = spark.createDataFrame([("t", "x", "string"), ("t", "y", "int")], a.schema)
    one, two, three = (catalog.schema_hash(d, "table", ["name", "type"]).first()[1] for d in (a, b, c))
    assert one == two != three
