"""Checks against a declared schema, a cleaning step, or rules for schema documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.numbers import clamp01
from tarnlake.names import literal, rows_of, struct_of
from tarnlake.operators.aggregates import distinct_counts
from tarnlake.operators.keys import present
from tarnlake.types import catalog_name, spark_type

ISSUE = "type string, column string, expected string, actual string, severity string"


def validate_schema(df: DataFrame, contract: list[dict], strict_types: bool = True) -> DataFrame:
    """Issues of a table against its contract, one row each; none means it holds.

    Contract columns: name, type, and optionally nullable (default true) and required. The schema
    is compared by name on the driver; nulls of all non-nullable columns and an empty table are
    found by one aggregate.
    """
    spark = df.sparkSession
    have = {f.name: f for f in df.schema.fields}
    named = {c["name"] for c in contract}
    found = []
    for c in contract:
        field = have.get(c["name"])
        if field is None:
            kind = "missing_required" if c.get("required") else "missing_column"
            found.append((kind, c["name"], c.get("type"), None, "error"))
            continue
        actual = catalog_name(field.dataType)
        declared = c.get("type")
        if declared and not _same_type(declared, field.dataType):
            severity = "error" if strict_types else "warning"
            found.append(("type_mismatch", c["name"], declared, actual, severity))
    found += [("extra_column", n, None, catalog_name(f.dataType), "error") for n, f in have.items() if n not in named]
    issues = spark.createDataFrame(found, ISSUE)

    guarded = [have[c["name"]] for c in contract if c.get("nullable") is False and c["name"] in have]
    counted = df.selectExpr(
        "count(1) AS rows",
        *[f"count_if(({present(f.name, f.dataType)}) IS NULL) AS n{i}" for i, f in enumerate(guarded)],
    )
    rows = [_data_issue("empty_table", "CAST(NULL AS STRING)", "rows", "rows", "rows = 0")]
    rows += [
        _data_issue("null_violation", literal(f.name), "no nulls", f"n{i}", f"n{i} > 0")
        for i, f in enumerate(guarded)
    ]
    data = counted.selectExpr(rows_of(rows)).filter("broken").drop("broken")
    return issues.unionAll(data)


def _same_type(declared: str, actual) -> bool:
    return spark_type(declared) in (actual.simpleString(), catalog_name(actual))


def _data_issue(kind: str, column: str, expected: str, actual: str, broken: str) -> str:
    return struct_of(
        {
            "type": literal(kind), "column": column, "expected": literal(expected),
            "actual": f"CAST({actual} AS STRING)", "severity": "'error'", "broken": broken,
        }
    )


def validate_cleaning(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per column of the cleaned table: null and distinct counts, and whether the row
    count and the column set are unchanged."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
        for side, df in (("before", before), ("after", after))
    ]
    same_rows = reduce(DataFrame.unionAll, counts).agg(
        (F.min("n") == F.max("n")).alias("same_row_count")
    )
    return distinct_counts(after).select(
        "column",
        (F.col("row_count") - F.col("valid_count")).alias("null_count"),
        F.col("distinct_count").alias("unique_count"),
        same_rows.scalar().alias("same_row_count"),
        F.lit(set(before.columns) == set(after.columns)).alias("same_columns"),
    )


# Metrics each column of a schema document carries.
DOCUMENT_METRICS = ["completeness", "uniqueness", "validity"]

DOCUMENT = (
    "struct<columns:array<struct<name:string,type:string,description:string,"
    "sample_value:string,quality_metrics:map<string,string>>>>"
)
# Text fields each column of a schema document needs.
DOCUMENT_FIELDS = ["name", "type", "description", "sample_value"]


def document_columns(docs: DataFrame, key: str, doc: str) -> DataFrame:
    """One row per column entry of JSON schema documents; a document that does not parse or has
    no ``columns`` gives one row without position."""
    parsed = docs.select(key, F.from_json(doc, DOCUMENT).alias("d"))
    return parsed.select(
        key, F.posexplode_outer("d.columns").alias("position", "entry")
    )


def validate_schema_docs(docs: DataFrame, key: str, doc: str) -> DataFrame:
    """Issues of schema documents as rows (key, path, message).

    The documents are walked as variants, so that a value of the wrong type is told from a missing one: a document is
    an object with an array ``columns`` of objects, each with its texts and an object of numeric quality metrics between
    0 and 1. A text that is no JSON is no object either. A null is a value of the wrong type.
    """
    kind = F.schema_of_variant
    whole = docs.select(key, F.try_parse_json(F.coalesce(doc, F.lit(""))).alias("v"))
    whole = whole.withColumn("columns", F.try_variant_get("v", "$.columns", "variant"))
    is_object = F.coalesce(kind(F.col("v")).startswith("OBJECT"), F.lit(False))
    listed = F.coalesce(kind(F.col("columns")).startswith("ARRAY"), F.lit(False))
    top = F.when(~is_object, _issue("", "Schema must be a JSON object")).when(
        F.col("columns").isNull(), _issue("", "Missing required field: columns")
    ).when(~listed, _issue("columns", "'columns' must be an array"))
    found = whole.select(key, F.explode(F.array_compact(F.array(top))).alias("i"))

    entries = whole.filter(is_object & listed).select(
        key, F.posexplode(F.try_variant_get("columns", "$", "array<variant>")).alias("position", "entry")
    )
    at = F.concat(F.lit("columns["), F.col("position").cast("string"), F.lit("]"))
    part = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    plain = ~F.coalesce(kind(F.col("entry")).startswith("OBJECT"), F.lit(False))
    wrong = F.concat(F.lit("Column at index "), F.col("position").cast("string"), F.lit(" must be an object"))
    checks = [F.when(plain, _issue(at, wrong))]
    for name in [*DOCUMENT_FIELDS, "quality_metrics"]:
        value, wanted = part("entry", name), ("OBJECT", "dict") if name == "quality_metrics" else ("STRING", "str")
        checks += [
            F.when(~plain & value.isNull(), _issue(at, f"Missing required field: {name}")),
            F.when(
                ~plain & ~kind(value).startswith(wanted[0]),
                _issue(F.concat(at, F.lit(f".{name}")), f"Field '{name}' must be of type {wanted[1]}"),
            ),
        ]
    metrics, path = part("entry", "quality_metrics"), F.concat(at, F.lit(".quality_metrics"))
    checks.append(F.when(~plain & ~kind(metrics).startswith("OBJECT"), _issue(path, "quality_metrics must be an object")))
    has = ~plain & kind(metrics).startswith("OBJECT")
    for name in DOCUMENT_METRICS:
        value, own = part(metrics, name), F.concat(path, F.lit(f".{name}"))
        number = kind(value).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
        checks += [
            F.when(has & value.isNull(), _issue(path, f"Missing quality metric: {name}")),
            F.when(has & ~number, _issue(own, f"Quality metric '{name}' must be a number")),
            F.when(
                has & number & ~F.try_variant_get(value, "$", "double").between(0, 1),
                _issue(own, f"Quality metric '{name}' must be between 0 and 1"),
            ),
        ]
    inside = entries.select(key, F.explode(F.array_compact(F.array(*checks))).alias("i"))
    return found.unionAll(inside).select(key, "i.path", "i.message")


def _issue(path: Column | str, message: Column | str) -> Column:
    path, message = (F.lit(x) if isinstance(x, str) else x for x in (path, message))
    return F.struct(path.alias("path"), message.alias("message"))


def repair_schema_docs(docs: DataFrame, key: str, doc: str) -> DataFrame:
    """Column entries with missing texts filled by '', missing or non-numeric metrics by 1.0 and
    metrics limited to [0, 1]; one row per entry."""
    entries = document_columns(docs, key, doc).filter("position IS NOT NULL")
    metric = F.col("entry.quality_metrics")
    return entries.select(
        key,
        "position",
        *[F.coalesce(F.col(f"entry.{n}"), F.lit("")).alias(n) for n in DOCUMENT_FIELDS],
        *[
            F.coalesce(clamp01(F.try_element_at(metric, F.lit(n)).try_cast("double")), F.lit(1.0)).alias(n)
            for n in DOCUMENT_METRICS
        ],
    )
