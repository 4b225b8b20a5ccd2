"""SRC and SNK: reading and writing, on files that Spark writes from the given tables."""

from __future__ import annotations

import datetime
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from tarnlake.checks.registry import check
from tarnlake.operators.columns import apply_schema, with_date_parts
from tarnlake.session import Lake, keep, work_path
from tarnlake.sources import files, readers, writers, xlsx

DATABASE = "tarn_checks"


def scratch(lake: Lake, label: str) -> tuple[str, str, str]:
    """(database, unused table name, unused path in the shared folder)."""
    path = work_path(lake.spark, label)
    writers.use_database(lake.spark, DATABASE, work_path(lake.spark, DATABASE))
    return DATABASE, path.rsplit("/", 1)[-1].replace("-", "_"), path


@check("src_01_csv", "SELECT * FROM customer")
def _(lake):
    path = work_path(lake.spark, "csv")
    writers.export_csv(lake.customer, path)
    # inference reads whole numbers as int; the catalog's types decide
    return apply_schema(
        readers.read_csv(lake.spark, path), {"c_custkey": "bigint", "c_acctbal": "double"}
    )[0]


def json_array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of one JSON array per task, from records in the column r."""
    opening = "["
    for batch in batches:
        yield pd.DataFrame({"value": [opening + batch["r"].iloc[0], *("," + batch["r"].iloc[1:])]})
        opening = ","
    yield pd.DataFrame({"value": ["]" if opening == "," else "[]"]})


@check("src_02_json_documents", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(lake):
    path = work_path(lake.spark, "json")
    records = lake.orders.select(F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("r"))
    records.mapInPandas(json_array, "value string").write.text(path)
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
    return readers.read_json(lake.spark, path, schema)


@check("src_03_json_lines", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def _(lake):
    path = work_path(lake.spark, "jsonl")
    writers.write_as(lake.part, path, "json")
    schema = "p_partkey bigint, p_name string, p_size int, p_retailprice double"
    return readers.read_jsonl(lake.spark, path, None, schema)


@check(
    "src_04_parquet",
    """SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem
       WHERE l_shipdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY l_returnflag""",
)
def _(lake):
    items = readers.read_parquet(lake.spark, lake.path("lineitem"))
    return (
        items.filter("l_shipdate < TIMESTAMP_NTZ '1999-01-01 00:00:00'")
        .groupBy("l_returnflag")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    )


def _workbook(header: list[str], rows, notes: list[str]) -> bytes:
    """A small workbook: texts inline, numbers, and dates as days since 1899-12-30 in a date style; a second sheet with notes."""

    def cell(value) -> str:
        if isinstance(value, datetime.date):
            return f'<c s="1"><v>{(value - datetime.date(1899, 12, 30)).days}</v></c>'
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f"<c><v>{value!r}</v></c>"

    def sheet(lines) -> str:
        body = "".join(f'<row r="{i}">{"".join(map(cell, values))}</row>' for i, values in enumerate(lines, 1))
        return f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>"

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    members = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Rows" sheetId="1" r:id="a"/>'
        '<sheet name="Notes" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        f'<Relationship Id="a" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/>'
        f'<Relationship Id="b" Type="{rel}/worksheet" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet([header, *rows]),
        "xl/worksheets/sheet2.xml": sheet([["note"], *[[n] for n in notes]]),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, content in members.items():
            book.writestr(name, content)
    return out.getvalue()


@check(
    "src_05_excel",
    """SELECT c_custkey, c_name, c_acctbal, CAST(DATE '2000-01-01' + c_nationkey AS DATE) AS joined, NULL::VARCHAR AS note
       FROM customer UNION ALL SELECT c_custkey, NULL, NULL, NULL, c_mktsegment FROM customer""",
)
def _(lake):
    header = ["c_custkey", "c_name", "c_acctbal", "joined"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            name = f"{batch['c_custkey'].iloc[0]}.xlsx"
            notes = [f"{k} {segment}" for k, segment in zip(batch["c_custkey"], batch["c_mktsegment"], strict=True)]
            content = _workbook(header, batch[header].itertuples(index=False), notes)
            yield pd.DataFrame({"path": [name], "content": [content]})

    customers = lake.customer.withColumn("joined", F.expr("date_add(DATE '2000-01-01', c_nationkey)"))
    # both sheets from the same workbooks
    books = keep(customers.mapInPandas(pack, "path string, content binary"), "books")
    notes = xlsx.workbook_frame(books, "Notes").select(
        F.substring_index("note", " ", 1).cast("long").alias("c_custkey"), F.substring_index("note", " ", -1).alias("note")
    )
    return xlsx.workbook_frame(books, typed=True).unionByName(notes, allowMissingColumns=True)


@check("src_07_catalog_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(lake):
    database, name, path = scratch(lake, "orders")
    writers.write_table(lake.orders, database, name, path)
    return readers.table(lake.spark, database, name).select("o_orderkey", "o_orderstatus", "o_totalprice")


@check(
    "src_08_formats",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'csv' WHEN 'SMALL' THEN 'excel' WHEN 'PROMO' THEN 'parquet'
         WHEN 'LARGE' THEN 'avro' END AS format FROM part""",
)
def _(lake):
    ending = F.expr(
        "CASE p_type WHEN 'ECONOMY' THEN '.CSV' WHEN 'SMALL' THEN '.v2.xlsx' WHEN 'PROMO' THEN '.parquet' "
        "WHEN 'LARGE' THEN '.avro' WHEN 'MEDIUM' THEN '.pdf' ELSE '' END"
    )
    path = F.concat(F.lit("s3://lake.x/raw/"), "p_name", ending)
    return lake.part.select("p_partkey", readers.format_of(path).alias("format"))


@check("src_11_table_files", "SELECT count(*) AS n FROM lineitem")
def _(lake):
    return files.table_files(lake.lineitem).agg(F.sum("rows").alias("n"))


@check("src_13_delimited_table", "SELECT s_suppkey, s_name || '|\"x' AS s_name, s_nationkey FROM supplier")
def _(lake):
    database, name, path = scratch(lake, "delimited")
    quoted = lake.supplier.select(
        "s_suppkey", F.concat("s_name", F.lit('|"x')).alias("s_name"), "s_nationkey"
    )
    options = {"header": True, "sep": "|", "quote": '"', "escape": "\\"}
    quoted.write.options(**options).csv(path)
    columns = {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int"}
    return writers.create_delimited_table(lake.spark, database, name, path, columns, sep="|")


@check("snk_01_write_table", "SELECT * FROM supplier")
def _(lake):
    database, name, path = scratch(lake, "suppliers")
    return writers.write_table(lake.supplier, database, name, path)


@check("snk_02_convert", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(lake):
    path = work_path(lake.spark, "orc")
    return writers.convert(lake.spark, lake.path("orders"), path, "orc").select(
        "o_orderkey", "o_totalprice", "o_orderpriority"
    )


@check("snk_03_export_csv", "SELECT p_partkey, p_name || ', \"q\" ' || p_type AS label FROM part")
def _(lake):
    path = work_path(lake.spark, "export")
    label = F.concat("p_name", F.lit(', "q" '), "p_type")
    writers.export_csv(lake.part.select("p_partkey", label.alias("label")), path)
    return readers.read_csv(lake.spark, path, "p_partkey bigint, label string", escape='"')


@check(
    "snk_04_partitioned_write",
    "SELECT l_orderkey, l_linenumber, l_returnflag, year(l_shipdate) AS year FROM lineitem",
)
def _(lake):
    path = work_path(lake.spark, "partitioned")
    items = with_date_parts(
        lake.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate"), "l_shipdate"
    ).drop("month", "day")
    writers.write_partitioned(items, path, ["l_returnflag", "year"])
    # a later load replaces one partition and leaves the others
    again = items.filter("l_returnflag = 'R' AND year = 1997")
    writers.write_partitioned(again, path, ["l_returnflag", "year"], dynamic=True)
    written = readers.read_parquet(lake.spark, path)
    return written.select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("year").cast("long").alias("year")
    )


@check(
    "snk_05_create_or_update",
    """SELECT c_custkey, c_name, c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer WHERE c_nationkey < 12
       UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer WHERE c_nationkey >= 12""",
)
def _(lake):
    database, name, path = scratch(lake, "customers")
    columns = {"c_custkey": "int64", "c_name": "object", "c_acctbal": "float64"}
    writers.create_or_update_table(lake.spark, database, name, columns, location=path)
    writers.append(lake.customer.filter("c_nationkey < 12").select(*columns), database, name)
    writers.create_or_update_table(lake.spark, database, name, {"c_mktsegment": "string"})
    later = lake.customer.filter("c_nationkey >= 12").select("c_mktsegment", "c_name", "c_custkey")
    writers.append(later, database, name)
    return lake.spark.table(f"{database}.{name}")


@check(
    "snk_06_append_by_name",
    "SELECT s_name, s_suppkey FROM supplier UNION ALL SELECT c_name, c_custkey FROM customer",
)
def _(lake):
    database, name, path = scratch(lake, "names")
    writers.write_table(lake.supplier.select("s_name", "s_suppkey"), database, name, path)
    other = lake.customer.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    writers.append(other, database, name)
    return lake.spark.table(f"{database}.{name}")


@check(
    "snk_07_ctas",
    """SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal >= 5000 THEN 'High' ELSE 'Low' END AS band
       FROM customer""",
)
def _(lake):
    database, name, path = scratch(lake, "bands")
    select = (
        "SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal >= 5000 THEN 'High' ELSE 'Low' END AS band "
        "FROM {customer}"
    )
    writers.ctas(lake.spark, database, name, select, path, customer=lake.customer)
    # the table exists now, so a second statement changes nothing
    return writers.ctas(lake.spark, database, name, "SELECT 1 AS x")


@check(
    "snk_08_staged_overwrite",
    "SELECT o_orderkey, o_totalprice, o_totalprice > 200000 AS is_large FROM orders WHERE o_orderstatus <> 'P'",
)
def _(lake):
    path = work_path(lake.spark, "staged")
    lake.orders.write.parquet(path)
    current = readers.read_parquet(lake.spark, path)
    changed = current.filter("o_orderstatus <> 'P'").select(
        "o_orderkey", "o_totalprice", (F.col("o_totalprice") > 200000).alias("is_large")
    )
    return writers.staged_overwrite(changed, path, work_path(lake.spark, "staging"))


@check(
    "snk_09_stored_documents",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment, c_nationkey AS nation, 'customer' AS kind
       FROM customer""",
)
def _(lake):
    path = work_path(lake.spark, "documents")
    docs = lake.customer.select(
        F.col("c_custkey").cast("string").alias("key"),
        F.lit("2024-02-01").alias("at"),
        F.to_json(F.struct("c_mktsegment", "c_nationkey")).alias("doc"),
    )
    writers.store_docs(docs, path, "customer")
    doc = F.from_json("doc", "c_mktsegment string, c_nationkey int")
    return lake.spark.read.parquet(path).select("key", doc.alias("d"), "kind").select(
        "key", F.col("d.c_mktsegment").alias("segment"), F.col("d.c_nationkey").alias("nation"), "kind"
    )
