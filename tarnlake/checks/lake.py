"""CAT, SQL and WF: catalog rows, report queries and loads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnlake.checks.files import json_array, scratch
from tarnlake.checks.registry import check
from tarnlake.checks.relational import rounded
from tarnlake.checks.values import nested_events
from tarnlake.checks.views import DIRTY, dirty_events
from tarnlake.operators.enrich import TOOLS
from tarnlake.plans import catalog as cat
from tarnlake.plans import loads, reports
from tarnlake.session import work_path
from tarnlake.sources import writers

NOW = datetime(2024, 2, 1, 12, 0, 0)


@check(
    "cat_02_preview",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total_rows FROM orders
       ORDER BY o_orderkey LIMIT 5""",
)
def _(lake):
    return cat.preview(lake.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@check(
    "cat_04_relational_schema",
    """SELECT 'id' AS name, 'INTEGER' AS type, bool_or(event_id IS NULL) AS nullable FROM events
       UNION ALL SELECT 'body.user', 'INTEGER', bool_or(user_id IS NULL) FROM events
       UNION ALL SELECT 'body.what.kind', 'VARCHAR(255)', bool_or(event_type IS NULL) FROM events
       UNION ALL SELECT 'body.what.props.k', 'INTEGER', bool_or(json_extract_string(props, '$.k') IS NULL) FROM events
       UNION ALL SELECT 'tags', 'JSON', bool_or(event_type IS NULL) FROM events
       UNION ALL SELECT 'score', 'FLOAT', bool_or(value < 1) FROM events""",
)
def _(lake):
    score = F.when(F.col("value") >= 1, F.col("value")).alias("score")
    return cat.relational_schema(nested_events(lake, score))


# Field rows of two versions per customer, of the orders until 1996 and since: priorities are the fields, order states their
# types.
_FIELDS = """SELECT o_custkey AS table_id, o_orderpriority AS name, max(o_orderstatus) AS type
  FROM orders WHERE o_orderdate {y} TIMESTAMP '1997-01-01' GROUP BY o_custkey, o_orderpriority"""
_CHANGES = f"""SELECT coalesce(a.table_id, b.table_id) AS table_id, coalesce(a.name, b.name) AS name,
  CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed'
       WHEN a.type <> b.type THEN 'modified' ELSE 'unchanged' END AS change,
  a.type AS old_type, b.type AS new_type
  FROM ({_FIELDS.format(y='<')}) a FULL JOIN ({_FIELDS.format(y='>=')}) b
    ON a.table_id = b.table_id AND a.name = b.name"""
_KEYS = ["table_id", "name"]


def _version(lake, side: str):
    return (
        lake.orders.filter(f"o_orderdate {side} TIMESTAMP_NTZ '1997-01-01'")
        .groupBy(F.col("o_custkey").alias("table_id"), F.col("o_orderpriority").alias("name"))
        .agg(F.max("o_orderstatus").alias("type"))
    )


@check("cat_05_schema_evolution", f"SELECT * FROM ({_CHANGES}) WHERE change <> 'unchanged'")
def _(lake):
    return cat.schema_evolution(_version(lake, "<"), _version(lake, ">="), _KEYS)


@check("cat_06_compare", _CHANGES)
def _(lake):
    return cat.schema_changes(_version(lake, "<"), _version(lake, ">="), _KEYS)


@check(
    "cat_06_merge",
    f"""SELECT table_id, name, new_type AS type, change,
          CASE WHEN change = 'modified' THEN TIMESTAMP '2024-02-01 12:00:00' END AS modified_at
        FROM ({_CHANGES}) WHERE change <> 'removed'""",
)
def _(lake):
    return cat.merge_schemas(_version(lake, "<"), _version(lake, ">="), _KEYS, NOW)


def _hash_sql(year_filter: str) -> str:
    return f"""SELECT o_custkey, md5(n || '|' || a || '|' || b) AS version_hash FROM (
      SELECT o_custkey, CAST(count(*) AS VARCHAR) AS n,
        CAST(sum(CAST('0x' || substr(d, 1, 12) AS BIGINT)) AS VARCHAR) AS a,
        CAST(sum(CAST('0x' || substr(d, 13, 12) AS BIGINT)) AS VARCHAR) AS b
      FROM (SELECT o_custkey, md5(o_orderpriority || ':' || o_orderstatus) AS d FROM orders {year_filter})
      GROUP BY o_custkey)"""


_PARTS = ["o_orderpriority", "o_orderstatus"]


@check("cat_07_schema_hash", _hash_sql(""))
def _(lake):
    return cat.schema_hash(lake.orders, "o_custkey", _PARTS)


@check(
    "cat_07_changed_tables",
    f"""SELECT n.o_custkey, n.version_hash FROM ({_hash_sql('')}) n
        LEFT JOIN ({_hash_sql('WHERE year(o_orderdate) < 2001')}) o ON o.o_custkey = n.o_custkey
        WHERE o.version_hash IS NULL OR o.version_hash <> n.version_hash""",
)
def _(lake):
    before = cat.schema_hash(lake.orders.filter(F.year("o_orderdate") < 2001), "o_custkey", _PARTS)
    return cat.changed_tables(before, cat.schema_hash(lake.orders, "o_custkey", _PARTS), "o_custkey")


@check(
    "cat_08_audit",
    """SELECT event_id, user_id FROM events WHERE event_type = 'purchase'
         AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""",
)
def _(lake):
    log = lake.events.select(
        F.col("event_type").alias("table_name"), F.col("ts").cast("timestamp").alias("at"),
        "event_id", "user_id",
    )
    rows = cat.audit_rows(log, "purchase", datetime(2024, 1, 5), datetime(2024, 1, 20, 12))
    return rows.select("event_id", "user_id")


@check(
    "cat_08_lineage",
    """SELECT event_type AS source, user_id AS target, count(*) AS steps, count(DISTINCT props) AS step_kinds,
         strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at
       FROM events GROUP BY event_type, user_id""",
)
def _(lake):
    rows = cat.lineage(lake.events, "event_type", "user_id", "props", "ts")
    return rows.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")}
    )


@check(
    "cat_09_load_report",
    """SELECT 'orders' AS table_name, 6 AS column_count, '/data/orders' AS location, count(*) AS row_count FROM orders
       UNION ALL SELECT 'lineitem', 11, NULL, count(*) FROM lineitem
       UNION ALL SELECT 'events', 6, NULL, count(*) FROM events""",
)
def _(lake):
    tables = {"orders": lake.orders, "lineitem": lake.lineitem, "events": lake.events}
    return cat.load_report(tables, {"orders": "/data/orders"})


_SPEND = """SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS amount
  FROM {customer} JOIN {orders} ON o_custkey = c_custkey JOIN {nation} ON n_nationkey = c_nationkey
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY n_name, c_mktsegment"""


@check("sql_01_query", _SPEND.replace("{", "").replace("}", ""))
def _(lake):
    frames = {"customer": lake.customer, "orders": lake.orders, "nation": lake.nation}
    return reports.query(lake.spark, _SPEND, **frames)


@check(
    "sql_01_ctas_and_insert",
    "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority",
)
def _(lake):
    database, name, path = scratch(lake, "statements")
    run = lambda text, **args: reports.query(lake.spark, text, database, **args)
    run(
        f"CREATE TABLE {name} USING parquet LOCATION '{path}' AS "
        "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderstatus = 'F'",
        orders=lake.orders,
    )
    run(
        f"INSERT INTO {name} SELECT o_orderkey, o_orderpriority FROM {{orders}} WHERE o_orderstatus <> :s",
        orders=lake.orders, s="F",
    )
    return run(f"SELECT o_orderpriority, count(*) AS n FROM {database}.{name} GROUP BY o_orderpriority")


@check(
    "sql_02_report",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS average
       FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority, o_orderstatus HAVING count(*) > 10
       ORDER BY average DESC LIMIT 7""",
)
def _(lake):
    report = reports.report_query(
        lake.orders,
        filters=[{"column": "o_totalprice", "operator": ">", "value": 1000}],
        group_by=["o_orderpriority", "o_orderstatus"],
        measures={"n": ("count", "*"), "average": ("average", "o_totalprice")},
        having={"column": "n", "operator": ">", "value": 10},
        order=[("average", "desc")],
        limit=7,
    )
    return rounded(report, 6, "average")


@check(
    "sql_02_top_customers",
    """SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'
       ORDER BY c_acctbal DESC, c_custkey LIMIT 5""",
)
def _(lake):
    return reports.report_query(
        lake.customer,
        filters=[{"column": "c_mktsegment", "value": "BUILDING"}],
        columns=["c_custkey", "c_acctbal"],
        order=[("c_acctbal", "desc"), ("c_custkey", "asc")],
        limit=5,
    )


@check(
    "wf_01_ingest",
    """SELECT o_orderkey, o_totalprice, 'u7' AS user_id, 2024 AS year, 2 AS month, 1 AS day,
         TIMESTAMP '2024-02-01 12:00:00' AS updated_at FROM orders""",
)
def _(lake):
    database, name, path = scratch(lake, "ingested")
    table = loads.ingest_file(lake.spark, lake.path("orders"), database, name, "u7", path, now=NOW)
    return table.select("o_orderkey", "o_totalprice", "user_id", "year", "month", "day", "updated_at")


@check(
    "wf_01_ingest_two_users",
    """SELECT o_orderkey AS id, o_totalprice AS amount, 'u7' AS user_id FROM orders
       UNION ALL SELECT o_orderkey, o_totalprice, 'u8' FROM orders""",
)
def _(lake):
    database, name, path = scratch(lake, "ingested")
    for user in ("u7", "u8"):
        table = loads.ingest_file(lake.spark, lake.path("orders"), database, name, user, path, now=NOW)
    return table.selectExpr("o_orderkey AS id", "o_totalprice AS amount", "user_id")


@check(
    "wf_01_ingest_same_day",
    """SELECT o_orderkey AS id, o_totalprice AS amount, 'u7' AS user_id, 1 + o_orderkey % 2 AS day FROM orders
       UNION ALL SELECT c_custkey, c_acctbal, 'u7', 2 FROM customer""",
)
def _(lake):
    # three files of one user: all rows stay, and a load that is run again, also on the next day, replaces its own
    database, name, path = scratch(lake, "ingested")
    source = work_path(lake.spark, "sources")
    orders = lake.orders.selectExpr("o_orderkey AS id", "o_totalprice AS amount")
    for part in (0, 1):
        writers.write_as(orders.filter(F.pmod("id", F.lit(2)) == part), f"{source}/orders_{part}", "parquet")
    writers.write_as(lake.customer.selectExpr("c_custkey AS id", "c_acctbal AS amount"), f"{source}/customers", "orc")
    for file, kind, day in (
        ("orders_0", "parquet", 1), ("orders_1", "parquet", 1), ("customers", "orc", 1),
        ("orders_0", "parquet", 1), ("orders_1", "parquet", 2), ("customers", "orc", 2),
    ):
        at = NOW.replace(day=day)
        table = loads.ingest_file(lake.spark, f"{source}/{file}", database, name, "u7", path, kind, at)
    return table.select("id", "amount", "user_id", F.col("day").cast("long").alias("day"))


@check(
    "wf_02_load_file",
    """SELECT 'loaded' AS kind, 0 AS rows_before, count(*) AS rows_read, count(*) AS rows_after, true AS complete,
         true AS same_columns FROM customer
       UNION ALL SELECT 'again', count(*), count(*), 2 * count(*), true, true FROM customer""",
)
def _(lake):
    database, name, path = scratch(lake, "loaded")
    source = work_path(lake.spark, "source") + ".csv"
    writers.export_csv(lake.customer, source)
    report = work_path(lake.spark, "report")
    for kind in ("loaded", "again"):
        row = loads.load_file(lake.spark, source, database, name, path)
        row.select(F.lit(kind).alias("kind"), "*").drop("table_name").write.mode("append").parquet(report)
    return lake.spark.read.parquet(report)


@check(
    "wf_03_load_prefix",
    """SELECT 'customers' AS table_name, 5 AS column_count, count(*) AS row_count FROM customer
       UNION ALL SELECT 'parts', 4, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier)
       UNION ALL SELECT 'events', 6, count(*) FROM events""",
)
def _(lake):
    prefix = work_path(lake.spark, "prefix")
    writers.export_csv(lake.customer, f"{prefix}/Customers.csv")
    writers.write_as(lake.part.select("p_partkey", "p_name"), f"{prefix}/parts.json", "json")
    writers.write_as(lake.supplier.select("s_suppkey", "s_name"), f"{prefix}/parts.parquet", "parquet")
    writers.write_as(lake.events, f"{prefix}/events.parquet", "parquet")
    database, name, path = scratch(lake, "lake_batch")
    database = f"{database}_{name}"
    writers.use_database(lake.spark, database, f"{path}-database")
    report = loads.load_prefix(lake.spark, prefix, database, path)
    return report.drop("location")


def _rename_parts(spark, folder: str, old: str, new: str) -> None:
    """Spark names its text files .txt; other programs name such documents .json."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(top):
        name = status.getPath().getName()
        if name.endswith(old):
            store.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(top, name.removesuffix(old) + new))


@check(
    "wf_03_load_prefix_rows",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, NULL::VARCHAR AS user_id, NULL::DOUBLE AS size FROM part
       UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL, NULL FROM supplier
       UNION ALL SELECT 'C' || c_custkey, c_name, 'u' || c_nationkey, NULL FROM customer
       UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, NULL, o_totalprice FROM orders WHERE o_orderstatus = 'P'
       UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, NULL, 7 FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderpriority, NULL, NULL FROM orders WHERE o_orderstatus = 'O'""",
)
def _(lake):
    # one table in four units and five formats at several depths: columns in another order, partition folders, numbers
    # and texts of one name, JSON documents beside lines, and a name with brackets
    prefix = work_path(lake.spark, "prefix")
    folder = f"{prefix}/Parts"
    writers.export_csv(lake.part.selectExpr("p_partkey AS id", "p_name AS name"), f"{folder}/2024")
    writers.write_as(lake.supplier.selectExpr("s_suppkey AS id", "s_name AS name"), f"{folder}/2024/01", "parquet")
    users = lake.customer.selectExpr("c_name AS NAME", "'C' || c_custkey AS id", "'u' || c_nationkey AS user_id")
    users.write.partitionBy("user_id").option("header", True).csv(f"{folder}/2024/users")
    writers.write_as(
        lake.orders.filter("o_orderstatus = 'P'").selectExpr("o_totalprice AS size", "o_orderkey AS id"),
        f"{prefix}/parts.old[1].json", "json",
    )
    documents = lake.orders.filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS id", "7 AS size")
    lines = documents.select(F.to_json(F.struct("id", "size")).alias("r")).mapInPandas(json_array, "value string")
    lines.write.text(f"{prefix}/parts.documents")
    _rename_parts(lake.spark, f"{prefix}/parts.documents", ".txt", ".json")
    writers.write_as(
        lake.orders.filter("o_orderstatus = 'O'").selectExpr("o_orderkey AS id", "o_orderpriority AS name"),
        f"{prefix}/parts.orc", "orc",
    )
    database, name, path = scratch(lake, "lake_rows")
    database = f"{database}_{name}"
    writers.use_database(lake.spark, database, f"{path}-database")
    loads.load_prefix(lake.spark, prefix, database, path).collect()
    return lake.spark.table(f"`{database}`.`parts`").select("id", "name", "user_id", "size")


@check(
    "wf_04_etl_with_gate",
    f"""SELECT true AS passed, round(c, 9) AS completeness, 0 AS issues, n AS loaded_rows, 'completed' AS status
        FROM (SELECT count(*) AS n, (count(event_type) + 2 * count(*)) / (3.0 * count(*)) AS c FROM {DIRTY})""",
)
def _(lake):
    database, name, path = scratch(lake, "etl")
    rows = dirty_events(lake).select("event_id", "event_type", "user_id")
    contract = [
        {"name": "event_id", "type": "bigint", "nullable": False},
        {"name": "event_type", "type": "string"},
        {"name": "user_id", "type": "bigint", "required": True},
    ]
    gate = loads.run_etl(lake.spark, rows, contract, {"completeness": 0.9}, database, name, path)
    return rounded(gate, 9, "completeness")


@check(
    "wf_05_upload",
    "SELECT p_partkey AS part_key, p_name AS part_name_2, p_brand AS part_name, p_size AS size FROM part",
)
def _(lake):
    database, name, path = scratch(lake, "uploaded")
    source = work_path(lake.spark, "raw")
    raw = lake.part.select("p_partkey", "p_brand", "p_name", "p_size").toDF(
        "Part Key", "Part Name", "part-name", "SIZE"
    )
    writers.write_as(raw, source, "orc")
    return loads.upload(lake.spark, source, database, name, path, "orc")[0]


_TERM = "(^|[^a-z0-9])({w})([^a-z0-9]|$)"
_AI = "|".join(sorted(TOOLS["ai_company_classifier"]["terms"]["AI"], key=len, reverse=True))


@check(
    "txt_04_apply_tool_to_table",
    f"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{_TERM.format(w=_AI)}') THEN 'AI' ELSE 'Non-AI' END
          AS text_classification,
          CAST(CASE WHEN regexp_matches(lower(text), '{_TERM.format(w=_AI)}') THEN 1 ELSE 0.5 END AS DOUBLE)
          AS text_confidence
        FROM documents WHERE lang <> 'de'""",
)
def _(lake):
    database, name, path = scratch(lake, "enriched")
    blank = F.when(F.col("lang") == "de", F.lit("  ")).otherwise(F.col("text"))
    writers.write_table(lake.documents.select("doc_id", blank.alias("text")), database, name, path)
    out = loads.enrich_table(
        lake.spark, database, name, "ai_company_classifier", ["text"], path,
        work_path(lake.spark, "staging"),
    )
    return out.select("doc_id", "text_classification", "text_confidence")
