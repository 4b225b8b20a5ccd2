"""PRJ and FLT: projections and filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnlake.checks.registry import check
from tarnlake.checks.views import DIRTY, LABELLED, dirty_events, labelled_docs
from tarnlake.functions.text import sanitize_file_name
from tarnlake.operators import columns as prj
from tarnlake.operators import filters as flt

NOW = datetime(2024, 2, 1, 12, 30, 0)


@check(
    "prj_01_columns_and_limit",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10",
)
def _(lake):
    return prj.pick(lake.orders, ["o_orderkey", "o_orderstatus", "o_totalprice"], 10, ["o_orderkey"])


@check(
    "prj_02_standard_names",
    "SELECT o_orderkey AS order_key, o_totalprice AS total_price_usd, o_orderstatus AS status, "
    "o_orderpriority AS status_2, o_custkey AS col_4 FROM orders",
)
def _(lake):
    messy = lake.orders.select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey"
    ).toDF(" Order Key", "Total--Price (USD)", "Status", "status!", "(#)")
    return prj.standardize_columns(messy)


@check(
    "prj_03_file_names",
    """SELECT p_partkey,
         trim(regexp_replace(lower(p_name || ' (' || p_brand || ').' || p_type), '[^a-z0-9]+', '_', 'g'), '_')
           || '.csv' AS file_name
       FROM part""",
)
def _(lake):
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")."), "p_type", F.lit(".CSV"))
    return lake.part.select("p_partkey", sanitize_file_name(name).alias("file_name"))


@check(
    "prj_04_consistent_schema",
    "SELECT c_custkey AS customer_key, c_name AS customer_name, c_acctbal AS account_balance FROM customer",
)
def _(lake):
    raw = lake.customer.select("c_custkey", "c_name", "c_acctbal").toDF(
        "Customer Key", "Customer Name", "Account (Balance)"
    )
    return prj.consistent_schema(raw)[0]


@check(
    "prj_05_apply_schema",
    f"""SELECT event_id, CAST(user_text AS INTEGER) AS user_text, CAST(day AS VARCHAR) AS day, age
        FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS user_text, CAST(date AS VARCHAR) AS day, age
              FROM {DIRTY})""",
)
def _(lake):
    texts = dirty_events(lake).select(
        "event_id", F.col("user_id").cast("string").alias("user_text"), F.col("date").alias("day"), "age"
    )
    # age and day hold values that do not convert, so both stay text
    return prj.apply_schema(texts, {"user_text": "int", "day": "date", "age": "int64"})[0]


@check(
    "prj_06_case_buckets",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'High'
         WHEN o_totalprice >= 100000 THEN 'Medium' ELSE 'Low' END AS price_category FROM orders""",
)
def _(lake):
    bucket = prj.bucketize(F.col("o_totalprice"), [300000, 100000], ["High", "Medium", "Low"])
    return lake.orders.select("o_orderkey", bucket.alias("price_category"))


@check(
    "prj_07_text_to_date",
    f"""SELECT event_id, year(TRY_CAST(date AS DATE)) AS y, month(TRY_CAST(date AS DATE)) AS m,
          day(TRY_CAST(date AS DATE)) AS d FROM {DIRTY}""",
)
def _(lake):
    day = prj.to_date(F.col("date"))
    return dirty_events(lake).select(
        "event_id",
        F.year(day).cast("long").alias("y"),
        F.month(day).cast("long").alias("m"),
        F.dayofmonth(day).cast("long").alias("d"),
    )


@check(
    "prj_08_audit_columns",
    """SELECT o_orderkey, '2024-02-01T12:30:00' AS updated_at, 'u1' AS user_id,
         '2024-02-01T12:30:00' AS _created_at, '2024-02-01T12:30:00' AS _updated_at,
         'u1' AS _created_by, 'u1' AS _updated_by, 'parquet' AS _file_type FROM orders""",
)
def _(lake):
    audited = prj.with_record_audit(
        prj.with_update_audit(lake.orders.select("o_orderkey"), "u1", NOW), "u1", "parquet", NOW
    )
    return prj.json_safe(audited)


@check(
    "prj_09_date_parts",
    """SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month,
         day(o_orderdate) AS day FROM orders""",
)
def _(lake):
    parts = prj.with_date_parts(lake.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")
    return parts.select(
        "o_orderkey", *[F.col(c).cast("long").alias(c) for c in ("year", "month", "day")]
    )


@check(
    "prj_10_json_safe",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
         CASE WHEN value < 1 THEN NULL ELSE value END AS value FROM events""",
)
def _(lake):
    nan = F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return prj.json_safe(lake.events.select("event_id", "ts", nan.alias("value")))


@check(
    "prj_11_add_columns",
    "SELECT event_id, value, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS remark FROM events",
)
def _(lake):
    wanted = {"VALUE": "string", "score": "double", "remark": "string"}
    return prj.add_columns(lake.events.select("event_id", "value"), wanted)


@check(
    "flt_01_text_equality",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
)
def _(lake):
    spec = {"column": "event_type", "operator": "=", "value": "purchase"}
    return flt.apply_filter(lake.events, spec).select("event_id", "user_id", "value")


@check(
    "flt_02_conjunction",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_orderstatus = 'F' AND o_totalprice > 200000""",
)
def _(lake):
    specs = [
        {"column": "o_orderstatus", "operator": "=", "value": "F"},
        {"column": "o_totalprice", "operator": ">", "value": 200000},
    ]
    return flt.where_all(lake.orders, specs).select("o_orderkey", "o_custkey", "o_totalprice")


@check(
    "flt_03_number_and_date",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       WHERE l_extendedprice > 50000 AND l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'""",
)
def _(lake):
    specs = [
        {"column": "l_extendedprice", "operator": ">", "value": 50000},
        {"column": "l_shipdate", "operator": ">=", "value": datetime(1998, 1, 1)},
    ]
    return flt.where_all(lake.lineitem, specs).select("l_orderkey", "l_linenumber", "l_extendedprice")


@check(
    "flt_04_not_null",
    f"SELECT doc_id, quality FROM {LABELLED} WHERE quality IS NOT NULL",
)
def _(lake):
    return flt.apply_filter(
        labelled_docs(lake), {"column": "quality", "operator": "is not null"}
    ).select("doc_id", "quality")


@check(
    "flt_05_drop_empty_rows",
    f"SELECT event_type, value FROM {DIRTY} WHERE event_type IS NOT NULL OR value IS NOT NULL",
)
def _(lake):
    return flt.drop_empty_rows(dirty_events(lake).select("event_type", "value"))


_BLANKS = """SELECT event_id, CASE event_type WHEN 'error' THEN '  ' WHEN 'view' THEN NULL ELSE event_type END AS kind,
  CASE WHEN value < 10 THEN ' ' || chr(9) ELSE 'v' END AS tag FROM {events}"""


@check(
    "flt_06_drop_blank_rows",
    f"""SELECT event_id, kind, tag FROM ({_BLANKS.replace('{events}', 'events')})
        WHERE NOT (coalesce(regexp_full_match(kind, '\\s*'), false) AND regexp_full_match(tag, '\\s*'))""",
)
def _(lake):
    return flt.drop_blank_rows(lake.sql(_BLANKS, events=lake.events))


@check(
    "flt_07_search",
    "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_name) LIKE '%re%' OR lower(p_type) LIKE '%re%'",
)
def _(lake):
    return flt.search(lake.part, "Re", ["p_name", "p_type"]).select("p_partkey", "p_name", "p_type")


@check(
    "flt_08_structured_filter",
    """SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 20 AND 30
       ORDER BY p_partkey LIMIT 25""",
)
def _(lake):
    spec = {"column": "p_size", "operator": "between", "value": (20, 30)}
    return flt.apply_filter(lake.part, spec, 25, ["p_partkey"]).select("p_partkey", "p_size")


@check(
    "flt_09_prefix_newest",
    """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1-%'
       ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""",
)
def _(lake):
    return flt.newest_with_prefix(
        lake.orders, "o_orderpriority", "1-", "o_orderdate", "o_orderkey", 10
    ).select("o_orderkey", "o_orderpriority")
