"""JOIN, AGG, WIN, SRT and SET."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.checks.registry import check
from tarnlake.checks.views import DIRTY, LABELLED, REPEATED, dirty_events, labelled_docs, repeated_events
from tarnlake.operators import aggregates as agg
from tarnlake.operators import joins
from tarnlake.operators import ordering as srt
from tarnlake.operators import sets
from tarnlake.operators import windows as win
from tarnlake.operators.scorers import matched_terms


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


@check(
    "join_01_left_report",
    """SELECT c_custkey, c_name, count(o_orderkey) AS order_count, round(sum(o_totalprice), 2) AS total_amount
       FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000)
         ON c_custkey = o_custkey
       GROUP BY c_custkey, c_name""",
)
def _(lake):
    large = lake.orders.filter("o_totalprice > 400000")
    report = joins.left_report(
        lake.customer, large, "c_custkey", "o_custkey", "o_totalprice", ["c_custkey", "c_name"],
        "order_count", "total_amount",
    )
    return rounded(report, 2, "total_amount")


@check(
    "join_02_inner",
    """SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _(lake):
    return joins.inner_join(lake.supplier, lake.nation, "s_nationkey", "n_nationkey").select(
        "s_suppkey", "s_name", "n_name"
    )


@check(
    "join_03_stored_metadata",
    """SELECT c.c_custkey AS name, coalesce(m.description, c.c_mktsegment) AS description,
         coalesce(m.row_count, 0) AS row_count,
         coalesce(strftime(m.updated, '%Y-%m-%d'), NULL) AS updated
       FROM customer c LEFT JOIN (
         SELECT o_custkey AS name, min(o_orderpriority) AS description, count(*) AS row_count,
                max(o_orderdate) AS updated
         FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey) m ON m.name = c.c_custkey""",
)
def _(lake):
    tables = lake.customer.select(
        F.col("c_custkey").alias("name"),
        F.col("c_mktsegment").alias("description"),
        F.lit(0).cast("long").alias("row_count"),
        F.lit(None).cast("timestamp_ntz").alias("updated"),
    )
    stored = (
        lake.orders.filter("o_totalprice > 400000")
        .groupBy(F.col("o_custkey").alias("name"))
        .agg(
            F.min("o_orderpriority").alias("description"),
            F.count(F.lit(1)).alias("row_count"),
            F.max("o_orderdate").alias("updated"),
        )
    )
    listed = joins.with_stored_metadata(
        tables, stored, "name", ["description", "row_count", "updated"], "updated"
    )
    return listed.withColumn("updated", F.date_format("updated", "yyyy-MM-dd"))


_BRAND_NAMES = """SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(a.p_name, b.p_name) AS p_name,
  CASE WHEN a.p_name IS NULL THEN 'only_right' WHEN b.p_name IS NULL THEN 'only_left' ELSE 'common' END AS status
  FROM (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size <= 25) a
  FULL JOIN (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size > 25) b
    ON a.p_brand = b.p_brand AND a.p_name = b.p_name"""


@check("join_04_compare_columns", _BRAND_NAMES)
def _(lake):
    small, large = lake.part.filter("p_size <= 25"), lake.part.filter("p_size > 25")
    return joins.compare_columns(small, large, ["p_brand", "p_name"])


@check("agg_01_row_count", "SELECT count(*) AS row_count FROM lineitem")
def _(lake):
    return agg.row_count(lake.lineitem)


@check(
    "agg_02_group_report",
    """SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS average FROM customer
       GROUP BY c_mktsegment""",
)
def _(lake):
    return rounded(agg.group_report(lake.customer, ["c_mktsegment"], "c_acctbal"), 6, "average")


@check(
    "agg_03_group_average",
    "SELECT p_brand, round(avg(p_retailprice), 6) AS price FROM part GROUP BY p_brand",
)
def _(lake):
    return rounded(agg.group_average(lake.part, ["p_brand"], "p_retailprice", "price"), 6, "price")


@check(
    "agg_04_having",
    """SELECT o_custkey, round(avg(o_totalprice), 6) AS avg_price FROM orders GROUP BY o_custkey
       HAVING avg(o_totalprice) > 260000""",
)
def _(lake):
    return rounded(
        agg.group_average(lake.orders, ["o_custkey"], "o_totalprice", "avg_price", 260000), 6, "avg_price"
    )


@check(
    "agg_05_trend",
    f"""SELECT date AS day, round(sum(value), 2) AS total FROM {DIRTY} WHERE date IS NOT NULL
        GROUP BY date""",
)
def _(lake):
    return rounded(agg.trend(dirty_events(lake), F.col("date"), "value", "day", "total"), 2, "total")


@check(
    "agg_06_distribution",
    "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag",
)
def _(lake):
    return agg.distribution(lake.lineitem, "l_returnflag")


@check(
    "agg_07_two_keys",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS average
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def _(lake):
    report = agg.group_report(lake.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity")
    return rounded(report, 6, "average")


@check(
    "agg_08_validity_counts",
    f"""SELECT count(*) AS total, count(DISTINCT user_id) AS distinct_keys,
          count(CASE WHEN value > 10 THEN 1 END) AS valid_values, count(date) AS valid_dates FROM {DIRTY}""",
)
def _(lake):
    checks = {"valid_values": F.col("value") > 10, "valid_dates": F.col("date").isNotNull()}
    return agg.validity_counts(dirty_events(lake), "user_id", checks)


@check(
    "agg_09_chart_query",
    """SELECT l_shipmonth, l_returnflag, round(avg(l_quantity), 6) AS l_quantity,
         round(avg(l_extendedprice), 6) AS l_extendedprice
       FROM (SELECT *, strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem)
       GROUP BY l_shipmonth, l_returnflag""",
)
def _(lake):
    items = lake.lineitem.withColumn("l_shipmonth", F.date_format("l_shipdate", "yyyy-MM"))
    chart = agg.chart_query(
        items, "l_shipmonth", ["l_quantity", "l_extendedprice"], "average", "l_returnflag"
    )
    return rounded(rounded(chart, 6, "l_quantity"), 6, "l_extendedprice")


@check(
    "agg_10_column_statistic",
    f"SELECT sum(TRY_CAST(age AS DOUBLE)) AS age_sum FROM {DIRTY}",
)
def _(lake):
    return agg.column_statistic(dirty_events(lake), "age", "sum")


@check(
    "agg_11_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
            round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
            round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
            round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {t}"""
        for c, t in (("value", DIRTY), ("user_id", DIRTY))
    ),
)
def _(lake):
    described = agg.describe(dirty_events(lake), ["value", "user_id"])
    return rounded(described, 6, "mean", "std", "q25", "q50", "q75")


@check(
    "agg_12_null_percentage",
    f"""SELECT count(*) AS total_rows, count(*) - count(quality) AS null_count,
          round(100.0 * (count(*) - count(quality)) / count(*), 6) AS null_percentage FROM {LABELLED}""",
)
def _(lake):
    return rounded(agg.null_percentage(labelled_docs(lake), "quality"), 6, "null_percentage")


@check(
    "agg_13_pipeline_statistics",
    """SELECT (SELECT count(*) FROM events) AS total_records,
         (SELECT count(*) FROM events WHERE event_type <> 'error') AS transformed_records,
         (SELECT count(*) FROM events WHERE event_type <> 'error' AND value > 5) AS loaded_records,
         (SELECT count(*) FROM events WHERE event_type = 'error') AS error_count,
         (SELECT count(*) > 0 FROM events WHERE event_type = 'error') AS has_errors,
         'in_progress' AS status""",
)
def _(lake):
    good = lake.events.filter("event_type <> 'error'")
    return agg.pipeline_statistics(
        lake.events, good, good.filter("value > 5"), lake.events.filter("event_type = 'error'")
    )


@check(
    "agg_14_enrichment_summary",
    f"""SELECT count(*) AS total_records, count(label) AS successful, count(*) - count(label) AS failed,
          count(CASE WHEN label = 'positive' THEN 1 END) AS positive,
          count(CASE WHEN label = 'negative' THEN 1 END) AS negative,
          count(CASE WHEN label = 'neutral' THEN 1 END) AS neutral,
          round(avg(confidence), 6) AS average_confidence
        FROM (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'positive' WHEN toxic = 1 THEN 'negative'
                WHEN quality IS NULL THEN NULL ELSE 'neutral' END AS label,
              n_chars / 100000.0 AS confidence FROM {LABELLED})""",
)
def _(lake):
    docs = labelled_docs(lake).select(
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "positive")
        .when(F.col("toxic") == 1, "negative")
        .when(F.col("quality").isNotNull(), "neutral")
        .alias("label"),
        (F.col("n_chars") / 100000.0).alias("confidence"),
    )
    summary = agg.enrichment_summary(docs, "label", "confidence", "positive", "negative")
    return rounded(summary, 6, "average_confidence")


_WORDS = ["license", "email", "token", "the", "and", "der", "que", "are"]


@check(
    "agg_14_common_values",
    " UNION ALL ".join(
        f"""SELECT '{w}' AS value, count(*) AS n FROM documents
            WHERE regexp_matches(lower(text), '(^|[^a-z0-9]){w}([^a-z0-9]|$)')"""
        for w in _WORDS
    )
    + " ORDER BY n DESC, value LIMIT 5",
)
def _(lake):
    found = lake.documents.select(matched_terms(F.col("text"), _WORDS).alias("words"))
    return agg.common_values(found, "words", 5)


@check(
    "agg_15_overall_quality",
    f"""SELECT round(avg(completeness), 6) AS completeness, round(avg(uniqueness), 6) AS uniqueness
        FROM (SELECT source, count(quality) * 1.0 / count(*) AS completeness,
                count(DISTINCT text) * 1.0 / count(*) AS uniqueness FROM {LABELLED} GROUP BY source)""",
)
def _(lake):
    per_source = (
        labelled_docs(lake)
        .withColumn("digest", F.sha2("text", 256))
        .groupBy("source")
        .agg(
            (F.count("quality") / F.count(F.lit(1))).alias("completeness"),
            (F.count_distinct("digest") / F.count(F.lit(1))).alias("uniqueness"),
        )
    )
    scores = ["completeness", "uniqueness"]
    return rounded(agg.overall_quality(per_source, scores), 6, *scores)


_REPEAT_COLUMNS = ["event_id", "user_id", "event_type", "value", "age", "email", "date", "note"]


@check(
    "agg_16_duplicate_report",
    f"""SELECT 'total_rows' AS item, count(*) AS n FROM {REPEATED}
        UNION ALL SELECT 'distinct_rows', count(*) FROM (SELECT DISTINCT * FROM {REPEATED})
        UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM {REPEATED})
          - (SELECT count(*) FROM (SELECT DISTINCT * FROM {REPEATED}))"""
    + "".join(
        f" UNION ALL SELECT 'distinct {c}', count(DISTINCT {c}) FROM {REPEATED}" for c in _REPEAT_COLUMNS
    ),
)
def _(lake):
    return agg.duplicate_report(repeated_events(lake))


@check(
    "win_01_duplicate_positions",
    """SELECT doc_id, lang, first_position FROM (
         SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY lang, text) AS first_position,
           row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS rn FROM documents)
       WHERE rn > 1""",
)
def _(lake):
    docs = lake.documents.select("doc_id", "lang", "text")
    return win.duplicate_positions(docs, "doc_id").select("doc_id", "lang", "first_position")


@check(
    "win_02_latest_version",
    """SELECT user_id, event_id, event_type, props FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
       WHERE rn = 1""",
)
def _(lake):
    versions = lake.events.select("user_id", "event_id", "event_type", "props")
    return win.latest_version(versions, "user_id", "event_id")


@check(
    "win_03_add_versions",
    """SELECT n.user_id, n.event_id,
         coalesce(v.current, 0) + row_number() OVER (PARTITION BY n.user_id ORDER BY n.event_id) AS version
       FROM events n LEFT JOIN (
         SELECT o_custkey AS user_id, count(*) AS current FROM orders GROUP BY o_custkey) v
       ON v.user_id = n.user_id""",
)
def _(lake):
    versions = lake.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count(F.lit(1)).alias("version")
    )
    new = lake.events.select("user_id", "event_id")
    return win.add_versions(versions, new, "user_id", "event_id").select("user_id", "event_id", "version")


@check(
    "win_03_register_new",
    """SELECT p_partkey, p_brand, 1 AS version FROM part
       WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""",
)
def _(lake):
    known = lake.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return win.register_new(known, lake.part.select("p_partkey", "p_brand"), "p_partkey")


@check(
    "srt_01_top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def _(lake):
    return srt.top_k(lake.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 10, ["o_orderkey"])


@check(
    "srt_02_sort_descending",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey",
)
def _(lake):
    return srt.sort_nulls_last(
        lake.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "desc", ["c_custkey"]
    )


@check(
    "srt_03_nulls_last",
    f"SELECT event_id, value FROM {DIRTY} ORDER BY value DESC NULLS LAST, event_id",
)
def _(lake):
    return srt.sort_nulls_last(
        dirty_events(lake).select("event_id", "value"), "value", "desc", ["event_id"]
    )


@check("srt_04_limit", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 5")
def _(lake):
    return srt.first_rows(lake.supplier, 5, ["s_suppkey"]).select("s_suppkey", "s_name")


@check(
    "srt_05_page",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 75",
)
def _(lake):
    return srt.page(lake.orders, 3, 25, ["o_totalprice", "o_orderkey"]).select(
        "o_orderkey", "o_totalprice"
    )


@check(
    "srt_05_deep_page",
    f"""(SELECT 'text' AS kind, o_orderkey AS id FROM orders ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 40 OFFSET 1000)
        UNION ALL (SELECT 'date', event_id FROM events ORDER BY CAST(ts AS DATE), event_id LIMIT 40 OFFSET 600)
        UNION ALL (SELECT 'nullable', event_id FROM {DIRTY} ORDER BY event_type NULLS FIRST, event_id LIMIT 40 OFFSET 720)""",
)
def _(lake):
    # so few rows at once that the pages lie deep on small tables as well
    days = lake.events.select("event_id", F.col("ts").cast("date").alias("day"))
    pages = [
        ("text", lake.orders, 25, ["o_orderpriority", "o_orderdate", "o_orderkey"]),
        ("date", days, 15, ["day", "event_id"]),
        ("nullable", dirty_events(lake).select("event_id", "event_type"), 18, ["event_type", "event_id"]),
    ]
    found = [
        srt.page(df, number, 40, order, shallow=200).select(F.lit(kind).alias("kind"), F.col(order[-1]).alias("id"))
        for kind, df, number, order in pages
    ]
    return found[0].unionAll(found[1]).unionAll(found[2])


@check(
    "srt_06_newest_first",
    f"SELECT event_id, date FROM {DIRTY} ORDER BY date DESC NULLS LAST, event_id",
)
def _(lake):
    return srt.newest_first(dirty_events(lake).select("event_id", "date"), "date", ["event_id"])


_TYPE_NAMES = """SELECT coalesce(a.name, b.name) AS name,
  CASE WHEN a.name IS NULL THEN 'only_right' WHEN b.name IS NULL THEN 'only_left' ELSE 'common' END AS status
  FROM (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part WHERE p_size <= 25) a
  FULL JOIN (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part WHERE p_size > 25) b
    ON a.name = b.name"""


def _two_sides(lake):
    named = lake.part.withColumn("name", F.concat_ws(" ", "p_name", "p_brand"))
    return named.filter("p_size <= 25"), named.filter("p_size > 25")


@check(
    "join_02_overlapping_names",
    """SELECT n.n_nationkey AS id, n.n_name AS name, n.n_regionkey AS region_id, r.r_name AS name_right
       FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
)
def _(lake):
    nations = lake.nation.selectExpr("n_nationkey AS id", "n_name AS name", "n_regionkey AS region_id")
    regions = lake.region.selectExpr("r_regionkey AS id", "r_name AS name")
    return joins.inner_join(nations, regions, "region_id", "id")


@check("set_01_schema_sets", _TYPE_NAMES)
def _(lake):
    return sets.schema_sets(*_two_sides(lake), "name")


@check("set_01_schema_set_counts", f"SELECT status, count(*) AS n FROM ({_TYPE_NAMES}) GROUP BY status")
def _(lake):
    return sets.schema_set_counts(*_two_sides(lake), "name")


@check("set_02_drop_duplicates", f"SELECT DISTINCT * FROM {REPEATED}")
def _(lake):
    return sets.drop_duplicates(repeated_events(lake))


@check(
    "set_02_keep_first",
    """SELECT doc_id, lang, n_chars FROM (
         SELECT *, row_number() OVER (PARTITION BY lang, text, n_chars ORDER BY doc_id) AS rn FROM documents)
       WHERE rn = 1""",
)
def _(lake):
    docs = lake.documents.select("doc_id", "lang", "text", "n_chars")
    return sets.drop_duplicates(docs, "doc_id").select("doc_id", "lang", "n_chars")


@check(
    "set_03_concatenate",
    """SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""",
)
def _(lake):
    customers = lake.customer.select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = lake.supplier.select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")
    )
    return sets.concatenate([customers, suppliers])
