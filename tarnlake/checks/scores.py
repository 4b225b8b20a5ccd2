"""DQ: quality scores, reports, contracts and profiles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnlake.checks.registry import check
from tarnlake.checks.relational import rounded
from tarnlake.checks.views import (
    DIRTY, LABELLED, REPEATED, dirty_events, labelled_docs, repeated_events,
)
from tarnlake.operators import contracts
from tarnlake.operators import quality as dq
from tarnlake.operators.cleaning import clean_strings, convert_types

NOW = datetime(2024, 2, 1, 12, 0, 0)

# Columns of the dirty view by kind.
TEXTS = ["event_type", "age", "email", "date", "note"]
NUMBERS = ["event_id", "user_id", "value"]
COLUMNS = ["event_id", "user_id", "event_type", "value", "age", "email", "date", "note"]
TYPES = {**{c: "string" for c in TEXTS}, "event_id": "bigint", "user_id": "bigint", "value": "double"}


def per_column(template: str, columns: list[str], **maps) -> str:
    """UNION ALL of a template filled for each column."""
    return " UNION ALL ".join(
        template.format(c=c, **{k: m[c] for k, m in maps.items()}) for c in columns
    )


_NULLS = " + ".join(f"(count(*) - count({c}))" for c in COLUMNS)


@check(
    "dq_01_completeness",
    f"""SELECT count(*) * 8 AS total_cells, {_NULLS} AS null_cells,
          round(1 - ({_NULLS}) / (count(*) * 8.0), 9) AS completeness FROM {DIRTY}""",
)
def _(lake):
    return rounded(dq.completeness(dirty_events(lake)), 9, "completeness")


@check(
    "dq_02_uniqueness",
    f"""SELECT t AS total_rows, t - d AS duplicate_rows, round(1 - (t - d) / CAST(t AS DOUBLE), 9) AS uniqueness
        FROM (SELECT (SELECT count(*) FROM {REPEATED}) AS t,
                     (SELECT count(*) FROM (SELECT DISTINCT * FROM {REPEATED})) AS d)""",
)
def _(lake):
    return rounded(dq.uniqueness(repeated_events(lake)), 9, "uniqueness")


@check(
    "dq_02_uniqueness_of_long_texts",
    """SELECT t AS total_rows, t - d AS duplicate_rows, round(1 - (t - d) / CAST(t AS DOUBLE), 9) AS uniqueness
       FROM (SELECT (SELECT count(*) FROM documents) AS t,
                    (SELECT count(*) FROM (SELECT DISTINCT lang, text FROM documents)) AS d)""",
)
def _(lake):
    return rounded(dq.uniqueness(lake.documents.select("lang", "text")), 9, "uniqueness")


_CONSISTENT = (
    per_column("SELECT '{c}' AS \"column\", count(DISTINCT length({c})) <= 3 AS ok FROM " + DIRTY, TEXTS)
    + " UNION ALL "
    + per_column("SELECT '{c}', stddev_samp({c}) / avg({c}) < 0.5 FROM " + DIRTY, NUMBERS)
)


@check(
    "dq_03_consistency",
    f"""SELECT count(*) AS total_columns, count(CASE WHEN ok THEN 1 END) AS consistent_columns,
          count(CASE WHEN ok THEN 1 END) / 8.0 AS consistency FROM ({_CONSISTENT})""",
)
def _(lake):
    return dq.consistency(dirty_events(lake))


@check(
    "dq_03_column_consistency",
    per_column(
        """SELECT '{c}' AS "column", 'text' AS kind, CAST(count(DISTINCT length({c})) AS DOUBLE) AS measure,
           count(DISTINCT length({c})) <= 3 AS consistent FROM """ + DIRTY, TEXTS)
    + " UNION ALL "
    + per_column(
        """SELECT '{c}', 'number', round(stddev_samp({c}) / avg({c}), 6),
           stddev_samp({c}) / avg({c}) < 0.5 FROM """ + DIRTY, NUMBERS),
)
def _(lake):
    return rounded(dq.column_consistency(dirty_events(lake)), 6, "measure")


@check(
    "dq_04_type_report",
    per_column(
        """SELECT '{c}' AS "column", '{t}' AS expected_type, count({c}) AS valid_count,
           count(*) - count({c}) AS invalid_count FROM """ + DIRTY, COLUMNS, t=TYPES),
)
def _(lake):
    return dq.type_report(dirty_events(lake))


@check(
    "dq_05_range_report",
    per_column(
        """SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
           round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM """ + DIRTY, NUMBERS),
)
def _(lake):
    return rounded(dq.range_report(dirty_events(lake)), 6, "mean", "std")


@check(
    "dq_06_pattern_report",
    per_column(
        """SELECT '{c}' AS "column",
           coalesce(bool_or(regexp_matches({c}, '^[a-zA-Z0-9_.-]+@[a-zA-Z0-9_.-]+\\.[a-zA-Z0-9_]+$')), false) AS email_pattern,
           coalesce(bool_or(regexp_matches({c}, '^\\+?[0-9 -]{{10,}}$')), false) AS phone_pattern,
           coalesce(bool_or(regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')), false) AS date_pattern
           FROM """ + DIRTY, TEXTS),
)
def _(lake):
    return dq.pattern_report(dirty_events(lake))


@check("dq_07_quality_record")
def _(lake):
    return dq.quality_record(repeated_events(lake), NOW)


@check(
    "dq_07_quality_record_scores",
    f"""SELECT count(*) AS row_count, 8 AS column_count,
          round(1 - ({_NULLS}) / (count(*) * 8.0), 9) AS completeness,
          round((SELECT count(*) FROM (SELECT DISTINCT * FROM {REPEATED})) / CAST(count(*) AS DOUBLE), 9) AS uniqueness,
          count(*) - count(email) AS email_nulls, max(value) AS value_max, true AS email_is_email
        FROM {REPEATED}""",
)
def _(lake):
    record = dq.quality_record(repeated_events(lake), NOW)
    return rounded(
        record.select(
            "row_count",
            "column_count",
            "completeness",
            "uniqueness",
            F.expr("type_validation['email'].invalid_count").alias("email_nulls"),
            F.expr("range_checks['value'].max").alias("value_max"),
            F.expr("pattern_checks['email'].email_pattern").alias("email_is_email"),
        ),
        9, "completeness", "uniqueness",
    )


@check(
    "dq_08_accuracy",
    f"""SELECT 4 AS declared_columns, CAST(a + b + c AS BIGINT) AS valid_columns,
          (a + b + c) / 4.0 AS accuracy
        FROM (SELECT CAST(count(*) FILTER (age IS NOT NULL AND TRY_CAST(age AS BIGINT) IS NULL) = 0 AS INT) AS a,
                CAST(count(*) FILTER (date IS NOT NULL AND TRY_CAST(date AS DATE) IS NULL) = 0 AS INT) AS b,
                1 AS c FROM {DIRTY})""",
)
def _(lake):
    declared = {"age": "int64", "date": "date", "email": "string", "absent": "string"}
    return dq.accuracy(dirty_events(lake), declared)


@check(
    "dq_09_quality_status",
    f"""SELECT source, round(completeness, 9) AS completeness, round(accuracy, 9) AS accuracy,
          CASE WHEN completeness >= 0.95 THEN 'success' WHEN completeness >= 0.85 THEN 'warning' ELSE 'error' END
            AS completeness_status,
          CASE WHEN accuracy >= 0.90 THEN 'success' WHEN accuracy >= 0.80 THEN 'warning' ELSE 'error' END
            AS accuracy_status
        FROM (SELECT source, count(quality) / CAST(count(*) AS DOUBLE) AS completeness,
                count(CASE WHEN lang = 'en' THEN 1 END) / CAST(count(*) AS DOUBLE) AS accuracy
              FROM {LABELLED} GROUP BY source)""",
)
def _(lake):
    scores = (
        labelled_docs(lake)
        .groupBy("source")
        .agg(
            (F.count("quality") / F.count(F.lit(1))).alias("completeness"),
            (F.count_if(F.col("lang") == "en") / F.count(F.lit(1))).alias("accuracy"),
        )
    )
    return rounded(dq.quality_status(scores), 9, "completeness", "accuracy")


@check(
    "dq_10_timeliness",
    """SELECT round(count(CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN 1 END)
         / CAST(count(*) AS DOUBLE), 9) AS timeliness FROM events""",
)
def _(lake):
    since = F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz")
    return rounded(dq.timeliness(lake.events, "ts", since), 9, "timeliness")


@check(
    "dq_11_column_quality",
    per_column(
        """SELECT '{c}' AS "column", round(count({c}) / CAST(count(*) AS DOUBLE), 9) AS completeness,
           round((count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END)
             / CAST(count(*) AS DOUBLE), 9) AS uniqueness, CAST(1 AS DOUBLE) AS validity FROM """ + REPEATED,
        COLUMNS),
)
def _(lake):
    return rounded(dq.column_quality(repeated_events(lake)), 9, "completeness", "uniqueness")


@check(
    "dq_12_quality_run",
    f"""SELECT 'events' AS table_name, 'completeness' AS metric,
          round(1 - ({_NULLS}) / (count(*) * 8.0), 9) AS score, CAST(0.95 AS DOUBLE) AS threshold,
          CASE WHEN 1 - ({_NULLS}) / (count(*) * 8.0) >= 0.95 THEN 'success' ELSE 'warning' END AS status,
          count(*) * 8 AS total, {_NULLS} AS part FROM {REPEATED}
        UNION ALL
        SELECT 'events', 'uniqueness', round(d / CAST(t AS DOUBLE), 9), 0.9,
          CASE WHEN d / CAST(t AS DOUBLE) >= 0.9 THEN 'success' ELSE 'warning' END, t, t - d
        FROM (SELECT (SELECT count(*) FROM {REPEATED}) AS t,
                     (SELECT count(*) FROM (SELECT DISTINCT * FROM {REPEATED})) AS d)
        UNION ALL
        SELECT 'events', 'consistency', k / 8.0, 0.85, CASE WHEN k / 8.0 >= 0.85 THEN 'success' ELSE 'warning' END, 8, k
        FROM (SELECT count(CASE WHEN ok THEN 1 END) AS k FROM ({_CONSISTENT.replace(DIRTY, REPEATED)}))""",
)
def _(lake):
    return rounded(dq.run_quality_checks(repeated_events(lake), "events"), 9, "score")


@check(
    "dq_13_latest_quality",
    """SELECT table_name, strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at, score, event_id FROM (
         SELECT event_type || '_' || CAST(user_id AS VARCHAR) AS table_name, ts AS checked_at,
           value AS score, event_id,
           row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn
         FROM events) WHERE rn = 1""",
)
def _(lake):
    history = lake.events.select(
        F.concat_ws("_", "event_type", "user_id").alias("table_name"),
        F.struct("ts", "event_id").alias("moment"),
        F.col("ts").alias("checked_at"),
        F.col("value").alias("score"),
        "event_id",
    )
    latest = dq.latest_quality(history, "table_name", "moment").drop("moment")
    return latest.withColumn("checked_at", F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss"))


CONTRACT = [
    {"name": "event_id", "type": "int64", "nullable": False},
    {"name": "event_type", "type": "string", "nullable": False},
    {"name": "value", "type": "string"},
    {"name": "email", "type": "string", "nullable": False},
    {"name": "country", "type": "string", "required": True},
]


@check(
    "dq_14_contract",
    f"""SELECT 'missing_required' AS type, 'country' AS "column", 'string' AS expected,
          CAST(NULL AS VARCHAR) AS actual, 'error' AS severity
        UNION ALL SELECT 'type_mismatch', 'value', 'string', 'double', 'error'
        UNION ALL SELECT 'extra_column', c, NULL, t, 'error'
          FROM (VALUES ('user_id', 'bigint'), ('age', 'string'), ('date', 'string'), ('note', 'string')) v(c, t)
        UNION ALL SELECT 'null_violation', 'event_type', 'no nulls', CAST(count(*) AS VARCHAR), 'error'
          FROM {DIRTY} WHERE event_type IS NULL HAVING count(*) > 0
        UNION ALL SELECT 'null_violation', 'email', 'no nulls', CAST(count(*) AS VARCHAR), 'error'
          FROM {DIRTY} WHERE email IS NULL HAVING count(*) > 0""",
)
def _(lake):
    return contracts.validate_schema(dirty_events(lake), CONTRACT)


@check(
    "dq_15_cleaning_check",
    f"""SELECT 'event_id' AS "column", 0 AS null_count, count(DISTINCT event_id) AS unique_count,
          true AS same_row_count, true AS same_columns FROM {DIRTY}
        UNION ALL SELECT 'age', 0, count(DISTINCT coalesce(TRY_CAST(age AS BIGINT), 0)), true, true FROM {DIRTY}
        UNION ALL SELECT 'email', 0, count(DISTINCT CASE WHEN email LIKE '%@%' THEN email ELSE 'unknown@example.com' END),
          true, true FROM {DIRTY}""",
)
def _(lake):
    before = dirty_events(lake).select("event_id", "age", "email")
    after = clean_strings(convert_types(before, ["age"]), ["email"])
    return contracts.validate_cleaning(before, after)


@check(
    "dq_16_profile",
    per_column(
        """SELECT '{c}' AS "column", '{t}' AS type, round(count({c}) / CAST(count(*) AS DOUBLE), 9) AS completeness,
           round(1 - count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 9) AS redundancy,
           round(count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 9) AS distinct_ratio,
           count({c}) / CAST(count(*) AS DOUBLE) > 0.95 AS is_required,
           1 - count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) > 0.95 AS is_unique,
           arg_min({c}, event_id) FILTER ({c} IS NOT NULL) AS sample_value FROM """ + DIRTY,
        [c for c in COLUMNS if c in TEXTS], t=TYPES),
)
def _(lake):
    profiled = dq.profile(dirty_events(lake).select("event_id", *TEXTS), "event_id")
    return rounded(
        profiled.filter("column <> 'event_id'"), 9, "completeness", "redundancy", "distinct_ratio"
    )


@check(
    "dq_16_profile_score",
    "SELECT round(avg(s), 9) AS data_quality_score FROM ("
    + per_column(
        """SELECT (count({c}) / CAST(count(*) AS DOUBLE) + 1 - count(DISTINCT {c}) / CAST(count(*) AS DOUBLE)) / 2
           AS s FROM """ + DIRTY, COLUMNS)
    + ")",
)
def _(lake):
    return rounded(dq.profile_score(dq.profile(dirty_events(lake))), 9, "data_quality_score")


# Schema documents made of the events: one column entry per document; errors have no columns at
# all, views no description, purchases a text as completeness, click values lie outside [0, 1].
_DOC = """CASE event_type
    WHEN 'error' THEN '{"table": "t"}'
    WHEN 'view' THEN '{"columns": [{"name": "c", "type": "string", "sample_value": "' || CAST(user_id AS STRING)
      || '", "quality_metrics": {"completeness": 0.5, "uniqueness": 0.25}}]}'
    WHEN 'purchase' THEN '{"columns": [{"name": "c", "type": "int", "description": "d", "sample_value": "1",
      "quality_metrics": {"completeness": "high", "uniqueness": 1, "validity": 0}}]}'
    WHEN 'click' THEN '{"columns": [{"name": "c", "type": "int", "description": "d", "sample_value": "1",
      "quality_metrics": {"completeness": ' || CAST(1 + CAST(floor(value) AS BIGINT) AS STRING)
      || ', "uniqueness": 1, "validity": 0}}]}'
    ELSE '{"columns": [{"name": "a", "type": "int", "description": "d", "sample_value": "1",
      "quality_metrics": {"completeness": 1, "uniqueness": 1, "validity": 1}},
      {"type": "int", "description": "d", "sample_value": "2"}]}'
    END AS doc"""


def _docs(lake):
    return lake.events.selectExpr("event_id", _DOC)


@check(
    "dq_17_schema_documents",
    """SELECT event_id, '' AS path, 'Missing required field: columns' AS message FROM events WHERE event_type = 'error'
       UNION ALL SELECT event_id, 'columns[0]', 'Missing required field: description' FROM events WHERE event_type = 'view'
       UNION ALL SELECT event_id, 'columns[0].quality_metrics', 'Missing quality metric: validity' FROM events WHERE event_type = 'view'
       UNION ALL SELECT event_id, 'columns[0].quality_metrics.completeness', 'Quality metric ''completeness'' must be a number' FROM events WHERE event_type = 'purchase'
       UNION ALL SELECT event_id, 'columns[0].quality_metrics.completeness', 'Quality metric ''completeness'' must be between 0 and 1' FROM events WHERE event_type = 'click' AND floor(value) > 0
       UNION ALL SELECT event_id, 'columns[1]', 'Missing required field: ' || f FROM events, (VALUES ('name'), ('quality_metrics')) AS v(f) WHERE event_type = 'signup'""",
)
def _(lake):
    return contracts.validate_schema_docs(_docs(lake), "event_id", "doc")


_BAD_DOC = """CASE event_id % 8
    WHEN 0 THEN '{"columns": "x"}'
    WHEN 1 THEN '[{"columns": []}]'
    WHEN 2 THEN '{"columns": ['
    WHEN 3 THEN NULL
    WHEN 4 THEN '{"columns": [7, {"name": ' || event_id || ', "type": "t", "description": null, "sample_value": "v", "quality_metrics": [1]}]}'
    WHEN 5 THEN '{"columns": null}'
    WHEN 6 THEN '{"columns": [{"name": "n", "type": "t", "description": "d", "sample_value": "v",
      "quality_metrics": {"completeness": ' || value || ', "uniqueness": true, "validity": "0.5"}}]}'
    ELSE '{"columns": []}' END AS doc"""


@check(
    "dq_17_malformed_documents",
    """WITH e AS (SELECT event_id, event_id % 8 AS k, value FROM events)
       SELECT event_id, 'columns' AS path, '''columns'' must be an array' AS message FROM e WHERE k IN (0, 5)
       UNION ALL SELECT event_id, '', 'Schema must be a JSON object' FROM e WHERE k IN (1, 2, 3)
       UNION ALL SELECT event_id, p, m FROM e, (VALUES ('columns[0]', 'Column at index 0 must be an object'),
         ('columns[1].name', 'Field ''name'' must be of type str'), ('columns[1].description', 'Field ''description'' must be of type str'),
         ('columns[1].quality_metrics', 'Field ''quality_metrics'' must be of type dict'),
         ('columns[1].quality_metrics', 'quality_metrics must be an object')) AS v(p, m) WHERE k = 4
       UNION ALL SELECT event_id, 'columns[0].quality_metrics.completeness', 'Quality metric ''completeness'' must be between 0 and 1' FROM e WHERE k = 6 AND value > 1
       UNION ALL SELECT event_id, 'columns[0].quality_metrics.' || m, 'Quality metric ''' || m || ''' must be a number' FROM e, (VALUES ('uniqueness'), ('validity')) AS v(m) WHERE k = 6""",
)
def _(lake):
    return contracts.validate_schema_docs(lake.events.selectExpr("event_id", _BAD_DOC), "event_id", "doc")


@check(
    "dq_17_repaired_documents",
    """SELECT event_id, 0 AS "position", CASE WHEN event_type = 'signup' THEN 'a' ELSE 'c' END AS name,
         CASE WHEN event_type = 'view' THEN 'string' ELSE 'int' END AS type,
         CASE WHEN event_type = 'view' THEN '' ELSE 'd' END AS description,
         CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) ELSE '1' END AS sample_value,
         CAST(CASE WHEN event_type = 'view' THEN 0.5 ELSE 1 END AS DOUBLE) AS completeness,
         CAST(CASE WHEN event_type = 'view' THEN 0.25 ELSE 1 END AS DOUBLE) AS uniqueness,
         CAST(CASE WHEN event_type IN ('click', 'purchase') THEN 0 ELSE 1 END AS DOUBLE) AS validity
       FROM events WHERE event_type <> 'error'
       UNION ALL SELECT event_id, 1, '', 'int', 'd', '2', 1, 1, 1 FROM events WHERE event_type = 'signup'""",
)
def _(lake):
    return contracts.repair_schema_docs(_docs(lake), "event_id", "doc")


@check(
    "dq_18_quality_gate",
    f"""SELECT c >= 0.85 AND u >= 0.99 AS passed, round(c, 9) AS completeness, round(u, 9) AS uniqueness
        FROM (SELECT 1 - ({_NULLS}) / (count(*) * 8.0) AS c,
                (SELECT count(*) FROM (SELECT DISTINCT * FROM {REPEATED})) / CAST(count(*) AS DOUBLE) AS u
              FROM {REPEATED})""",
)
def _(lake):
    gate = dq.quality_gate(repeated_events(lake), {"completeness": 0.85, "uniqueness": 0.99})
    return rounded(gate, 9, "completeness", "uniqueness")
