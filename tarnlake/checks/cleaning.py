"""CLN: column cleaning."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tarnlake.checks.registry import check
from tarnlake.checks.views import DIRTY, LABELLED, dirty_events, labelled_docs
from tarnlake.operators import cleaning as cln

TODAY = date(2024, 2, 1)


@check(
    "cln_01_fill_nulls",
    f"SELECT event_id, coalesce(event_type, 'UNKNOWN') AS event_type, coalesce(date, 'UNKNOWN') AS date FROM {DIRTY}",
)
def _(lake):
    return cln.fill_nulls(
        dirty_events(lake).select("event_id", "event_type", "date"), ["event_type", "date"]
    )


@check(
    "cln_01_fill_numbers",
    f"SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(CAST(toxic AS VARCHAR), 'UNKNOWN') AS toxic FROM {LABELLED}",
)
def _(lake):
    docs = labelled_docs(lake).select("doc_id", "quality", "toxic")
    return cln.fill_nulls(cln.fill_nulls(docs, ["quality"], -1), ["toxic"])


@check(
    "cln_02_convert_types",
    f"""SELECT event_id, coalesce(TRY_CAST(age AS BIGINT), 0) AS age,
          CASE WHEN event_type IS NULL THEN NULL ELSE TRY_CAST(age AS BIGINT) + 0.5 END AS half FROM {DIRTY}""",
)
def _(lake):
    texts = dirty_events(lake).select(
        "event_id", "age", F.concat("age", F.lit(".5")).alias("half")
    )
    # sign-ups give 'unknown.5' and errors '.5'; both must become null
    texts = texts.withColumn("half", F.when(F.col("half") != ".5", F.col("half")))
    return cln.convert_types(texts, ["age", "half"])


@check(
    "cln_03_validate_dates",
    f"SELECT event_id, coalesce(TRY_CAST(date AS TIMESTAMP), TIMESTAMP '2024-02-01 00:00:00') AS date FROM {DIRTY}",
)
def _(lake):
    return cln.validate_dates(dirty_events(lake).select("event_id", "date"), ["date"], TODAY)


@check(
    "cln_04_email",
    f"""SELECT event_id, CASE WHEN email LIKE '%@%' THEN email ELSE 'unknown@example.com' END AS email
        FROM {DIRTY}""",
)
def _(lake):
    return dirty_events(lake).select("event_id", cln.clean_email(F.col("email")).alias("email"))


@check(
    "cln_05_strings",
    f"SELECT event_id, trim(regexp_replace(note, '\\s+', ' ', 'g')) AS note FROM {DIRTY}",
)
def _(lake):
    return cln.clean_strings(dirty_events(lake).select("event_id", "note"), ["note"])


@check(
    "cln_05_whole_texts",
    "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) AS digest FROM documents",
)
def _(lake):
    cleaned = cln.clean_strings(lake.documents.select("doc_id", "text"), ["text"])
    return cleaned.select("doc_id", F.md5("text").alias("digest"))


PLAN = [
    {"strategy": "handle_nulls", "description": "name the kind", "columns": ["event_type"],
     "parameters": {"fill_value": "none"}, "confidence": 0.95},
    {"strategy": "clean_strings", "description": "tidy notes", "columns": ["note"],
     "parameters": {}, "confidence": 0.8},
    {"strategy": "handle_nulls", "description": "not sure", "columns": ["value"],
     "parameters": {"fill_value": 0.0}, "confidence": 0.5},
    {"strategy": "convert_types", "description": "no such column", "columns": ["absent"],
     "parameters": {}, "confidence": 0.9},
]


@check(
    "cln_06_plan",
    f"""SELECT event_id, coalesce(event_type, 'none') AS event_type, value, coalesce(TRY_CAST(age AS BIGINT), 0) AS age,
          CASE WHEN email LIKE '%@%' THEN email ELSE 'unknown@example.com' END AS email,
          coalesce(TRY_CAST(date AS TIMESTAMP), TIMESTAMP '2024-02-01 00:00:00') AS date,
          trim(regexp_replace(note, '\\s+', ' ', 'g')) AS note FROM {DIRTY}""",
)
def _(lake):
    return cln.apply_cleaning(dirty_events(lake).drop("user_id"), PLAN, today=TODAY)[0]
