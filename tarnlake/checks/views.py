"""Derived tables with nulls, repeats and dirty texts, as SQL that Spark and DuckDB both run.

The driver tables are clean, so quality and cleaning checks work on these. Every view covers its
whole source table; what is null or dirty follows from the values themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tarnlake.session import Lake

_DIRTY_COLUMNS = """
    event_id, user_id,
    CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type,
    CASE WHEN value < 1 THEN NULL ELSE value END AS value,
    CASE event_type WHEN 'signup' THEN 'unknown' WHEN 'error' THEN ''
         ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS age,
    CASE event_type WHEN 'click' THEN 'user' || CAST(user_id AS STRING) || '@example.com'
         WHEN 'view' THEN 'user at example' WHEN 'error' THEN NULL
         ELSE event_type || '@x.org' END AS email,
    CASE event_type WHEN 'signup' THEN 'invalid_date' WHEN 'error' THEN NULL
         ELSE CAST(CAST(ts AS DATE) AS STRING) END AS date,
    '  ' || event_type || '   of  user ' || CAST(user_id AS STRING) || ' ' AS note
"""

# Events with nulls, sentinel words, broken e-mails and dates.
DIRTY_EVENTS = f"SELECT {_DIRTY_COLUMNS} FROM {{events}}"

# The same with every sign-up present twice.
REPEATED_EVENTS = (
    f"SELECT {_DIRTY_COLUMNS} FROM {{events}} "
    f"UNION ALL SELECT {_DIRTY_COLUMNS} FROM {{events}} WHERE event_type = 'signup'"
)

# Documents with their labels where there are any (texts repeat, labels are mostly null).
LABELLED_DOCS = (
    "SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic "
    "FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"
)


def dirty_events(lake: Lake) -> DataFrame:
    return lake.sql(DIRTY_EVENTS, events=lake.events)


def repeated_events(lake: Lake) -> DataFrame:
    return lake.sql(REPEATED_EVENTS, events=lake.events)


def labelled_docs(lake: Lake) -> DataFrame:
    return lake.sql(LABELLED_DOCS, documents=lake.documents, labels=lake.labels)


def twin(view: str) -> str:
    """The view as a parenthesised DuckDB sub-query."""
    for table in ("events", "documents", "labels"):
        view = view.replace("{" + table + "}", table)
    return f"({view})"


DIRTY = twin(DIRTY_EVENTS)
REPEATED = twin(REPEATED_EVENTS)
LABELLED = twin(LABELLED_DOCS)
