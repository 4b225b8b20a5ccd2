"""STM: the event streams, run to the end of the given tables, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.checks.registry import check
from tarnlake.session import Lake, work_path
from tarnlake.streaming import events as stm
from tarnlake.streaming import retention


def _source(lake: Lake) -> str:
    """The table as a glob: a stream takes a folder or a glob, and the table may be one file."""
    return lake.path("event[s]")


def _stream(lake: Lake):
    return stm.stream_files(lake.spark, _source(lake), lake.events.schema)


def _written(lake: Lake, df, label: str):
    path = work_path(lake.spark, label)
    stm.run_available(df, path, work_path(lake.spark, f"{label}-checkpoint"))
    return lake.spark.read.parquet(path)


_MINUTES = """SELECT date_trunc('minute', ts) AS window_start, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS window_end,
  event_type, count(*) AS n FROM events GROUP BY date_trunc('minute', ts), event_type"""


@check("stm_01_event_counts", _MINUTES)
def _(lake):
    return stm.event_counts(lake.events)


@check(
    "stm_01_event_counts_stream",
    f"""SELECT * FROM ({_MINUTES})
        WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def _(lake):
    # a window is final, and written, once the watermark has passed its end
    return _written(lake, stm.event_counts(_stream(lake)), "minutes")


@check(
    "stm_02_recent",
    """SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTE""",
)
def _(lake):
    return stm.recent(lake.events, 1440).select("event_id", "event_type")


@check(
    "stm_02_retained_stream",
    """SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTE""",
)
def _(lake):
    changes = retention.retained_changes(_stream(lake), "user_id", "event_id", 1440)
    return retention.retained(_written(lake, changes, "retained"), "user_id", "event_id").select("event_id", "user_id", "event_type")


@check(
    "stm_03_sync_changed",
    "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type",
)
def _(lake):
    target, checkpoint = work_path(lake.spark, "synced"), work_path(lake.spark, "synced-checkpoint")
    source = work_path(lake.spark, "source")
    lake.events.filter("event_id % 3 < 2").write.parquet(source)
    lake.events.filter("event_id % 3 = 0").write.mode("append").parquet(source)  # twice: gone before the last run
    for part in (None, 1, 2):
        if part:
            lake.events.filter("event_id % 2 = 0" if part == 1 else "event_id % 2 = 1").write.mode(
                "overwrite" if part == 1 else "append"
            ).parquet(source)
        stm.sync_changed(lake.spark, source, lake.events.schema, target, checkpoint)
    return lake.spark.read.parquet(target).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


_FAILURES = """SELECT s AS window_start, s + INTERVAL 10 MINUTE AS window_end, count(*) AS n FROM (
    SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS s FROM events WHERE event_type = 'error'
    UNION ALL SELECT time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE FROM events WHERE event_type = 'error')
  GROUP BY s"""


@check("stm_04_failures", _FAILURES)
def _(lake):
    return stm.failures(lake.events)


@check(
    "stm_04_failures_stream",
    f"""SELECT * FROM ({_FAILURES}) WHERE window_end <=
          (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 10 MINUTE""",
)
def _(lake):
    return _written(lake, stm.failures(_stream(lake)), "failures")
