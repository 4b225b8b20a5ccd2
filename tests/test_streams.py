"""Streams over several runs, late data and repeated batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.streaming import events as stm
from tarnlake.streaming import retention

START = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, event_type string"


def frame(spark, minutes, kind="click"):
    data = [(i, START + timedelta(minutes=m), kind) for i, m in enumerate(minutes)]
    return spark.createDataFrame(data, SCHEMA).coalesce(1)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "source")
    frame(spark, [0, 0.5, 1, 30]).write.parquet(path)
    return path


def test_late_events_are_left_out(spark, tmp_path, source):
    schema = spark.read.parquet(source).schema
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stm.run_available(stm.event_counts(stm.stream_files(spark, source, schema)), out, checkpoint)
        return sorted((r["window_start"].minute, r["n"]) for r in spark.read.parquet(out).collect())

    assert run() == [(0, 2), (1, 1)]  # minute 30 is still open
    frame(spark, [2, 25, 60]).write.mode("append").parquet(source)
    # minute 2 came after the watermark (30 - 10); minutes 25 and 30 are closed by minute 60
    assert run() == [(0, 2), (1, 1), (25, 1), (30, 1)]


def test_batch_counts_everything(spark):
    got = stm.event_counts(frame(spark, [0, 0.5, 1, 30]))
    assert sorted((r["window_start"].minute, r["n"]) for r in got.collect()) == [(0, 2), (1, 1), (30, 1)]


def test_sync_takes_new_files_only(spark, tmp_path, source):
    schema = spark.read.parquet(source).schema
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "cp")
    for want in (4, 4):
        stm.sync_changed(spark, source, schema, target, checkpoint)
        assert spark.read.parquet(target).count() == want
    frame(spark, [40, 41]).write.mode("append").parquet(source)
    stm.sync_changed(spark, source, schema, target, checkpoint)
    assert spark.read.parquet(target).count() == 6
    # a rewritten source replaces the target
    frame(spark, [1, 2, 3]).write.mode("overwrite").parquet(source)
    for _ in range(2):
        stm.sync_changed(spark, source, schema, target, checkpoint)
        assert spark.read.parquet(target).count() == 3


def test_recent(spark):
    got = stm.recent(frame(spark, [0, 5, 21, 25, 30]), 10)
    assert [r["ts"].minute for r in got.collect()] == [30, 25, 21]


def test_recent_stream_drops_repeats(spark, tmp_path, source):
    schema = spark.read.parquet(source).schema
    frame(spark, [0, 0.5, 1, 30]).write.mode("append").parquet(source)
    out = str(tmp_path / "out")
    stm.run_available(stm.recent_stream(stm.stream_files(spark, source, schema)), out, str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 4


def test_failures_slide(spark):
    got = stm.failures(frame(spark, [1, 6, 7], "error"))
    assert sorted((r["window_start"].minute, r["n"]) for r in got.collect() if r["window_start"] >= START) == [
        (0, 3), (5, 2),
    ]


def test_sync_replaces_changed_files_only(spark, tmp_path):
    """Files by name: one new, one changed, one emptied, one gone, one the same."""
    source, target, checkpoint = (str(tmp_path / n) for n in ("s", "t", "cp"))

    def put(name, minutes):
        frame(spark, minutes, name).write.mode("overwrite").parquet(f"{source}/{name}")

    def sync():
        done = stm.sync_changed(spark, source, spark.createDataFrame([], SCHEMA).schema, target, checkpoint)
        found = spark.read.parquet(target).groupBy("event_type").count().collect()
        return done, {r["event_type"]: r["count"] for r in found}

    for name in ("a b+c", "same", "gone", "emptied"):
        put(name, [1, 2])
    assert sync() == ({"new": 4, "changed": 0, "gone": 0}, dict.fromkeys(("a b+c", "same", "gone", "emptied"), 2))
    assert sync()[0] == {"new": 0, "changed": 0, "gone": 0}
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    put("a b+c", [1, 2, 3])
    put("new", [5])
    put("emptied", [])
    for file in (tmp_path / "s" / "gone").iterdir():
        file.unlink()
    assert sync()[1] == {"a b+c": 3, "same": 2, "new": 1}
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert len(now.items() & kept.items()) == 1  # the file that is the same was not touched


@pytest.mark.parametrize("step", ["_copy_files", "remove_path"])
def test_sync_after_a_failure(spark, tmp_path, source, monkeypatch, step):
    """A run that fails leaves a readable target, and the next one makes up for it."""
    schema = spark.read.parquet(source).schema
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "cp")
    stm.sync_changed(spark, source, schema, target, checkpoint)
    frame(spark, [1, 2, 3]).write.mode("overwrite").parquet(source)
    with monkeypatch.context() as broken:
        def fails(*_):
            raise OSError("lost")

        broken.setattr(stm, step, fails)
        with pytest.raises(OSError, match="lost"):
            stm.sync_changed(spark, source, schema, target, checkpoint)
    assert spark.read.parquet(target).count() == (4 if step == "_copy_files" else 7)
    stm.sync_changed(spark, source, schema, target, checkpoint)
    assert spark.read.parquet(target).count() == 3


def test_retained_events_over_several_runs(spark, tmp_path, source):
    """Repeats are dropped, late ones as well, and what is older than the retention leaves the state."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    schema = spark.read.parquet(source).schema

    def run():
        stream = stm.stream_files(spark, source, schema).selectExpr("event_type AS `_kind of`", "ts", "event_id AS id")
        stm.run_available(retention.retained_changes(stream, "_kind of", "id", 10), out, checkpoint)
        log = spark.read.parquet(out)
        kept = retention.retained(log, "_kind of", "id")
        return sorted((r["id"], r["ts"].minute) for r in kept.collect()), log.filter("change = 'expired'").count()

    assert run() == ([(3, 30)], 3)
    frame(spark, [30, 33, 38, 39], "view").withColumn("event_id", F.col("event_id") + 3).write.mode("append").parquet(source)
    frame(spark, [30, 39]).withColumn("event_id", F.col("event_id") * 3 + 3).write.mode("append").parquet(source)
    # minute 30 is late by now; identifiers are told apart within a key
    assert run() == ([(3, 30), (4, 33), (5, 38), (6, 39), (6, 39)], 3)
    frame(spark, [45]).withColumn("event_id", F.col("event_id") + 4).write.mode("append").parquet(source)
    # the identifier that one key lost, another one has
    assert run() == ([(4, 45), (5, 38), (6, 39), (6, 39)], 5)


class Store:
    """A list state and its timers, with the calls that store something."""

    def __init__(self):
        self.elements, self.calls, self.timers = [], 0, []

    def getListState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 11 * 60_000

    def get(self):
        return iter(self.elements)

    def put(self, elements):
        self.elements, self.calls = elements, self.calls + 1

    def appendValue(self, element):  # noqa: N802
        self.put([*self.elements, element])

    def clear(self):
        self.put([])


def test_a_run_stores_one_element_for_a_key():
    """However many events a key has; identifiers that are unknown numbers are no repeats."""
    store, minute = Store(), 60_000_000
    kept = retention._Retention(10, "c0", T.StructField("c1", T.LongType()), ["c0", "c1"])
    kept.init(store)
    made = Row("c0", "c1", "at")
    rows = [made("k", i % 100, i * minute // 50) for i in range(150)] + [made("k", None, 0)] * 2
    out = list(kept.handleInputRows(("k",), iter(rows), store))
    assert [(r["c1"], r["change"]) for r in out] == [(i, "kept") for i in [*range(100), None, None]]
    assert (store.calls, len(store.elements)) == (1, 1)
    assert not list(kept.handleInputRows(("k",), iter(rows[:100]), store))
    assert (store.calls, store.timers) == (1, [600_001])
    gone = list(kept.handleExpiredTimer(("k",), store, None))
    assert [tuple(r) for r in gone] == [("k", i, "expired") for i in [*range(50), None, None]]
    assert (store.calls, len(store.elements), store.timers[1:]) == (2, 1, [660_001])


def test_retained_events_beside_unknown_keys(spark, tmp_path):
    """A key that is null is one of its own, and the keys beside it stay what they are."""
    data = [(i, START + timedelta(minutes=i % 40), None if i % 5 == 0 else i % 3) for i in range(400)]
    table = spark.createDataFrame(data, "id bigint, ts timestamp_ntz, kind bigint").coalesce(1)
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    table.write.parquet(source)
    stream = stm.stream_files(spark, source, table.schema)
    stm.run_available(retention.retained_changes(stream, "kind", "id", 10), out, str(tmp_path / "cp"))
    got = retention.retained(spark.read.parquet(out), "kind", "id").select("id", "kind")
    assert sorted(rows(got), key=str) == sorted([(i, k) for i, t, k in data if t.minute >= 29], key=str)
