"""Recent events of a stream: each stays for a retention time after it happened, and then leaves the state.

The state of a key is the list of its events' identifiers and times. An event that is there already is a repeat. A timer
in event time stands at the oldest event's end; when the watermark passes it, all events that have ended leave the
state and are reported. So the state holds what is inside the retention and nothing else.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnlake.names import quoted
from tarnlake.streaming.events import with_event_time

#: the only state store with timers and lists
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AT = "at"


class _Retention(StatefulProcessor):
    def __init__(self, minutes: int, key: str, identifier: T.StructField, columns: list[str]):
        self.millis = minutes * 60_000
        self.key, self.identifier, self.columns = key, identifier.name, columns
        # one element for all that a run adds to a key: a call of the state store costs as much as many events
        self.schema = T.StructType(
            [T.StructField("ids", T.ArrayType(identifier.dataType)), T.StructField("ats", T.ArrayType(T.LongType()))]
        )
        # numbers: two unknown ones are not the same
        self.unknown = isinstance(identifier.dataType, (T.IntegralType, T.FloatType, T.DoubleType))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("chunks", self.schema)
        self.row = Row(*self.columns, "change")

    def _end(self, at: int) -> int:
        """The first millisecond at which an event of that time (in microseconds) is over."""
        return at // 1000 + self.millis + 1

    def _known(self) -> list[tuple]:
        return [event for ids, ats in self.events.get() for event in zip(ids, ats, strict=True)]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self._known()
        seen = {e[0] for e in known}
        oldest, ids, ats = min((e[1] for e in known), default=None), [], []
        values = None
        for row in rows:
            values = values or itemgetter(*map(row.__fields__.index, [self.identifier, AT, *self.columns]))
            identifier, at, *kept = values(row)
            if identifier in seen and not (identifier is None and self.unknown):
                continue
            seen.add(identifier)
            ids.append(identifier)
            ats.append(at)
            yield self.row(*kept, "kept")
        if ids:
            self.events.appendValue((ids, ats))
            first = min(ats)
            if oldest is None or first < oldest:
                self.handle.registerTimer(self._end(first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        over, rest = [], []
        for event in self._known():
            (over if self._end(event[1]) <= now else rest).append(event)
        if not over:
            return
        if rest:
            self.events.put([([e[0] for e in rest], [e[1] for e in rest])])
            self.handle.registerTimer(self._end(min(e[1] for e in rest)))
        else:
            self.events.clear()
        blank = dict.fromkeys(self.columns)
        for identifier, _ in over:
            gone = {**blank, self.key: key[0], self.identifier: identifier}
            yield self.row(*gone.values(), "expired")

    def close(self) -> None:
        pass


def retained_changes(
    events: DataFrame, key: str, identifier: str, minutes: int = 10, time: str = "ts", delay: str = "0 minutes"
) -> DataFrame:
    """The changes of what is retained of a stream: each event once as ``kept``, with all its columns, and, once the
    watermark (the newest time less ``delay``) is ``minutes`` past it, its key and identifier as ``expired``.

    The state is split by ``key``, and an identifier names one event of a key. Events without a time, and those that come
    when the watermark has reached their time, are left out. Needs the RocksDB state store, which is set here.
    """
    spark = events.sparkSession
    # the processor also starts beside the driver, where shipped files are not on the path
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = with_event_time(events, time).filter(F.col(quoted(time)).isNotNull())
    names = rows.columns
    # plain names inside: the workers change others
    plain = {n: f"c{i}" for i, n in enumerate(names)}
    rows = rows.toDF(*plain.values()).withWatermark(plain[time], delay)
    timed = rows.withColumns({AT: F.unix_micros(plain[time]), "by": F.col(plain[key])})
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields]
    processor = _Retention(minutes, plain[key], rows.schema[plain[identifier]], rows.columns)
    out = T.StructType([*fields, T.StructField("change", T.StringType())])
    changes = timed.groupBy("by").transformWithState(processor, out, "Append", "EventTime")
    return changes.select(*[F.col(p).alias(n) for n, p in plain.items()], "change")


def retained(changes: DataFrame, key: str, identifier: str) -> DataFrame:
    """The events of written changes that are still retained."""
    kept = changes.filter("change = 'kept'").drop("change")
    gone = changes.filter("change = 'expired'").select(F.col(quoted(key)).alias("_key"), F.col(quoted(identifier)).alias("_id"))
    same = F.col(quoted(key)).eqNullSafe(F.col("_key")) & F.col(quoted(identifier)).eqNullSafe(F.col("_id"))
    return kept.join(gone, same, "left_anti")
