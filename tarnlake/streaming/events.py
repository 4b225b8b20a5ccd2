"""Event streams: counts per minute, recent events, failures, and syncing only what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnlake.session import keep
from tarnlake.sources.layouts import escaped
from tarnlake.sources.writers import path_exists, remove_path


def stream_files(spark: SparkSession, path: str, schema: StructType, format: str = "parquet") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(format).load(path)


def with_event_time(df: DataFrame, time: str = "ts") -> DataFrame:
    """Event time as an instant; watermarks do not accept zone-less timestamps."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def _counts(df: DataFrame, window: Column, by: list[str]) -> DataFrame:
    return (
        df.groupBy(window.alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")
    )


def event_counts(
    df: DataFrame, width: str = "1 minute", delay: str = "10 minutes",
    time: str = "ts", by: str = "event_type",
) -> DataFrame:
    """Tumbling counts per event type; later events than ``delay`` are left out of a stream.

    Works on a stream and, with the same result for all events, on a table.
    """
    events = with_event_time(df, time)
    if events.isStreaming:
        events = events.withWatermark(time, delay)
    return _counts(events, F.window(time, width), [by])


def failures(
    df: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", delay: str = "10 minutes",
    time: str = "ts", kind: str = "event_type", failed: str = "error",
) -> DataFrame:
    """Sliding counts of failed events, for a stream or a table."""
    events = with_event_time(df, time).filter(F.col(kind) == failed)
    if events.isStreaming:
        events = events.withWatermark(time, delay)
    return _counts(events, F.window(time, width, slide), [])


def recent(df: DataFrame, minutes: int = 10, time: str = "ts") -> DataFrame:
    """Events of a table not older than ``minutes`` before its newest one, newest first."""
    newest = df.agg(F.max(time).cast("string")).first()[0]
    if newest is None:
        return df
    # a constant bound reaches the Parquet scan, which then skips all older row groups
    bound = F.lit(newest).cast(df.schema[time].dataType) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return df.filter(F.col(time) >= bound).orderBy(F.col(time).desc())


def recent_stream(df: DataFrame, minutes: int = 10, time: str = "ts", identifier: str = "event_id") -> DataFrame:
    """A stream without repeats: an event is dropped if one of its identifier came within ``minutes``, or if it is later
    than that. What is retained at any time is kept by :mod:`tarnlake.streaming.retention`."""
    events = with_event_time(df, time).withWatermark(time, f"{int(minutes)} minutes")
    return events.dropDuplicatesWithinWatermark([identifier])


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, write Parquet, and stop."""
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def sync_changed(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str
) -> dict[str, int]:
    """Bring the target table folder to the files of the source as they are now; returns how many were new, changed
    and gone.

    Each source file owns one partition (``file=``, a digest of its path) of the target. A manifest in ``checkpoint``
    holds path, size and time of the files as of the last run; new, changed and gone files are its differences to
    the listing. Only their partitions are replaced or removed, and the manifest follows last: a run that fails, at any
    step, leaves the other partitions as they are and is made up for by the next one.
    """
    listing = _listing(spark, source).select("path", "length", "modificationTime", F.md5("path").alias("file"))
    manifest = f"{checkpoint.rstrip('/')}/manifest"
    known, run = listing.limit(0), 0
    if path_exists(spark, manifest):
        runs = spark.read.parquet(manifest)
        run = runs.agg(F.max("run")).first()[0] or 0
        known = runs.filter(F.col("run") == run).drop("run")
    listing = keep(listing, "listing")  # one listing decides
    old = known.select("file", F.struct("length", "modificationTime").alias("was"))
    both = listing.select("file", "path", F.struct("length", "modificationTime").alias("now")).join(old, "file", "full")
    changes = both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("file", "path", "was", "now").collect()
    gone = [c["file"] for c in changes if c["now"] is None]
    fresh = [c for c in changes if c["now"] is not None]
    if fresh:
        _copy_files(spark, [c["path"] for c in fresh], schema, target, {c["file"] for c in fresh if c["was"] is not None})
    for file in gone:
        remove_path(spark, f"{target}/file={file}")
    if changes or not run:
        listing.withColumn("run", F.lit(run + 1)).write.mode("append").partitionBy("run").parquet(manifest)
        if run:
            remove_path(spark, f"{manifest}/run={run}")
    new = sum(c["was"] is None for c in fresh)
    return {"new": new, "changed": len(fresh) - new, "gone": len(gone)}


def _copy_files(spark: SparkSession, paths: list[str], schema: StructType, target: str, known: set[str]) -> None:
    """Write each file's rows into its partition; a known file that has no rows any more loses its partition."""
    uri = F.regexp_replace("_metadata.file_path", r"\+", "%2B")
    path = F.regexp_replace(F.url_decode(uri), "^file:/+", "file:/")
    rows = spark.read.schema(schema).parquet(*map(escaped, paths)).withColumn("file", F.md5(path))
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("file")
        .parquet(target)
    )
    if known:
        filled = {r["file"] for r in rows.select("file").distinct().collect()}
        for file in known - filled:
            remove_path(spark, f"{target}/file={file}")


def _listing(spark: SparkSession, source: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    return files.select("path", "length", "modificationTime")
