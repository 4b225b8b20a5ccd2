"""Files of one table that differ in format, header, folder depth or types, read as one frame.

Files with the same layout share a reader: the layout of a CSV file is its header line, that of a JSON file whether
its lines are records or the file is one document, and everywhere the ``key=value`` folders above it. Header lines are
read by the executors in one scan. The schemas of the layouts meet in the least types that hold both
(:mod:`tarnlake.operators.lattice`), and CSV and JSON are read again with that schema, so that a text stays as it was written.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.text import extension, snake_name
from tarnlake.names import quoted
from tarnlake.operators.lattice import conformed, merged_schema, nullable
from tarnlake.session import ship_package
from tarnlake.sources.readers import FORMATS, format_of
from tarnlake.sources.xlsx import excel_frames

#: folder name that Hive writes for a null
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: largest JSON document that a task holds as bytes (an array of the JVM ends at 2^31)
WHOLE_BYTES = 1 << 30
#: head of a JSON document beyond that, which is parsed from a stream
LARGE = "large document"


@dataclass
class Group:
    """Files of one table, format, head and list of partition keys."""

    table: str
    format: str
    head: str | None
    keys: tuple[str, ...]
    paths: list[str]


def heads(spark: SparkSession, prefix: str, glob: str) -> DataFrame:
    """``uri, head`` of the CSV and JSON files below a prefix whose names match: the first line that is not blank of a CSV
    file; of a JSON file ``lines`` if that line is a whole JSON value, else ``document``. Files without such a line have
    no row. One scan; of a large file, the later splits send nothing to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            uris, found = batch.column("uri").to_pylist(), []
            for k, uri in enumerate(uris):
                if uri != last:
                    last = uri
                    line = batch.column("value")[k].as_py()
                    found.append((uri, line if _is_csv(uri) else "lines" if _is_json(line) else "document"))
            if found:
                yield pa.RecordBatch.from_pydict({"uri": [f[0] for f in found], "head": [f[1] for f in found]})

    ship_package(spark)
    lines = spark.read.options(recursiveFileLookup="true", pathGlobFilter=glob).text(prefix)
    lines = lines.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("at"), "value")
    return lines.filter("at = 0 AND trim(value) <> ''").select("uri", "value").mapInArrow(run, "uri string, head string")


def _is_csv(uri: str) -> bool:
    return uri.lower().endswith(".csv")


def _is_json(line: str) -> bool:
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def escaped(path: str) -> str:
    """A path in which nothing is a wildcard."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def file_groups(spark: SparkSession, prefix: str, extensions: list[str] | None = None) -> list[Group]:
    """The files below a prefix by layout. The file or folder directly below the prefix, up to its first dot, names the
    table. Paths come to the driver, which lists files for any read; CSV and JSON files without a line are left out."""
    root = re.sub(r"^[a-z0-9]+:/*", "/", prefix).rstrip("/")
    chosen = extensions or sorted(FORMATS)
    inside = F.regexp_extract("path", rf"\Q{root}/\E(.*)$", 1)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(prefix)
        .select("path", "length", F.col("_metadata.file_path").alias("uri"))
        .filter(F.lower(extension(F.col("path"))).isin(chosen))
        .select(
            "path", "uri", format_of(F.col("path")).alias("format"),
            F.regexp_extract(inside, "^([^/]*)", 1).alias("unit"),
            F.regexp_extract_all(F.regexp_extract(inside, "^(.*/)", 1), F.lit("([^/=]+)=[^/]*/"), 1).alias("keys"),
            (F.col("length") > WHOLE_BYTES).alias("large"),
        )
    )
    lined = [e for e in chosen if FORMATS.get(e) in ("csv", "json")]
    if lined:
        files = files.join(heads(spark, prefix, any_case(lined)), "uri", "left")
    else:
        files = files.withColumn("head", F.lit(None).cast("string"))
    found = (
        files.filter("format NOT IN ('csv', 'json') OR head IS NOT NULL")
        .withColumn("head", F.when(F.expr("format <> 'csv' AND head = 'document' AND large"), LARGE).otherwise(F.col("head")))
        .groupBy("unit", "format", "head", "keys")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
        .collect()
    )
    groups: dict[tuple, Group] = {}
    for row in found:
        named = (snake_name(row["unit"].split(".")[0]), row["format"], row["head"], tuple(row["keys"]))
        groups.setdefault(named, Group(*named, [])).paths.extend(row["paths"])
    for group in groups.values():
        group.paths.sort()
    return sorted(groups.values(), key=lambda g: (g.table, g.paths[0]))


def any_case(endings: list[str]) -> str:
    """A file name pattern of some endings in any letter case."""
    either = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in sorted(endings))
    return f"*{{{either}}}"


def read_tables(spark: SparkSession, prefix: str, extensions: list[str] | None = None) -> dict[str, DataFrame]:
    """Every table below a prefix: the rows of all its files, columns matched by name, types widened."""
    tables: dict[str, list[Group]] = {}
    for group in file_groups(spark, prefix, extensions):
        tables.setdefault(group.table, []).append(group)
    return {table: _read_table(spark, groups) for table, groups in tables.items()}


def _read_table(spark: SparkSession, groups: list[Group]) -> DataFrame:
    read = [(group, frame) for group in groups for frame in _read_group(spark, group)]
    schema = merged_schema([frame.schema for _, frame in read])
    wanted = {f.name.lower(): f.dataType for f in schema.fields}
    frames = []
    for group, frame in read:
        if group.format in ("csv", "json", "jsonl") and any(nullable(f.dataType) != wanted[f.name.lower()] for f in frame.schema):
            # the column is parsed as the wider type, so that a number in a column of texts keeps its digits
            own = [f for f in frame.schema.fields if f.name not in map(unquote, group.keys)]
            fields = T.StructType([T.StructField(f.name, wanted[f.name.lower()]) for f in own])
            (frame,) = _read_group(spark, group, fields)
        frames.append(conformed(frame, schema))
    return reduce(DataFrame.unionAll, frames)


def _read_group(spark: SparkSession, group: Group, schema: T.StructType | None = None) -> list[DataFrame]:
    """The files of a group: one frame, but for formats with a schema in each file as many as have no common one.
    Malformed JSON is an error."""
    paths = [escaped(p) for p in group.paths]
    if group.format == "excel":
        return excel_frames(spark, paths)
    if group.format in ("parquet", "orc", "avro"):
        return [_with_keys(frame, group) for frame in _mergeable(spark, group.format, paths)]
    reader = spark.read.schema(schema) if schema else spark.read
    if group.format == "csv":
        found = reader.option("header", True).option("inferSchema", schema is None).csv(paths)
    else:
        found = reader.option("multiLine", group.head in ("document", LARGE)).option("mode", "FAILFAST").json(paths)
        if group.head == "document":
            # each file is one line, which ends with what no document holds: of bytes, a number that is read as text is
            # a slice, while of a stream Spark reads some kilobytes of the file again for each
            whole = spark.read.schema(found.schema).option("lineSep", f"\0{uuid.uuid4().hex}")
            found = whole.option("mode", "FAILFAST").json(paths)
    return [_with_keys(found, group)]


def _mergeable(spark: SparkSession, format: str, paths: list[str]) -> list[DataFrame]:
    """One frame if Spark can merge the files' schemas; else those of either half."""
    try:
        reader = spark.read.format(format)
        return [(reader.option("mergeSchema", True) if format != "avro" else reader).load(paths)]
    except (PySparkException, Py4JError):
        if len(paths) == 1:
            raise
        half = len(paths) // 2
        return [*_mergeable(spark, format, paths[:half]), *_mergeable(spark, format, paths[half:])]


def _with_keys(df: DataFrame, group: Group) -> DataFrame:
    """The frame with a column for each ``key=value`` folder above its files; it replaces one of the files."""
    if not group.keys:
        return df
    path = _decoded(F.col("_metadata.file_path"))
    added = {}
    for key in group.keys:
        value = _decoded(F.regexp_extract(path, rf"^.*/\Q{key}\E=([^/]*)/", 1))
        value = F.when(value != NO_VALUE, value)
        values = {unquote(re.search(rf"^.*/{re.escape(key)}=([^/]*)/", p)[1]) for p in group.paths}
        added[unquote(key)] = value.cast(_type_of(values - {NO_VALUE}))
    lower = {n.lower() for n in added}
    kept = [F.col(quoted(c)) for c in df.columns if c.lower() not in lower]
    return df.select(*kept, *[c.alias(n) for n, c in added.items()])


def _decoded(c: Column) -> Column:
    """%-codes resolved, a plus sign kept."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)


def _type_of(values: set[str]) -> str:
    if values and all(re.fullmatch(r"-?\d{1,18}", v) for v in values):
        return "bigint"
    if values and all(re.fullmatch(r"\d{4}-\d\d-\d\d", v) for v in values):
        return "date"
    return "string"
