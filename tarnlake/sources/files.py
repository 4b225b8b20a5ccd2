"""File discovery and the files behind a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions.text import base_name, extension
from tarnlake.sources.readers import FORMATS, format_of


def discover_files(
    spark: SparkSession, prefix: str, extensions: list[str] | None = None
) -> DataFrame:
    """Files below a prefix with name, size, modified time and format; contents are not read."""
    chosen = extensions or sorted(FORMATS)
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(prefix)
        .select("path", "length", "modificationTime")
    )
    ext = F.lower(extension(F.col("path")))
    return listing.filter(ext.isin(chosen)).select(
        "path",
        base_name(F.col("path")).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        format_of(F.col("path")).alias("format"),
    )


def table_files(df: DataFrame) -> DataFrame:
    """Files behind a file-based table, with size, modified time and rows."""
    return df.groupBy(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """MD5 of the bytes of each file; one file is one task."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))
