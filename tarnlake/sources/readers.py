"""Table and file readers, chosen by format name or file extension."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions.text import extension
from tarnlake.sources.xlsx import read_excel

# Format of each file extension.
FORMATS = {
    ".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet",
    ".xlsx": "excel", ".xlsm": "excel", ".avro": "avro", ".orc": "orc",
}
# Binary workbooks of older and other kinds, which need their own parser.
OTHER_WORKBOOKS = (".xls", ".xlsb")


def detect_format(path: str) -> str:
    """Format of a path by its extension; an unknown extension raises."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    ext = "." + name.rsplit(".", 1)[-1] if "." in name else ""
    if ext in OTHER_WORKBOOKS:
        raise ValueError(f"{ext} workbooks are not supported: save them as .xlsx")
    if ext not in FORMATS:
        raise ValueError(f"unsupported file type {ext or name!r}")
    return FORMATS[ext]


def format_of(path: Column) -> Column:
    """Format of each path of a column by its extension, null when it is not supported."""
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.try_element_at(known, F.lower(extension(path)))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """CSV with a header row. Without a schema Spark reads the data once more to infer it, so
    pass the catalog's schema for large tables."""
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Documents that are one JSON value per file (an array gives one row per record).

    A file is parsed by one task; large data belongs in JSON lines.
    """
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(
    spark: SparkSession, path: str, sample_size: int | None = None, schema: str | None = None
) -> DataFrame:
    """JSON lines, all of them unless ``sample_size`` asks for the first ones."""
    df = (spark.read.schema(schema) if schema else spark.read).json(path)
    return df if sample_size is None else df.limit(sample_size)


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Every Parquet file of a folder (or one file)."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_avro(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Avro; needs Spark's external Avro module on the class path."""
    try:
        return spark.read.format("avro").load(path, **options)
    except PySparkException as error:
        if "avro" in str(error).lower() and "find" in str(error).lower():
            raise RuntimeError("reading Avro needs the spark-avro package") from error
        raise


def read_any(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Read a path in its format (by extension unless given)."""
    kind = format or detect_format(path)
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "json":
        return read_json(spark, path, **options)
    if kind == "jsonl":
        return read_jsonl(spark, path, None, **options)
    if kind == "excel":
        return read_excel(spark, path, **options)
    if kind == "avro":
        return read_avro(spark, path, **options)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path, **options)
    raise ValueError(f"unsupported format {kind!r}")


def preview_file(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """First rows of a file; Spark stops reading when it has them."""
    return read_any(spark, path).limit(limit)


def table(spark: SparkSession, database: str, name: str, limit: int | None = None) -> DataFrame:
    """A catalog table, whole unless a limit is given."""
    df = spark.table(f"`{database}`.`{name}`")
    return df if limit is None else df.limit(limit)


def validate_file(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """One row: is_valid, file_type, error, schema and a sample of five rows as JSON.

    Malformed CSV, JSON or JSON lines are an error here, not null rows, and the verdict rests on the whole
    file: all of it is parsed.
    """
    out = "path string, is_valid boolean, file_type string, error string, schema string, sample string"

    def verdict(ok, kind, error=None, schema=None, sample=None):
        return spark.createDataFrame([(path, ok, kind, error, schema, sample)], out)

    try:
        kind = format or detect_format(path)
    except ValueError as error:
        return verdict(False, "unknown", str(error))
    try:
        strict = {"mode": "FAILFAST"} if kind == "csv" else {}
        df = (
            spark.read.option("multiLine", kind == "json").option("mode", "FAILFAST").json(path)
            if kind in ("json", "jsonl")
            else read_any(spark, path, kind, **strict)
        )
        df.write.format("noop").mode("overwrite").save()
        sample = df.limit(5).select(F.to_json(F.struct(*df.columns)).alias("r")).collect()
        rows = "[" + ",".join(r["r"] for r in sample) + "]"
        return verdict(True, kind, None, df.schema.simpleString(), rows)
    except (PySparkException, Py4JError, RuntimeError, ValueError) as error:
        return verdict(False, kind, str(error))
