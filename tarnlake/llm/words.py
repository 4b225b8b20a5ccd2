"""Words and their hashes as numpy arrays, and the settings that Python stages need.

A word's hash is 64 bits of xxh3; n-gram hashes are mixed polynomials of word hashes. Equality by
these hashes is wrong with a chance of about pairs / 2^64.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.names import quoted
from tarnlake.session import ship_package

#: words remembered per worker; the memory is emptied when it is full
REMEMBERED = 1 << 18

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def ready(spark: SparkSession, batch_rows: int = 256, batch_bytes: int = 4 << 20) -> None:
    """Give the workers the package and bound the batches they get, by rows and by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


class Hashes(dict):
    """bytes → 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = Hashes()


def words_of(text: bytes) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` after A-Z became a-z; both are what bytes.lower and
    bytes.split do."""
    return text.lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * MIX_1
    values = (values ^ (values >> np.uint64(27))) * MIX_2
    return values ^ (values >> np.uint64(31))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n consecutive words; none with fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    found = hashes[:count].copy()
    for j in range(1, n):
        found *= BASE
        found += hashes[j : j + count]
    return mixed(found + np.uint64(n))


def with_fields(df: DataFrame, **types: str) -> T.StructType:
    """The schema with more fields at its end."""
    schema = T.StructType([*df.schema.fields])
    for name, kind in types.items():
        schema.add(name, kind)
    return schema


def boxed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``_row``, so that a Python stage passes columns of any name through."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"))


def field_of(batch, name: str):
    """The values of one column of boxed rows."""
    rows = batch.column("_row")
    return rows.field(rows.type.get_field_index(name))


def unboxed(docs: DataFrame, like: DataFrame, **new: str) -> DataFrame:
    """The columns of ``like`` out of ``_row``, those in ``new`` (name → column) replaced or added."""
    old = [F.col(new[c]).alias(c) if c in new else F.col(f"_row.{quoted(c)}").alias(c) for c in like.columns]
    return docs.select(*old, *[F.col(v).alias(c) for c, v in new.items() if c not in like.columns])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
