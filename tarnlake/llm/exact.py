"""Exact dedup: deterministic block naming, identities without any chance of a collision.

Each normalised text is cut into blocks of fixed size. All blocks are sorted, and a block's name is
its rank among the different blocks. Then adjacent names are paired, pairs are sorted and named in
the same way, and so on: after log2(blocks) rounds each document has one integer. Two documents have
the same name after the same number of rounds exactly when their blocks are the same.

Naming deals rows out by ranges of the value (of a block's digest), ties separated by row, so many copies of one block lie
in many tasks. A task streams its sorted rows and numbers the values it meets; what continues the
last value of the range before is seen from one row per range. Block contents travel once; everything
after that is integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.words import ready, table
from tarnlake.names import quoted
from tarnlake.session import keep

#: bytes of a block
BLOCK = 512
#: what normalisation deletes
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: groups with at least this many rows, and this share of all rows, are broadcast: at most MOST_LARGE groups
FEW, MOST_LARGE = 256, 1 << 12
#: the partner of a name without one
NOBODY = -1


def _blocks(block: int):
    schema = pa.schema(
        [
            ("row", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("text_sha256", pa.string()),
            ("n", pa.int64()), ("i", pa.int64()), ("value", pa.binary()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            held = 0
            ids, rows, lengths = (batch.column(c).to_pylist() for c in ("doc_id", "row", "n_chars"))
            texts = batch.column("text").cast(pa.binary())
            for k in range(batch.num_rows):
                text = (texts[k].as_py() or b"").translate(None, SPACES)
                n = max(1, -(-len(text) // block))
                facts = (rows[k], ids[k], lengths[k], hashlib.sha256(text).hexdigest(), n)
                for i in range(n):
                    # facts ride on the first block only
                    row = (*(facts if i == 0 else (rows[k], None, None, None, n)), i, text[i * block : (i + 1) * block])
                    for column, v in zip(columns, row, strict=True):
                        column.append(v)
                    held += block
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                        columns, held = [[] for _ in schema], 0
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return cut


def _number(values: list[str]):
    """Streams sorted rows: the rank of each row's value among the different values of this task.
    The values leave, but for the first row's and one more row with the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank, schema, part = None, -1, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(v).to_pylist() for v in values]
            keys = list(zip(*columns, strict=True))
            ranks = np.empty(len(keys), np.int64)
            edges: list[str | None] = [None] * len(keys)
            if last is None:
                edges[0] = "first"
            for k, key in enumerate(keys):
                if key != last:
                    rank, last = rank + 1, key
                ranks[k] = rank
            schema, part = batch.schema, batch.column("part")[0].as_py()
            out = {}
            for name in schema.names:
                if name in values:
                    kept = [edges[0] and batch.column(name)[0].as_py()] + [None] * (len(keys) - 1)
                    out[name] = pa.array(kept if edges[0] else [None] * len(keys), schema.field(name).type)
                else:
                    out[name] = batch.column(name)
            yield pa.RecordBatch.from_pydict({**out, "rank": pa.array(ranks), "edge": pa.array(edges, pa.string())})
        if last is not None:
            row = dict.fromkeys(schema.names) | dict(zip(values, last, strict=True)) | {"part": part}
            end = {n: pa.array([v], schema.field(n).type) for n, v in row.items()}
            yield pa.RecordBatch.from_pydict({**end, "rank": pa.array([rank]), "edge": pa.array(["last"], pa.string())})

    return run


def named(df: DataFrame, values: list[str], ties: list[str], by_digest: bool = False) -> DataFrame:
    """``df`` without ``values``, with ``name``: the rank (from 0) of the values among all different
    values in the table. ``ties`` separate rows with equal values.

    ``by_digest`` is for one long value: rows are ranked by its SHA-256 before the value, so that the sample of which
    Spark makes the ranges holds digests and not values. Values are compared as a whole all the same.
    """
    first = [F.sha2(F.col(values[0]), 256)] if by_digest else [F.col(c) for c in values]
    ties_of = [F.col(c) for c in ties]
    ranged = df.repartitionByRange(*first, *ties_of).withColumn("part", F.spark_partition_id())
    sorted_rows = ranged.sortWithinPartitions(*first, *map(F.col, values), *ties_of)
    schema = T.StructType([*sorted_rows.schema.fields])
    for field in schema.fields:
        field.nullable = True
    schema = schema.add("rank", "long").add("edge", "string")
    local = keep(sorted_rows.mapInArrow(_number(values), schema), "names")

    value = F.struct(*values)
    ends = (
        local.filter("edge IS NOT NULL")
        .groupBy("part")
        .agg(
            F.max(F.when(F.col("edge") == "first", value)).alias("first"),
            F.max(F.when(F.col("edge") == "last", value)).alias("last"),
            (F.max("rank") + 1).alias("different"),
        )
    )  # one row for each range
    order = Window.orderBy("part")
    starts = (
        ends.withColumn("again", F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(order)), F.lit(False)).cast("long"))
        .withColumn("start", F.sum(F.col("different")).over(order) - F.col("different") - F.sum("again").over(order))
        .select("part", "start")
    )
    return (
        local.filter("edge IS NULL OR edge = 'first'")
        .join(starts, "part")
        .select(*[c for c in df.columns if c not in values], (F.col("start") + F.col("rank")).alias("name"))
    )


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: row, doc_id, n_chars, text_sha256, rounds, name. Two rows hold the same
    normalised text exactly when (rounds, name) are equal."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"),
        "text",
    )
    blocks = rows.mapInArrow(
        _blocks(block),
        "row long, doc_id long, n_chars long, text_sha256 string, n long, i long, value binary",
    )
    # every row of the plan below starts from files: the first naming keeps its result
    names = keep(named(blocks, ["value"], ["row", "i"], by_digest=True), "round")
    most = names.agg(F.max("n")).first()[0] or 1
    facts = names.filter("i = 0").select("row", "doc_id", "n_chars", "text_sha256")
    single = names.filter("n = 1").select("row", F.lit(0).alias("rounds"), "name")
    rounds, done = 0, [single]
    while most > 1:
        rounds += 1
        most = -(-most // 2)
        half = F.floor(F.col("i") / 2).cast("long")
        side = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = (
            names.filter("n > 1")
            .groupBy("row", F.ceil(F.col("n") / 2).cast("long").alias("n"), half.alias("i"))
            .agg(side(0).alias("a"), F.coalesce(side(1), F.lit(NOBODY)).alias("b"))
        )
        names = keep(named(pairs, ["a", "b"], ["row", "i"]), "round")
        done.append(names.filter("n = 1").select("row", F.lit(rounds).alias("rounds"), "name"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return facts.join(found, "row")


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; null counts as empty, and
    empty texts are one group. The row with the most code points stays, then the smallest doc_id (a
    null id last); of rows repeated with the same id and length one stays. An empty table gives no
    rows; other columns are not read.
    """
    return _judged(docs, block).drop("n_chars")


def _judged(docs: DataFrame, block: int) -> DataFrame:
    found = keep(identities(docs, block), "identities")
    # larger is better: more code points, then a smaller id, then an earlier row
    rank = F.struct("n_chars", (-F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))).alias("id"), (-F.col("row")).alias("row"))
    groups = keep(
        found.groupBy("rounds", "name")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct(rank.alias("rank"), "doc_id")).alias("best"))
        .filter("group_size > 1"),
        "groups",
    )
    # of groups with a share of the rows there are few: their results go to the rows, which stay where they are
    large = F.col("group_size") >= max(FEW, found.count() // MOST_LARGE)
    few = F.broadcast(groups.filter(large))
    rows = found.join(few, ["rounds", "name"])
    rest = found.join(few.select("rounds", "name"), ["rounds", "name"], "left_anti")
    rows = rows.unionByName(rest.join(groups.filter(~large), ["rounds", "name"], "left"))
    return rows.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("best.rank.row") == -F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def without_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents that stay, with all their columns: exactly one row of each different text, whatever the ids are."""
    kept = _judged(docs, block).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text"), F.col("n_chars").alias("_n")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"),
        F.col("doc_id").cast("long").alias("_doc"),
        F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""), 256).alias("_own"),
        F.char_length(text).cast("long").alias("_size"),
    )
    same = (F.col("_own") == F.col("_text")) & (F.col("_size") == F.col("_n")) & F.col("_doc").eqNullSafe(F.col("_id"))
    # rows that agree in all of these are repeats, of which any may stay
    stay = rows.join(kept, same, "left_semi").dropDuplicates(["_own"])
    return stay.select(*[F.col(f"_row.{quoted(c)}").alias(c) for c in docs.columns])


def query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM r
"""
