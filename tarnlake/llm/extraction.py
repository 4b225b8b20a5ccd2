"""Main text of web pages, page by page where they are read: nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.html import main_text
from tarnlake.llm.words import ready, table, unboxed, with_fields
from tarnlake.names import quoted


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(page) if page else "" for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
            names=["_row", "_text", "_n_chars"],
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with text (empty if none) and n_chars (its code points).

    A null or empty page has an empty text; columns named like the new ones are replaced, all others stay;
    repeated rows each have a row, an empty table none.
    """
    ready(pages.sparkSession, batch_rows=256)
    others = pages.drop("html", "text", "n_chars")
    # a struct needs a field even if no other column is there
    row = F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in others.columns])
    rows = pages.select(row.alias("_row"), "html")
    found = rows.mapInArrow(_extract, with_fields(rows.drop("html"), _text="string", _n_chars="long"))
    return unboxed(found, others, text="_text", n_chars="_n_chars")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages").select("page_id", "url", "html"))
