import pytest
from pyspark.sql import types as T

#: nulls in every column, empty, blank and long texts, repeated rows, copies, no letters, accents
ROWS = [
    (1, "The cat sat on the mat and looked at the old dog for a while", "en", "a", "x"),
    (2, "The cat sat on the mat and looked at the old dog for a while", "en", "a", "x"),
    (2, "The cat sat on the mat and looked at the old dog for a while", "en", "a", "x"),
    (3, "the  cat\tsat on the mat\n and looked at the old dog for a while ", None, "b", None),
    (4, None, "en", None, None),
    (5, "", "de", "b", "y"),
    (6, " \t\n ", None, "b", "y"),
    (7, "Der Hund schläft unter dem Tisch und träumt von einem großen Knochen im Garten", "de", "b", "y"),
    (8, "12 345 --- !!!", "de", "c", "y"),
    (9, "don't <|endoftext|> it's O'Neil's, naïve İstanbul ÉCOLE straße x\u2003y \U0001f600 café\u0301", "fr", "c", "y"),
    (10, "word " * 3000 + "end", "en", "a", "y"),
    (11, "one two three", "en", "a", "y"),
    (12, "one two three", "en", None, "y"),
    (None, "a row without an id that still has ten words and some more of them", "en", "a", "y"),
]
SCHEMA = "doc_id long, text string, lang string, source string, `shard.a b` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that may go wrong, and an extra column with an awkward name."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def items(spark):
    rows = [
        (1, "sat on the mat and looked at the old dog for a very long time"),
        (1, "sat on the mat and looked at the old dog for a very long time"),
        (2, "One, two!"),
        (3, None),
        (4, "..."),
        (None, "ten words and some more"),
        (20, "one two"),
    ]
    return spark.createDataFrame(rows, T.StructType().add("item_id", "long").add("text", "string"))
