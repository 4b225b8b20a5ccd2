"""Token ids in binary files: Simple-8b words in blocks of whole documents.

Texts are encoded where they are read; what is shuffled is packed. Documents are dealt out by ranges of
doc_id whose bounds come from one pass over the ids alone, so encoding runs once. Each range is one
file: a table whose rows are blocks, in the order of (part, block), written by Spark's committer, so a
lost task leaves nothing behind. A block holds

    doc_ids, lengths   its documents and their number of ids
    word_at            the first word of each document in the block
    escapes            the words that are escapes
    words              64-bit little-endian Simple-8b words

so a reader decodes a block at once with numpy, or one document alone.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import simple8b
from tarnlake.llm.words import ready, table
from tarnlake.operators.running import running_totals
from tarnlake.session import work_path

END_ID = 1
#: words after which a block ends; a longer document is a block of its own
BLOCK_WORDS = 1 << 16
#: encoded pieces remembered per worker, in two generations
REMEMBERED = 3 << 17

_encoders: dict[int, Encoder] = {}


class Encoder(dict):
    """White-space separated piece (bytes) → its ids (32 bit, little-endian as on all Spark hosts), remembered.

    The tokenizer never joins characters across ASCII white space, so a text's ids are those of its pieces
    in a row. Of a piece not seen before, closing punctuation is encoded apart from a word of letters, which
    the tokenizer separates as well, and so new words are few. ``simple`` says whether the tokenizer is
    of that kind; any other gets whole texts.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.old: dict[bytes, bytes] = {}
        # how the splitter spells the letters up to U+00FF, which normalisation only puts in lower case
        split = self.tokenizer.pre_tokenizer
        letters = [c for c in map(chr, range(256)) if c.isalpha() and c.lower() == c]
        self.spelled = {c: "".join(p for p, _ in split.pre_tokenize_str(c)) for c in letters} if split else {}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = ["it's  a\ttést, (x1) don't", "Éa,b ß!! a", "a\n\nb c"]
        self.simple = all(
            self.slow(p.encode()) == b"".join(self.piece(x) for x in p.encode().split()) for p in probe
        )

    def slow(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.piece(piece)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found

    def piece(self, piece: bytes) -> bytes:
        if piece.isalpha():  # ASCII letters: nothing to normalise but their case, nothing to split
            low = piece.lower()
            return self[low] if low != piece else self.word(piece.decode())
        if piece[:-1].isalpha() and piece[-1:] in _MARKS:
            return self[piece[:-1].lower()] + self[piece[-1:]]
        if b"'" in piece or b"<|" in piece:
            return self.slow(piece)
        m = _WORD_AND_MARKS.fullmatch(piece)
        word = m[1].decode("utf-8", "replace").lower() if m else ""
        if not word or not all(map(self.spelled.__contains__, word)):
            return self.slow(piece)
        if m[2]:
            return self[m[1]] + self[m[2]]
        return self.word("".join(map(self.spelled.__getitem__, word)))

    def word(self, spelled: str) -> bytes:
        """A word as the splitter hands it to the model."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def text(self, text: bytes) -> bytes:
        if not self.simple or any(s in text for s in self.special):
            return self.slow(text)
        # in lower case there are fewer pieces; not where that could make a special token, or change how a letter
        # joins a combining mark (U+0300 to U+036F)
        if not (b"<|" in text or b"\xcc" in text or b"\xcd" in text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


_MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))
_WORD_AND_MARKS = re.compile(rb"([^!-@\[-`{-~]+)([!-/:-@\[-`{-~]*)", re.S)


def _encoder(content: str) -> Encoder:
    key = hash(content)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content)
    return _encoders[key]


def _pack(content, end_id: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("words", pa.binary()), ("escapes", pa.list_(pa.int64()))]
    )
    end = np.array([end_id], "<u4").tobytes()

    def packed(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(h[2] for h in held), "<u4").astype(np.uint64)
        lengths = np.array([len(h[2]) // 4 for h in held], np.int64)
        words, many, escapes = simple8b.encode(ids, np.cumsum(lengths))
        data, ends = words.astype("<u8").tobytes(), np.cumsum(many)
        cuts = np.searchsorted(escapes, ends)
        rows = [
            data[8 * (e - m) : 8 * e] for e, m in zip(ends.tolist(), many.tolist(), strict=True)
        ]
        at = [(escapes[a:b] - (e - m)).tolist() for a, b, e, m in zip([0, *cuts[:-1]], cuts, ends, many, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array(lengths),
             pa.array(rows, pa.binary()), pa.array(at, pa.list_(pa.int64()))], schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for k in range(batch.num_rows):
                coded = encoder.text(texts[k].as_py() or b"") + end
                held.append((ids[k], rows[k], coded))
                size += len(coded)
                if size >= 4 << 20:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


BLOCK_SCHEMA = (
    "part int, block int, n_ids long, doc_ids array<long>, lengths array<long>, word_at array<long>, "
    "escapes array<long>, words binary"
)


def _blocks(limit: int):
    def block(part: int, number: int, held: list) -> pa.RecordBatch:
        sizes = np.array([len(h[2]) // 8 for h in held], np.int64)
        at = np.cumsum(sizes) - sizes
        escapes = [int(a) + e for a, h in zip(at, held, strict=True) for e in h[3]]
        many = [h[1] for h in held]
        row = [part, number, sum(many), [h[0] for h in held], many, at.tolist(), escapes, b"".join(h[2] for h in held)]
        types = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]
        names = "part block n_ids doc_ids lengths word_at escapes words".split()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part, number = [], 0, None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "words", "escapes")]
            for p, *row in zip(*columns, strict=True):
                if held and (p != part or size >= 8 * limit):
                    yield block(part, number, held)
                    held, size, number = [], 0, number + 1 if p == part else 0
                part = p
                held.append(row)
                size += len(row[2])
        if held:
            yield block(part, number, held)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None) -> None:
    """Write the ids of every text to ``path``, documents in ascending doc_id order (null first).

    ``tokenizer`` is the path of a ``tokenizers`` file, read once here and sent to the workers. Null texts
    are empty and still get ``end_id``. Rows with the same doc_id each have a place; so many of them that
    they fill whole ranges are spread over these. Extra columns are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    with open(tokenizer, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())  # one vocabulary file
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shares = [i / parts for i in range(1, parts)] or [0.5]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts))).first()[0] or []
    low = F.array(*[F.lit(int(b)) for b in bounds]) if bounds else F.array().cast("array<long>")
    below = F.size(F.filter(low, lambda b: b < F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))))
    upto = F.size(F.filter(low, lambda b: b <= F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))))
    part = below + F.pmod(F.hash("row"), upto - below + 1)
    (
        rows.withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(_pack(content, end_id), "doc_id long, row long, n_tokens long, words binary, escapes array<long>")
        .withColumn("part", part.cast("int"))
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "words")
        .mapInArrow(_blocks(BLOCK_WORDS), BLOCK_SCHEMA)
        .write.parquet(path)
    )


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "block", "doc_ids", "lengths", "word_at", "escapes", "words")]
        for part, block, doc_ids, lengths, word_at, escapes, words in zip(*columns, strict=True):
            ids, starts = simple8b.decode(np.frombuffer(words, "<u8").astype(np.uint64), np.array(escapes, np.int64))
            ids = ids.astype("<u4")
            first = starts[np.array(word_at, np.int64)].tolist()
            many = np.array(lengths, np.int64)
            n = len(doc_ids)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part] * n, pa.int32()),
                    "block": pa.array([block] * n, pa.int32()),
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "before": pa.array(np.cumsum(many) - many),
                    "n_tokens": pa.array(many),
                    "ids": pa.array([ids[a : a + k].tobytes() for a, k in zip(first, lengths, strict=True)], pa.binary()),
                }
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, block, doc_id, before (ids of the block before the document), n_tokens, ids (little-endian
    unsigned 32 bit) of every document in the files."""
    ready(spark, batch_rows=4)  # a row is a block here
    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(
        _unpack, "part int, block int, doc_id long, before long, n_tokens long, ids binary"
    )


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it in the files), n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).select("part", "block", "n_ids")
    starts = running_totals(blocks, [], ["part", "block"], {"at": "n_ids"}).drop("n_ids")
    docs = read_tokens(spark, path).select(
        "part", "block", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
    return docs.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = work_path(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), path, str(public_tokenizers.path("word_bpe_49k.json")))
    return document_index(spark, path)
