"""Benchmark decontamination: broadcast hash set of the benchmark's n-grams, windows of the texts tested.

A window is ``window`` consecutive words of an item; an item with fewer words is one window. Workers
hold the sorted hashes of the windows with their places in the items, and a bit table over these hashes.
A text's windows are hashed with numpy; only those whose bit is set are compared word by word, so a hit
is never a hash collision.

The benchmark is measured first. Up to ``limit`` bytes it is broadcast as a whole; beyond, it is split by a
hash of the text into parts of about that size, the documents are scanned once per part, and the spans
found are merged per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.words import boxed, field_of, hashes_of, ngram_hashes, ready, table, unboxed
from tarnlake.session import keep

WINDOW = 10
#: UTF-8 bytes of benchmark texts in one broadcast
LIMIT = 8 << 20
TABLE_BITS = 22

# words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_PLACES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPANS = "array<struct<start:int,stop:int>>"


def benchmark_words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Windows:
    """The windows of some benchmark items, built once on the driver and broadcast: for each number of words the sorted
    hashes of the windows, with the item and the place of its first word. Hashes only find windows; the words of the item
    say whether they are there."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids = [item for item, _ in items]
        self.texts = [text for _, text in items]
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, text in enumerate(self.texts):
            words = benchmark_words(text)
            n = min(window, len(words))
            if n:
                found.setdefault(n, []).append((ngram_hashes(hashes_of(words), n), k))
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, parts in found.items():
            hashes = np.concatenate([h for h, _ in parts])
            owners = np.repeat(np.array([k for _, k in parts], np.int32), [len(h) for h, _ in parts])
            places = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in parts])
            order = np.argsort(hashes, kind="stable")
            self.lengths[n] = hashes[order], owners[order], places[order]
        self.bits: dict[int, np.ndarray] = {}
        self.words: dict[int, list[bytes]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "bits": {}, "words": {}}

    def _bits(self, n: int) -> np.ndarray:
        if n not in self.bits:
            self.bits[n] = np.zeros(1 << TABLE_BITS, bool)
            self.bits[n][self.lengths[n][0] >> np.uint64(64 - TABLE_BITS)] = True
        return self.bits[n]

    def _words(self, item: int) -> list[bytes]:
        if item not in self.words:
            self.words[item] = benchmark_words(self.texts[item])
        return self.words[item]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The merged spans [start, stop) of hit words, and the items whose windows occur."""
        hashes = hashes_of(words)
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        for n, (known, owners, places) in self.lengths.items():
            grams = ngram_hashes(hashes, n)
            maybe = np.flatnonzero(self._bits(n)[grams >> np.uint64(64 - TABLE_BITS)])
            low, high = (np.searchsorted(known, grams[maybe], side) for side in ("left", "right"))
            for i, a, b in zip(maybe.tolist(), low.tolist(), high.tolist(), strict=True):
                mine, hit = words[i : i + n], False
                for owner, place in zip(owners[a:b].tolist(), places[a:b].tolist(), strict=True):
                    if self._words(owner)[place : place + n] == mine:
                        hit = True
                        if self.ids[owner] is not None:
                            items.add(self.ids[owner])
                if hit:
                    hits.append((i, i + n))
        return merged(hits), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in _PLACES.finditer(text)]
    kept, at = [], 0
    for start, stop in spans:
        kept.append(text[at : places[start][0]])
        at = places[stop - 1][1]
    return b"".join([*kept, text[at:]])


def _scan(shared):
    schema = pa.schema(
        [
            ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ("items", pa.list_(pa.string())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value  # one object for all tasks of a worker
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rows: list[tuple[int, list, list]] = []
            for k in range(batch.num_rows):
                words = benchmark_words(texts[k].as_py() or b"")
                spans, items = windows.find(words)
                rows.append((len(words), [{"start": a, "stop": b} for a, b in spans], sorted(items)))
            found = [pa.array([r[i] for r in rows], schema.field(i + 2).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *found], schema=schema)

    return run


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """One row per document: row, doc_id, n_words, spans (word positions [start, stop) of hit words, merged),
    items (item_ids as strings whose windows occur, sorted).

    Null texts have no words. Items without words hit nothing; an item without an id marks words but is not
    among the items; items repeated under one id are one. Repeated documents each have a row.
    """
    spark = docs.sparkSession
    ready(spark)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // limit))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    if parts > 1:
        rows = keep(rows, "texts")  # scanned more than once under one numbering
    found = None
    for part in range(parts):
        mine = benchmark.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part) if parts > 1 else benchmark
        items = [(r[0], r[1].encode()) for r in mine.select(F.col("item_id").cast("string"), "text").collect() if r[1]]
        shared = spark.sparkContext.broadcast(Windows(items, window))
        scanned = rows.mapInArrow(
            _scan(shared), f"row long, doc_id long, n_words long, spans {SPANS}, items array<string>"
        )
        found = scanned if found is None else found.unionByName(scanned)
    if parts == 1:
        return found
    found = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return found.withColumn("spans", _merge(F.col("spans")))


def _merge(spans):
    """Sorted spans of several scans as disjoint ones."""
    start = F.array().cast(SPANS)

    def add(done, span):
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (span["start"] <= last["stop"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        # the last element is looked at only where there is one
        return F.when(
            F.size(done) == 0, F.array(span)
        ).otherwise(F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(span))))

    return F.aggregate(spans, start, add)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from the rows of ``hits``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents", limit: int = LIMIT
) -> DataFrame:
    """``docs`` without the benchmark: hit documents go (``remove="documents"``), or stay without the hit
    words (``"spans"``). All columns stay; texts are scanned where they are read, and nothing is shuffled
    (per part of a benchmark beyond ``limit``, one scan after the other). Spans of all parts are found in the
    whole texts and cut together by the last scan."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    spark = docs.sparkSession
    ready(spark)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // limit))
    rows = boxed(docs)
    if remove == "spans":
        rows = rows.withColumn("_spans", F.array().cast(SPANS))
    for part in range(parts):
        mine = benchmark.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part) if parts > 1 else benchmark
        items = [(None, r[0].encode()) for r in mine.select("text").collect() if r[0]]
        shared, last = spark.sparkContext.broadcast(Windows(items, window)), part + 1 == parts
        rows = rows.mapInArrow(_remove(shared, remove, last), rows.schema)
        rows = rows if last else keep(rows, "clean")
    return unboxed(rows, docs)


def _remove(shared, remove: str, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value  # one object for all tasks of a worker
        for batch in batches:
            texts = field_of(batch, "text").cast(pa.binary())
            spans = [windows.find(benchmark_words(t.as_py() or b""))[0] for t in texts]
            if remove == "documents":
                yield batch.filter(pa.array([not s for s in spans], pa.bool_()))
                continue
            # with those of earlier parts
            before = [[(x["start"], x["stop"]) for x in s] for s in batch.column("_spans").to_pylist()]
            spans = [merged([*a, *b]) for a, b in zip(before, spans, strict=True)]
            if not last:
                found = [[{"start": a, "stop": b} for a, b in s] for s in spans]
                found = pa.array(found, batch.schema.field("_spans").type)
                yield pa.RecordBatch.from_arrays([batch.column("_row"), found], schema=batch.schema)
                continue
            clean = [
                without_spans(t.as_py(), s).decode() if t.is_valid else None for t, s in zip(texts, spans, strict=True)
            ]
            rows = batch.column("_row")
            fields = [pa.array(clean, f.type) if f.name == "text" else rows.field(i) for i, f in enumerate(rows.type)]
            whole = pa.StructArray.from_arrays(fields, fields=list(rows.type))
            yield pa.RecordBatch.from_arrays([whole, batch.column("_spans")], schema=batch.schema)

    return run


def query(spark: SparkSession, folder: str) -> DataFrame:
    return report(hits(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
h AS (
  SELECT d.doc_id, i, x.n, x.item_id
  FROM (SELECT DISTINCT n FROM x) AS s, d, unnest(range(1, len(w) - s.n + 2)) AS t(i), x
  WHERE len(w) >= s.n AND x.n = s.n AND x.k = array_to_string(w[i : i + s.n - 1], ' ')),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
m AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""
