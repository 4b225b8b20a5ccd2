"""Ranked lexical search: accumulator-limited term-at-a-time scoring of blocks of documents.

The items' words are broadcast, after their size was measured. One scan counts, over all documents, how many
there are, how many words they have, and how many hold each of the items' words. A second scan reads the texts
again: each task collects postings of the items' words for one block of documents after the other, sorted by word,
and scores the block item by item:

* words are taken rarest first; each adds to the accumulators of the documents that hold it;
* before each word, the most that this and the remaining words can add in the block is compared with the kth best
  score so far (partial scores of the block, whole scores of the task's earlier blocks). Once it is less, a document
  without an accumulator cannot enter the result any more, also not by a tie, and none is created from then on;
* the remaining words add to the accumulators that are there, so their scores are exact.

A task keeps k documents per item; these few rows are ranked by a window. Texts are not shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm.words import ready, table

#: documents per item
TOP = 20
#: UTF-8 bytes of item texts in one broadcast; more items are searched in parts of about that size
LIMIT = 4 << 20
#: postings of a block (about 40 bytes each)
BLOCK = 1 << 21

# terms are runs of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F] after A-Z became a-z
_TERMS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Items:
    """The words of some items: ``numbers`` gives each a number, ``items`` lists (word, occurrences) per item."""

    def __init__(self, texts: list[str]):
        self.numbers: dict[bytes, int] = {}
        self.items = [
            [(self.numbers.setdefault(term, len(self.numbers)), n) for term, n in Counter(terms_of(text)).items()]
            for text in texts
        ]

    def postings(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of words of a text; the items' words among them, ascending, and how often each occurs."""
        words = terms_of(text)
        found = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))
        terms, counts = np.unique(found[found >= 0], return_counts=True)
        return len(words), terms, counts


def _count(shared):
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        holding = np.zeros(len(items.numbers) + 2, np.int64)  # the last two: documents with words, and their words
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n, terms, _ = items.postings(text)
                holding[terms] += 1
                holding[-2:] += (n > 0, n)
        found = np.flatnonzero(holding)
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(holding[part])], schema=schema)

    return run


class Ranking:
    """Weights of the items' words, and what a document's length does to its scores."""

    def __init__(self, items: Items, holding: np.ndarray):
        self.items = items
        self.documents, self.length = (int(x) for x in holding[-2:])
        self.weights = np.array([weight(self.documents, int(df)) for df in holding[:-2]], np.int64)
        # rarest first; words without weight or document add nothing
        order = np.lexsort((np.arange(len(holding) - 2), holding[:-2]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        useful = (self.weights > 0) & (holding[:-2] > 0)
        self.queries = [
            sorted(((t, n) for t, n in item if useful[t]), key=lambda x: place[x[0]]) for item in items.items
        ]

    def penalty(self, n: int) -> int:
        return 100 - 25 + (25 * n * self.documents) // self.length if self.length else 75


class Best:
    """The k best (score, doc_id) per item so far: higher scores, then smaller ids; a missing id is the last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = [np.empty(0, np.int64)] * items
        self.ids = [np.empty(0, np.int64)] * items
        self.missing = [np.empty(0, bool)] * items

    def kth(self, item: int) -> int:
        """A score that a document must reach; 1 while fewer than k are known."""
        return int(self.scores[item][-1]) if len(self.scores[item]) == self.k else 1

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores = np.concatenate([self.scores[item], scores])
        ids = np.concatenate([self.ids[item], ids])
        missing = np.concatenate([self.missing[item], missing])
        best = np.lexsort((ids, missing, -scores))[: self.k]
        self.scores[item], self.ids[item], self.missing[item] = scores[best], ids[best], missing[best]


class Block:
    """Postings of some documents by word: for each the documents in ascending order and what it adds per unit of weight."""

    def __init__(self, documents: np.ndarray, terms: np.ndarray, counts: np.ndarray, penalties: np.ndarray, words: int):
        order = np.argsort(terms, kind="stable")
        self.size = len(penalties)
        self.documents = documents[order]
        counts = counts[order].astype(np.int64)
        self.adds = 1_000_000_000 * counts // (1000 * counts + 12 * penalties[self.documents])
        self.starts = np.searchsorted(terms[order], np.arange(words + 1))
        self.most = np.zeros(words, np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.adds, self.starts[held])

    def scores(self, query: list[tuple[int, int]], weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best k, and their exact scores. ``floor``: a score that must be reached."""
        bounds = [n * int(weights[t] * self.most[t]) for t, n in query]
        remaining = sum(bounds)
        totals = np.zeros(self.size, np.int64)
        alive = None  # the documents with an accumulator, once no more are created
        for (t, n), bound in zip(query, bounds, strict=True):
            if not bound:
                continue
            if alive is None:
                if remaining >= floor and np.count_nonzero(totals) >= k:
                    floor = max(floor, int(np.partition(totals, self.size - k)[self.size - k]))
                if remaining < floor:
                    alive = np.flatnonzero(totals)
            here = slice(self.starts[t], self.starts[t + 1])
            holding, adds = self.documents[here], self.adds[here]
            if alive is None:
                totals[holding] += n * weights[t] * adds
            elif len(alive) * 8 < len(holding):
                at = np.minimum(np.searchsorted(holding, alive), len(holding) - 1)
                has = holding[at] == alive
                totals[alive[has]] += n * weights[t] * adds[at[has]]
            else:
                has = totals[holding] > 0
                totals[holding[has]] += n * weights[t] * adds[has]
            remaining -= bound
        found = np.flatnonzero(totals >= floor)
        if len(found) > k:
            least = np.partition(totals[found], len(found) - k)[len(found) - k]
            found = found[totals[found] >= least]
        return found, totals[found]


def _rank(shared, k: int, block: int):
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking: Ranking = shared.value
        items, best = ranking.items, Best(len(ranking.queries), k)
        ids, penalties, terms, counts = [], [], [], []
        many = 0

        def close() -> None:
            documents = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            found = Block(documents, np.concatenate(terms), np.concatenate(counts), np.array(penalties, np.int64), len(items.numbers))
            missing = np.array([i is None for i in ids])
            known = np.array([0 if i is None else i for i in ids], np.int64)
            for item, query in enumerate(ranking.queries):
                at, scores = found.scores(query, ranking.weights, k, best.kth(item))
                if len(at):
                    best.add(item, scores, known[at], missing[at])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, found, times = items.postings(text)
                if len(found):
                    ids.append(doc_id)
                    penalties.append(ranking.penalty(n))
                    terms.append(found)
                    counts.append(times)
                    many += len(found)
                if many >= block:
                    close()
                    ids, penalties, terms, counts, many = [], [], [], [], 0
        if many:
            close()
        for item in range(len(ranking.queries)):
            if len(best.ids[item]):
                rows = [pa.array(np.full(len(best.ids[item]), item, np.int32)), pa.array(best.ids[item], mask=best.missing[item])]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(best.scores[item])], schema=schema)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents for each item, with a score above 0.

    Each different (item_id, text) is one item; items without a word, or of whose words no document has one, have
    no rows. Null and empty texts match nothing. Repeated documents count, and are ranked, once per row; documents
    without an id come last among equal scores. The items are measured first and searched in parts of about ``limit``
    bytes, the documents being read twice for each part; what a part sends to the driver is one number per different word.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    items = items.select("item_id", "text").filter("octet_length(text) > 0").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // limit))
    results = []
    for part in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        rows = mine.collect()
        found = Items([r["text"] for r in rows])
        counted = docs.select("text").mapInArrow(_count(spark.sparkContext.broadcast(found)), "term int, n long")
        counted = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        holding = np.zeros(len(found.numbers) + 2, np.int64)
        holding[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
        shared = spark.sparkContext.broadcast(Ranking(found, holding))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        ranked = docs.mapInArrow(_rank(shared, k, block), "item int, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        results.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found


def query(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
c AS (SELECT count(*) AS documents, sum(len(words))::BIGINT AS length FROM d WHERE len(words) > 0),
t AS (SELECT doc_id, len(words) AS n, term, count(*) AS tf FROM d, unnest(words) AS u(term) GROUP BY ALL),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark),
q AS (SELECT item_id, term, count(*) AS repeats FROM i, unnest(words) AS u(term) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, documents),
s AS (
  SELECT item_id, doc_id,
         sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * documents) // length))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
