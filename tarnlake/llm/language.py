"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text's letters (in lower case; runs of anything else are one space) give character n-grams that are
hashed into buckets. Training counts buckets per language where the texts are read, adds the counts up
in Spark, and turns them into one matrix of log-probabilities of bounded size, which is broadcast. A text's
score per language is the sum of the matrix rows of its n-grams, in numpy, a slice of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.words import boxed, field_of, ready, table, unboxed, with_fields

ORDERS = (2, 3, 4)
#: buckets times languages is at most 2^CELL_BITS (float64: 32 MB), buckets at most 2^BUCKET_BITS
CELL_BITS = 22
BUCKET_BITS = 16
#: added to every count
SMOOTHING = 0.5
#: characters looked at at once
SLICE = 1 << 16
UNKNOWN = "und"
#: a text is in none of the languages if its n-grams are this far from what the model has of its best one, on the way to
#: buckets drawn at random; of fewer n-grams than JUDGED nothing is said
MISFIT = 0.7
JUDGED = 64

_LETTER = regex.compile(r"\p{L}")
_OTHERS = regex.compile(r"[^\p{L}\p{M}]+")


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def buckets(text: str, bits: int) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, slice by slice; slices overlap by what an n-gram needs."""
    clean = f" {_OTHERS.sub(' ', text.lower()).strip()} "
    longest = max(ORDERS)
    for start in range(0, max(1, len(clean) - longest + 1), SLICE):
        piece = clean[start : start + SLICE + longest - 1]
        last = start + SLICE >= len(clean) - longest + 1
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        for n in ORDERS:
            count = len(codes) - n + 1 if last else SLICE
            if count <= 0:
                continue
            h = np.full(count, n, np.uint64)
            for j in range(n):
                h = (h ^ codes[j : j + count]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


class Model:
    """Languages in code-point order, and log-probabilities: one row per bucket, one column per language."""

    def __init__(self, languages: list[str], counts: np.ndarray, texts: np.ndarray):
        self.languages = languages
        self.bits = int(counts.shape[0]).bit_length() - 1
        smooth = counts + SMOOTHING
        self.logs = np.log(smooth / smooth.sum(axis=0))
        self.prior = np.log(texts / texts.sum())
        # mean log-probability of an n-gram of the training texts, and of a bucket drawn at random
        self.own = (np.exp(self.logs) * self.logs).sum(axis=0)
        self.chance = self.logs.mean(axis=0)

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The most probable language (the first of those that tie), its posterior probability, and its misfit.

        The misfit is where the mean log-probability of the text's n-grams lies between that of the training texts (0) and
        chance (1). Among few languages the posterior of any longer text is near 1, also of one in none of them.
        """
        if not self.languages or not text or not has_letter(text):
            return UNKNOWN, 0.0, 1.0
        total, many = np.zeros(len(self.languages)), 0
        for found in buckets(text, self.bits):
            total += self.logs[found].sum(axis=0)
            many += len(found)
        score = self.prior + total
        best = int(score.argmax())
        posterior = float(1.0 / np.exp(score - score[best]).sum())
        if many < JUDGED:
            return self.languages[best], posterior, 0.0
        misfit = (self.own[best] - total[best] / many) / max(self.own[best] - self.chance[best], 1e-9)
        return self.languages[best], posterior, float(misfit)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def _count(places: dict[str, int], bits: int):
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(places), 1 << bits), np.int64)
        for batch in batches:
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                row = counts[places[language]]
                for found in buckets(text, bits):
                    row += np.bincount(found, minlength=1 << bits)
        cells = np.flatnonzero(counts)
        for at in range(0, len(cells), 1 << 16):
            part = cells[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts.ravel()[part])], schema=schema)

    return run


def train(labelled: DataFrame) -> Model:
    """A model from all rows with a text and a ``lang``.

    The number of languages is measured first and sets the number of buckets, so that the matrix and the
    counts that reach the driver are bounded; more than 2^18 languages are refused.
    """
    spark = labelled.sparkSession
    ready(spark)
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    texts = rows.groupBy("lang").count()
    most = 1 << (CELL_BITS - 4)
    found = dict(texts.limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} languages")
    languages = sorted(found)
    bits = max(4, min(BUCKET_BITS, CELL_BITS - max(1, len(languages)).bit_length()))
    places = {language: i for i, language in enumerate(languages)}
    counts = np.zeros((len(languages), 1 << bits))
    if languages:
        counted = rows.mapInArrow(_count(places, bits), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        for part in [counted.toArrow()]:
            counts.ravel()[part.column("cell").to_numpy()] = part.column("n").to_numpy()
    return Model(languages, counts.T.copy(), np.array([found[x] for x in languages], float))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.judge(t) for t in field_of(batch, "text").to_pylist()]
            kinds = pa.string(), pa.float64(), pa.float64()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds))],
                names=[*batch.schema.names, "_lang", "_score", "_misfit"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, the posterior probability) from the text alone.

    ``und`` with score 0 for a null text and one without a letter, and for all without a trained language.
    Columns named like the new ones are replaced. Texts stay where they are read.
    """
    docs = docs.drop("lang_pred", "score")
    return unboxed(_identified(docs, model), docs, lang_pred="_lang", score="_score")


def _identified(docs: DataFrame, model: Model) -> DataFrame:
    spark = docs.sparkSession
    ready(spark)
    rows = boxed(docs)
    shared = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared), with_fields(rows, _lang="string", _score="double", _misfit="double"))


def held_out(doc_id: Column, of: int, remainder: int) -> Column:
    """Is crc32(doc_id as text) mod ``of`` the remainder? A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % of == remainder, F.lit(False))


def accepted(docs: DataFrame, model: Model, least: float = 0.5, misfit: float = MISFIT) -> DataFrame:
    """The documents in a language that the model knows: with a posterior of ``least`` or more, and n-grams that the
    language explains (see :meth:`Model.judge`). Gibberish and texts in other languages go."""
    found = _identified(docs, model).filter(
        (F.col("_lang") != UNKNOWN) & (F.col("_score") >= least) & (F.col("_misfit") < misfit)
    )
    return unboxed(found, docs)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.filter(~out))
    rows = docs.select("doc_id", out.alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
