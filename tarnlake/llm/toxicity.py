"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text's letters and digits (in lower case; runs of anything else are one space) give character n-grams that
are hashed into 2^18 buckets; a text has a bucket or has it not. Over the labelled rows, the log-count ratio of a
bucket is log((p+1)/P) - log((n+1)/N): p and n are the labelled texts of either class that have the bucket,
P and N the sums of (p+1) and (n+1) over all buckets. Buckets whose ratio stands out from chance are the
features, each with its ratio as value, and MLlib fits a logistic regression to them. A score needs the model's
one table of 2^18 numbers only, which is broadcast: the logistic function of the sum over a text's buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.language import held_out
from tarnlake.llm.words import boxed, field_of, ready, table, unboxed, with_fields
from tarnlake.session import work_path

ORDERS = (3, 4, 5)
BUCKET_BITS = 18
#: a feature's ratio is as many standard errors from zero at least; of more features than the bound, the farthest stay
STANDS_OUT = 3.0
MOST_FEATURES = 1 << 14
#: the classifier is fitted to about this many labelled rows at most, chosen by a hash of the id: the ratios to all of
#: them, the regression to a quarter
FIT_ROWS = 1 << 17
ITERATIONS = 50
PLACES = 1 << 20
#: code points looked at at once
SLICE = 1 << 16
#: from this score on a text is predicted toxic
THRESHOLD = 0.7

_TABLE = 0x3040  # above are letters and pictures only
_plain: np.ndarray | None = None


def _is_plain() -> np.ndarray:
    """For each code point below the table's end: is it a letter, a mark or a digit?"""
    global _plain
    if _plain is None:
        import unicodedata

        _plain = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(_TABLE)] + [True])
    return _plain


def cleaned(text: str) -> np.ndarray:
    """Code points of the lower-cased text; runs of others than letters, marks and digits are one space, one at either end."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = _is_plain()[np.minimum(codes, _TABLE)]
    codes = np.where(plain, codes, np.uint32(32))
    keep = plain.copy()
    keep[0] = True
    keep[1:] |= plain[:-1]
    return codes[keep]


def buckets(codes: np.ndarray) -> np.ndarray:
    """The buckets of the n-grams of code points, repeats included."""
    found = []
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        count = len(codes) - n + 1
        if count <= 0:
            break
        h = (h[:count] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            found.append((h + np.uint32(n)) * np.uint32(0x85EBCA77) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


class Presence:
    """Which buckets of a chosen set a text has, each once; the notes of the last text are reused."""

    def __init__(self, chosen: np.ndarray | None = None):
        self.chosen = chosen
        self.last = np.zeros(1 << BUCKET_BITS, np.int64)

    def of(self, text: str | None) -> np.ndarray:
        codes = cleaned(text or "")
        longest = max(ORDERS)
        parts = []
        for start in range(0, max(1, len(codes) - longest + 1), SLICE):
            found = buckets(codes[start : start + SLICE + longest - 1])
            if self.chosen is not None:
                found = found[self.chosen[found]]
            parts.append(self._once(found))
        return parts[0] if len(parts) == 1 else self._once(np.concatenate(parts))

    def _once(self, found: np.ndarray) -> np.ndarray:
        at = np.arange(len(found))
        self.last[found] = at
        return found[self.last[found] == at]


class Model:
    """One weight per bucket (coefficient times ratio) and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights = weights
        self.bias = bias

    def scorer(self):
        presence = Presence(self.weights != 0)

        def score(text: str | None) -> float:
            # in the order of the buckets, so that equal texts have equal scores
            total = self.bias + float(self.weights[np.sort(presence.of(text))].sum())
            return float(1.0 / (1.0 + np.exp(-total))) if total >= -700 else 0.0

        return score


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``place, text, toxic`` of the documents with a label, of about ``fit_rows`` labels at most; ``place`` (below
    2^20) deals them out evenly by a hash of the id.

    Several labels of one id are one: 1 if they are 1 on average in half of the cases or more. Rows without
    an id or a label do not count. A null text is an empty one. The chosen labels, 16 bytes each, are broadcast, so
    texts stay where they are read.
    """
    of_id = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg((F.col("toxic") > 0).cast("int")) >= 0.5).cast("int").alias("toxic"))
    )
    share = min(1.0, fit_rows / max(1, of_id.count()))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(PLACES)).alias("place")
    chosen = of_id.select("doc_id", "toxic", place).filter(F.col("place") < int(share * PLACES))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # 0 to 2^20 again among those that are left
    return texts.join(F.broadcast(chosen), "doc_id").withColumn("place", F.floor(F.col("place") / share))


def _count():
    schema = pa.schema([("bucket", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[1 - toxic][presence.of(text)] += 1
        found = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            arrays = [pa.array(part.astype(np.int32)), *(pa.array(c[part]) for c in counts)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def log_count_ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket the log-count ratio over all ``text, toxic`` rows, and its distance from zero in
    standard errors; at most 2^18 sums reach the driver."""
    ready(rows.sparkSession)
    counted = (
        rows.select("text", "toxic")
        .mapInArrow(_count(), "bucket int, toxic long, clean long")
        .groupBy("bucket")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .toArrow()
    )
    toxic, clean = np.ones(1 << BUCKET_BITS), np.ones(1 << BUCKET_BITS)
    at = counted.column("bucket").to_numpy()
    toxic[at] += counted.column("toxic").to_numpy()
    clean[at] += counted.column("clean").to_numpy()
    ratios = np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())
    return ratios, np.abs(ratios) / np.sqrt(1 / toxic + 1 / clean)


def chosen_buckets(far: np.ndarray, least: float = STANDS_OUT, most: int = MOST_FEATURES) -> np.ndarray:
    """The buckets that stand out, in ascending order; of too many those farthest out, equal ones by number."""
    found = np.flatnonzero(far >= least)
    if len(found) > most:
        found = np.sort(found[np.argsort(-far[found], kind="stable")[:most]])
    return found


def _vectors(shared):
    schema = pa.schema([("label", pa.float64()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, ratios = shared.value
        chosen = np.zeros(1 << BUCKET_BITS, bool)
        chosen[features] = True
        presence = Presence(chosen)
        for batch in batches:
            found = [np.searchsorted(features, np.sort(presence.of(t))) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (flat, ratios[flat])]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.float64()), *lists], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from the documents with a label, of about ``fit_rows`` labels at most.

    The ratios come from all of these rows. The regression is fitted by MLlib to a quarter of ``fit_rows`` (to all if there
    are no more), with a penalty of one over the number of rows. Without rows of both classes the score of any text is the
    share of toxic rows, one of either class added.
    """
    spark = docs.sparkSession
    rows = labelled(docs, labels, fit_rows)
    of_class = dict(rows.groupBy("toxic").count().collect())
    toxic, clean = of_class.get(1, 0), of_class.get(0, 0)
    weights = np.zeros(1 << BUCKET_BITS)
    without = Model(weights, float(np.log((toxic + 1) / (clean + 1))))
    if not toxic or not clean:
        return without
    ratios, far = log_count_ratios(rows)
    features = chosen_buckets(far)
    if not len(features):
        return without
    share = min(1.0, fit_rows / 4 / (toxic + clean))
    shared = spark.sparkContext.broadcast((features, ratios[features]))
    vectors = rows.filter(F.col("place") < int(share * PLACES)).select("text", "toxic")
    vectors = vectors.mapInArrow(_vectors(shared), "label double, indices array<int>, values array<double>")
    # a sparse vector's own storage form, read back as vectors
    sparse = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(len(features)).alias("size"), "indices", "values")
    path = work_path(spark, "toxicity")
    vectors.select("label", sparse.alias("features")).write.parquet(path)
    fit = spark.read.schema(T.StructType().add("label", "double").add("features", VectorUDT())).parquet(path)
    classes = dict(fit.groupBy("label").count().collect())
    if len(classes) < 2:
        return without
    fitted = LogisticRegression(regParam=1.0 / sum(classes.values()), standardization=False, maxIter=ITERATIONS).fit(fit)
    weights[features] = fitted.coefficients.toArray() * ratios[features]
    return Model(weights, float(fitted.intercept))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            found = [score(t) for t in field_of(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "_score"])

    return run


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic is likelier) and ``predicted`` (1 from ``threshold`` on, else 0)
    from the whole text alone; a null text is an empty one, whose score is that of no feature.

    Columns named like the new ones are replaced, all others are kept. Texts stay where they are read.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.drop("score", "predicted")
    rows = boxed(docs)
    shared = spark.sparkContext.broadcast(model)
    found = rows.mapInArrow(_score(shared), with_fields(rows, _score="double"))
    found = found.withColumn("_predicted", (F.col("_score") >= threshold).cast("int"))
    return unboxed(found, docs, score="_score", predicted="_predicted")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of rows that are not held out teach; every document is scored."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = held_out(F.col("doc_id"), 3, 1)
    model = train(docs.filter(~out), labels.filter(~out))
    rows = docs.select("doc_id", out.alias("held_out"), "text")
    return scored(rows, model).select("doc_id", "held_out", "score", "predicted")
