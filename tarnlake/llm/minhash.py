"""MinHash near-dedup with min-max hashing.

Each random permutation of the shingles' hashes gives two signature values, its minimum and its maximum,
so a signature costs half the hash evaluations, and its estimate of the similarity is unbiased with a
smaller variance. ROWS consecutive values are a band; texts that agree in a band share a bucket. With 20
bands of 5 values a pair at similarity 0.85 shares no bucket with a chance of 8 in a million.

Links are confirmed on full sets. Texts with equal sets are one class from the start. All pairs of a bucket
are never made: first each member meets the bucket's pivot, the member with most company in all its
buckets, which links what is close around a common origin. Of a bucket that still holds several components,
every member outside its largest one is then compared with all members of other components. That happens
in a sorted stream: a task holds the sets of some of these members, the bucket's members pass by, and only
links come out. Buckets of any size are dealt out by (bucket, slice of the held ones, salt of the others).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.components import components
from tarnlake.llm.words import BASE, hashes_of, mixed, ngram_hashes, ready, table, words_of
from tarnlake.names import quoted
from tarnlake.session import keep

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 20, 5
SEED = 20
#: sets held by a task at once, and members that pass by
HELD, PASSING = 256, 4096
#: bits of the table that finds the candidates' texts again: 16 for each candidate, 2^24 (2 MB) at least and 2^28 (32 MB) at
#: most; with more than 2^24 candidates more and more texts that are none are cut into shingles, to be dropped after that
TABLE_BITS, MOST_BITS = 24, 28


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of the text's shingles; with fewer words, one of the whole sequence."""
    hashes = hashes_of(words_of(text))
    if not len(hashes):
        return hashes
    return np.unique(ngram_hashes(hashes, min(size, len(hashes))))


def _multipliers(count: int) -> np.ndarray:
    random = np.random.default_rng(SEED)
    return random.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, one after the other."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(multipliers), np.uint64)
    for at in range(0, len(shingles), 1 << 14):
        values = shingles[None, at : at + (1 << 14)] * multipliers[:, None]
        low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
    return np.stack([low, high], axis=1).ravel()


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for column in values[: bands * rows].reshape(bands, rows).T:
        keys = mixed(keys * BASE + column)
    return keys.view(np.int64)


def _sign(bands: int, rows: int, others: list[str]):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))]
        + [(name, pa.binary()) for name in others]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(-(-bands * rows // 2))
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sizes, classes, keys = [], [], []
            for k in range(batch.num_rows):
                found = shingle_set(texts[k].as_py() or b"")
                sizes.append(len(found))
                classes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(signature(found, multipliers), bands, rows) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 *(batch.column(name).cast(pa.binary()) for name in others)],
                schema=schema,
            )

    return run


def _sets(bits: bytes):
    schema = pa.schema([("class", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.frombuffer(bits, np.uint8)
        for batch in batches:
            place = batch.column("place").to_numpy()
            wanted = np.flatnonzero(there[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            texts = batch.column("text").cast(pa.binary())
            for at in range(0, len(wanted), 64):
                found = [shingle_set(texts[int(k)].as_py() or b"") for k in wanted[at : at + 64]]
                found = [f for f in found if len(f)]
                classes = [xxhash.xxh3_128_digest(f.tobytes()) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(classes, pa.binary()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))],
                    schema=schema,
                )

    return run


def _bits_for(wanted: DataFrame) -> int:
    return max(TABLE_BITS, min(MOST_BITS, (16 * wanted.count()).bit_length()))


def _place(doc_id, bits: int):
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1))), F.lit(1 << bits))


def _table_of(place, wanted: DataFrame) -> DataFrame:
    """(bucket, bits): chunks of the bit table of places, 2^MOST_BITS bits at most. Bit p of chunk b stands for
    the number 1 + p + (b - 1) * 8 * 4096, a number being a place + 1."""
    number = place + 1
    return wanted.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, shingles) of the classes in ``wanted`` (class, doc_id). Their texts are found again by a bit
    table of doc_ids, so no other text is cut into shingles twice, and none is shuffled."""
    size = _bits_for(wanted)
    place = _place(F.col("doc_id"), size)
    chunks = _table_of(place, wanted).collect()  # at most 2^MOST_BITS bits
    bits = bytearray(1 << max(size - 3, 15))
    for bucket, chunk in chunks:
        at = (bucket - 1) * len(chunk)
        bits[at : at + len(chunk)] = chunk
    found = docs.select(place.alias("place"), "text").mapInArrow(_sets(bytes(bits)), "class binary, shingles array<long>")
    return found.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _linked(percent: int, common, first, second):
    return 100 * common >= percent * (first + second - common)


def _compare(percent: int):
    """Rows sorted by (key, slice, salt, held first) → links between held and passing ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, index = None, [], None
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            columns = [batch.column(c).to_pylist() for c in ("key", "slice", "salt", "held", "class", "root")]
            shingles = batch.column("shingles")
            for k, (key, part, salt, hold, name, root) in enumerate(zip(*columns, strict=True)):
                if group != (key, part, salt):
                    group, held, index = (key, part, salt), [], None
                mine = shingles[k].values.to_numpy().view(np.uint64)
                if hold:
                    held.append((name, root, mine.copy()))
                    continue
                if not held:
                    continue
                if index is None:
                    owners = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
                    values = np.concatenate([h[2] for h in held])
                    order = np.argsort(values)
                    sizes = np.array([len(h[2]) for h in held])
                    index = values[order], owners[order], sizes
                values, owners, sizes = index
                low = np.searchsorted(values, mine, "left")
                many = np.searchsorted(values, mine, "right") - low
                starts = np.repeat(low - (np.cumsum(many) - many), many)
                common = np.bincount(owners[starts + np.arange(len(starts))], minlength=len(held))
                for j in np.flatnonzero(_linked(percent, common, sizes, len(mine))).tolist():
                    if held[j][1] != root:
                        out.append((held[j][0], name))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return run


def class_links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes that join exactly what all links would join, and ``classes`` are
    (class, doc_id, n_shingles, bands)."""
    spark = docs.sparkSession
    bands = classes.select(F.explode("bands").alias("key"), "class", "n_shingles", "doc_id")
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = keep(bands.join(sizes, "key"), "members")
    company = members.groupBy("class").agg(F.sum("size").alias("company"), F.first("doc_id").alias("doc_id"))
    company = keep(company, "company")
    sets = keep(_full_sets(docs, company.select("class", "doc_id")), "sets")

    # every member and its bucket's pivot
    whole = members.select("key", "class", "n_shingles").join(company.select("class", "company"), "class")
    pivots = whole.groupBy("key").agg(F.max(F.struct("company", "class", "n_shingles")).alias("pivot"))
    small, large = F.least("n_shingles", "pivot.n_shingles"), F.greatest("n_shingles", "pivot.n_shingles")
    pairs = (
        whole.join(pivots, "key")
        .filter((F.col("class") != F.col("pivot.class")) & (100 * small >= percent * large))
        .select(F.least("class", "pivot.class").alias("a"), F.greatest("class", "pivot.class").alias("b"))
        .distinct()
    )
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    near = pairs.join(left, "a").join(right, "b").filter(_linked(percent, common, F.size("x"), F.size("y")))
    near = keep(near.select("a", "b"), "near")

    # buckets that still hold several components
    roots = components(near)
    rows = members.select("key", "class").join(
        roots.select(F.col("node").alias("class"), "root"), "class", "left"
    )
    rows = keep(rows.withColumn("root", F.coalesce("root", "class")), "rooted")
    parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("key").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("largest"), F.count(F.lit(1)).alias("parts")
    )
    shares = parts.filter("parts > 1").select(
        "key",
        F.col("largest.root").alias("main"),
        F.ceil((F.col("all") - F.col("largest.n")) / HELD).cast("int").alias("slices"),
        F.ceil(F.col("all") / PASSING).cast("int").alias("salts"),
    )
    rows = rows.join(shares, "key")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = lambda n, seed: F.pmod(F.xxhash64("class", F.lit(seed)), F.col(n)).cast("int")
    holding = (
        rows.filter(F.col("root") != F.col("main"))
        .withColumns({"slice": one("slices", 1), "held": F.lit(True)})
        .withColumn("salt", F.explode(numbers("salts")))
    )
    passing = rows.withColumns({"salt": one("salts", 2), "held": F.lit(False)}).withColumn(
        "slice", F.explode(numbers("slices"))
    )
    columns = ["key", "slice", "salt", "held", "class", "root"]
    ready(spark, batch_rows=256)
    far = (
        holding.select(*columns)
        .unionByName(passing.select(*columns))
        .join(sets, "class")
        .repartition("key", "slice", "salt")
        .sortWithinPartitions("key", "slice", "salt", F.desc("held"))
        .mapInArrow(_compare(percent), "a binary, b binary")
    )
    return keep(near.unionByName(far.distinct()), "links")


def _rooted(docs: DataFrame, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of (doc_id, text) rows, with binary columns beside these, and the classes of equal sets
    (class, doc_id, n_shingles) with the component's ``root``."""
    ready(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kinds = "".join(f", {c} binary" for c in others)
    signed = keep(
        docs.mapInArrow(_sign(bands, rows, others), "doc_id long, n_shingles long, class binary, bands array<long>" + kinds),
        "signatures",
    )
    classes = signed.filter("class IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    classes = keep(classes, "classes")
    roots = components(class_links(docs, classes, percent))
    ids = classes.select("class", "doc_id", "n_shingles").join(roots.withColumnRenamed("node", "class"), "class", "left")
    return signed, ids.withColumn("root", F.coalesce("root", "class"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    A component is what links of 100 * intersection >= ``percent`` * union join; its id is its smallest
    doc_id. Null and empty texts, and texts without words, have no shingles and are linked with nothing.
    Rows with the same doc_id each have a row, a null doc_id is no component's id, other columns are not
    read, and an empty table gives no rows.
    """
    signed, ids = _rooted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent, bands, rows)
    first = ids.groupBy("root").agg(F.min("doc_id").alias("first"))
    # a class with many copies is one row here; Spark splits the large partitions of the left side
    named = keep(ids.join(first, "root").select("class", "first"), "named")
    found = signed.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each component, with all its columns: of the smallest doc_id (null only where there is no
    other), then with most shingles, then any. Rows without shingles are linked with nothing and stay.

    Rows are told apart by doc_id and text. Only rows whose place in a bit table holds a doc_id of which a row
    goes are shuffled; all others stay where they are read.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("digest"))
    signed, ids = _rooted(narrow, percent, bands, rows)
    # equal rows are one here, with their number
    texts = signed.filter("class IS NOT NULL").groupBy("class", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    texts = keep(texts, "texts")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("best")
    best = texts.groupBy("class").agg(best).join(ids.select("class", "n_shingles", "root"), "class")
    order = F.struct("best.last", "best.doc_id", (-F.col("n_shingles")).alias("few"), "best.digest", "class")
    kept = best.groupBy("root").agg(F.min(order).alias("kept")).select("kept.doc_id", "kept.digest", "kept.class", F.lit(True).alias("stays"))
    same = texts["doc_id"].eqNullSafe(kept["doc_id"]) & (texts["digest"] == kept["digest"]) & (texts["class"] == kept["class"])
    # what goes, and equal rows of which one stays
    fates = texts.join(kept, same, "left").select(texts["doc_id"].alias("_id"), texts["digest"].alias("_digest"), "stays", "n")
    fates = fates.withColumn("stays", F.coalesce("stays", F.lit(False))).filter("n > 1 OR NOT stays")
    fates = keep(fates, "fates")

    size = _bits_for(fates)
    table_of = F.broadcast(_table_of(_place(F.col("_id"), size), fates).select(F.col("bucket").alias("_bucket"), "bits"))
    number = _place(F.col("doc_id").cast("long"), size) + 1
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row")
    placed = docs.select(row, F.bitmap_bucket_number(number).alias("_bucket"), F.bitmap_bit_position(number).alias("_bit"))
    placed = placed.join(table_of, "_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(_bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
    there = F.coalesce(F.expr("bits IS NOT NULL") & (byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0), F.lit(False))
    columns = [F.col(f"_row.{quoted(c)}") for c in docs.columns]
    aside = placed.filter(~there).select(*columns)
    own = F.unhex(F.md5(F.coalesce(F.col("_row.text").cast("binary"), F.lit(b""))))
    moved = placed.filter(there).select("_row", F.col("_row.doc_id").cast("long").alias("_doc"), own.alias("_own"))
    judged = moved.join(fates, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest")), "left")
    single = judged.filter("n IS NULL").select(*columns)
    again = judged.filter("stays").dropDuplicates(["_doc", "_own"]).select(*columns)
    return aside.unionByName(single).unionByName(again)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
