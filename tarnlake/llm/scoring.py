"""LM scoring with a log-frequency Bloom filter.

Counts of words and of word pairs are quantised on a log scale: a count c has the level
1 + floor(log_b(c)). The filter holds the pairs (n-gram, 1) to (n-gram, level); a reader asks for level 1, 2, …
until one is missing and so has the level, and with it the count, without an n-gram ever being stored.
A missing n-gram is taken for a present one with the chance of a false hit, a level is at most raised.

Counting, quantising and setting bits are distributed. The filter consists of blocks of 2^BLOCK_BITS bits
and all bits of an n-gram lie in one block: counts are shuffled, packed, by ranges of blocks, a task owns whole
blocks and writes each once. Its size follows the number of words and tokens without a ceiling, so false hits are as
rare at any size. A filter of up to 2^limit_bits bits is broadcast, as is the bounded table of the most
frequent words; a larger one stays a table of blocks, and the n-grams of a group of texts are sent to the
ranges of blocks that answer with their levels. Both ways ask the same bits, so scores are the same.

Score of a text: log10 of P(w | v) = (c(v w) + M P(w)) / (c(v) + M) over its tokens, with
P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), all counts from the filter, the first token's v being the end token.

The base score needs exact counts of all words. Frequent ones come from the broadcast table; the others, which
are a small part of all tokens, are looked up by a join on the word's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.language import held_out
from tarnlake.llm.words import BASE, hashes_of, mixed, ngram_hashes, ready, table, words_of
from tarnlake.session import keep

#: ends a text; no word holds a space
END = b" "
#: log scale of the counts
SCALE = 2.0
#: probes for each (n-gram, level)
PROBES = 4
#: bits of the filter for each word and token, which bound the different words and pairs
BITS_PER_NGRAM = 8
#: largest filter that is broadcast: 2^30 bits, 128 MB, of which the driver holds three copies for a moment
LIMIT_BITS = 30
BLOCK_BITS = 18
#: blocks that are built at once, in 4 MB
FILLED = 16
#: blocks of a larger filter that a task holds at once: 2 MB
RANGE_BLOCKS = 64
#: weight of the word's own probability against the counts of its pair
MIXED_IN = 8.0
#: words whose exact counts are broadcast (16 bytes each)
FREQUENT = 1 << 20
#: n-grams counted in a task before it passes them on
HELD = 1 << 21
#: tokens scored at once
TOGETHER = 1 << 18


def tokens_of(text: bytes) -> np.ndarray:
    """Hashes of a text's tokens: its words and one end."""
    return hashes_of([*words_of(text), END])


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """Hashes of (token before, token); an end stands before the first token."""
    return ngram_hashes(np.concatenate([tokens[-1:], tokens]), 2)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[starts], np.add.reduceat(counts, starts)


#: (range, hashes, counts): what a task counted for one range of hashes, as arrays, so that the shuffle moves a few
#: rows and not one per n-gram
PACKED = "range long, hashes binary, counts binary"


def _packed_ranges(hashes: np.ndarray, counts: np.ndarray, range_of) -> Iterator[pa.RecordBatch]:
    """Sorted different hashes with their counts, one row per range."""
    ranges = range_of(hashes).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])[: len(ranges)])
    parts = [[p.tobytes() for p in np.split(x, starts[1:])] for x in (hashes, counts)]
    for at in range(0, len(starts), 256):
        part = slice(at, at + 256)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ranges[starts[part]]), *(pa.array(p[part], pa.binary()) for p in parts)], names=["range", "hashes", "counts"]
        )


def _count(hashes_in, range_of):
    """Packed counts of what ``hashes_in`` finds in the texts of a task, HELD tokens at a time."""

    def summed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.sort(np.concatenate(held))
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
        yield from _packed_ranges(hashes[starts], np.diff(starts, append=len(hashes)), range_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for k in range(batch.num_rows):
                held.append(hashes_in(tokens_of(texts[k].as_py() or b"")))
                size += len(held[-1])
                if size >= HELD:
                    yield from summed(held)
                    held, size = [], 0
        if held:
            yield from summed(held)

    return run


def _pack(range_of):
    """(hash, n) rows as packed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes, counts = _summed(batch.column("hash").to_numpy().view(np.uint64), batch.column("n").to_numpy())
                yield from _packed_ranges(hashes, counts, range_of)

    return run


def _summed_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Packed counts sorted by range → (range, its hashes, their sums); one range is held at a time."""
    at, held = None, []

    def done() -> tuple[int, np.ndarray, np.ndarray]:
        hashes, counts = (np.concatenate([np.frombuffer(h[k], kind) for h in held]) for k, kind in ((0, np.uint64), (1, np.int64)))
        return (at, *_summed(hashes, counts))

    for batch in batches:
        for place, *arrays in zip(*(batch.column(c).to_pylist() for c in ("range", "hashes", "counts")), strict=True):
            if held and place != at:
                yield done()
                held = []
            at = place
            held.append(arrays)
    if held:
        yield done()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts sorted by range → (hash, n)."""
    for _, hashes, counts in _summed_ranges(batches):
        for at in range(0, len(hashes), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[part].view(np.int64)), pa.array(counts[part])], names=["hash", "n"])


def level_of(count: np.ndarray | int) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(SCALE) + 1e-9).astype(np.int64)


def count_at(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range on the log scale, 1 for level 1."""
    low = SCALE ** (level - 1.0)
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, low * (SCALE + 1) / 2))


def probe_bits(hashes: np.ndarray, level: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bits in an n-gram's block for a level: double hashing."""
    mix = mixed(hashes + np.uint64(0x632BE59BD9B4E019) * np.asarray(level, np.uint64))
    step = (mix >> np.uint64(32)) | np.uint64(1)
    for probe in range(PROBES):
        yield (mix + np.uint64(probe) * step) & np.uint64((1 << BLOCK_BITS) - 1)


class Filter:
    """The log-frequency Bloom filter, or ``held`` of its blocks from ``start``."""

    def __init__(self, blocks: int, contents: Iterator[tuple[int, pa.Scalar]], start: int = 0, held: int | None = None):
        self.blocks, self.start = blocks, start
        whole = np.zeros((blocks if held is None else held, 1 << (BLOCK_BITS - 3)), np.uint8)
        for block, content in contents:
            whole[block - start] = np.frombuffer(content.as_buffer(), np.uint8)
        self.bytes = whole.ravel()

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 for one that is not there."""
        levels = np.zeros(len(hashes), np.int64)
        asked, places = hashes, np.arange(len(hashes))
        first = (block_of(hashes, self.blocks) - np.uint64(self.start)) << np.uint64(BLOCK_BITS)
        level = 0
        while len(places):
            level += 1
            there = np.ones(len(places), bool)
            for bit in probe_bits(asked, level):
                at = first | bit
                there &= (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            asked, places, first = asked[there], places[there], first[there]
            levels[places] = level
        return levels

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        return count_at(self.levels(hashes))


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks in the order of the (unsigned) hashes."""
    return (hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)


def _fill(total: int):
    """Packed counts sorted by range of blocks → (block, content); a task builds one range of blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, hashes, counts in _summed_ranges(batches):
            first = place * FILLED
            blocks = block_of(hashes, total) - np.uint64(first)
            start, levels = blocks << np.uint64(BLOCK_BITS), level_of(counts)
            content = np.zeros((FILLED, 1 << BLOCK_BITS), bool)
            bits = content.reshape(-1)
            for level in range(1, int(levels.max()) + 1):
                if level > 1:
                    has = levels >= level
                    hashes, start, levels = hashes[has], start[has], levels[has]
                for bit in probe_bits(hashes, level):
                    bits[start | bit] = True
            many = min(FILLED, total - first)
            packed = [row.tobytes() for row in np.packbits(content[:many], axis=1, bitorder="little")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(first, first + many)), pa.array(packed, pa.binary())], names=["block", "content"]
            )

    return run


class Model:
    """What the workers get: the filter, the frequent words' exact counts, and the totals. A filter that is too
    large to broadcast is None, and its kept table (block, content) stays with the driver as ``stored``."""

    def __init__(
        self, counts: Filter | None, hashes: np.ndarray, exact: np.ndarray, tokens: int, different: int,
        total: int = 0, stored: DataFrame | None = None,
    ):
        self.filter, self.total, self.stored = counts, total, stored
        self.hashes, self.exact = hashes, exact
        self.tokens, self.different = tokens, different
        self.all = tokens + 0.5 * (different + 1)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "stored": None}

    def frequent(self, hashes: np.ndarray) -> np.ndarray:
        """Exact counts of the words among the frequent ones, 0 for all others."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.exact[at], 0)

    def look(self, tokens: np.ndarray, counts) -> tuple[np.ndarray, np.ndarray]:
        """Exact counts of frequent words, and the filter's counts of all. A hash that occurs more than
        once is asked for once."""
        different, at = np.unique(tokens, return_inverse=True)
        return self.frequent(different)[at], counts(different)[at]

    def scores(self, tokens: np.ndarray, words: np.ndarray, starts: np.ndarray, counts) -> np.ndarray:
        """log10 probabilities of texts whose tokens, with the filter's counts ``words``, follow each other,
        each from its place in ``starts``; ``counts`` gives the filter's counts of different hashes."""
        before = np.roll(words, 1)
        before[starts] = counts(hashes_of([END]))
        own = (words + 0.5) / self.all
        different, at = np.unique(pairs_in(tokens, starts), return_inverse=True)
        pair = np.minimum(counts(different)[at], before)
        return np.add.reduceat(np.log10(np.minimum((pair + MIXED_IN * own) / (before + MIXED_IN), 1.0)), starts)


def pairs_in(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of (token before, token) of texts that follow each other, each from its place in ``starts``."""
    last = np.roll(tokens, 1)
    last[starts] = hashes_of([END])
    return mixed(last * BASE + tokens + np.uint64(2))


def train(docs: DataFrame, limit_bits: int = LIMIT_BITS, frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model of all texts (null: empty), and the exact counts (hash, n) of all words.

    Texts are read twice: words first, whose totals size the filter, then pairs, which go straight into
    the shuffle by ranges of blocks. ``limit_bits`` bounds what is broadcast, not the filter.
    """
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select("text")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def by_range(packed: DataFrame) -> DataFrame:
        return packed.repartition("range").sortWithinPartitions("range")

    even = lambda hashes: block_of(hashes, parts)
    words = by_range(texts.mapInArrow(_count(lambda tokens: tokens, even), PACKED))
    words = keep(words.mapInArrow(_sums, "hash long, n long"), "words")
    facts = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    different, tokens = int(facts[0]), int(facts[1])
    # there are no more different pairs than tokens
    wanted = max(1, BITS_PER_NGRAM * (different + tokens))
    total = -(-wanted // (1 << BLOCK_BITS))

    filled = lambda hashes: block_of(hashes, total) // np.uint64(FILLED)
    pairs = texts.mapInArrow(_count(pairs_of, filled), PACKED)
    blocks = by_range(pairs.unionByName(words.mapInArrow(_pack(filled), PACKED)))
    blocks = blocks.mapInArrow(_fill(total), "block long, content binary")
    counts, stored = None, None
    if wanted <= 1 << limit_bits:
        contents = blocks.toArrow()  # bounded by 2^limit_bits bits
        counts = Filter(total, zip(contents.column("block").to_pylist(), contents.column("content"), strict=True))
    else:
        stored = keep(blocks, "filter")

    # the frequent words: all above the count that leaves no more than wanted
    spread = words.groupBy(F.floor(F.log2("n")).alias("k"), F.when(F.col("n") < 4096, F.col("n")).alias("n")).count()
    least, kept = 1, different
    for _, n, many in sorted(spread.collect(), key=lambda r: (r[0], r[1] or 0)):
        if kept <= frequent:
            break
        kept -= many
        least = n + 1 if n else least * 2
    top = words.filter(F.col("n") >= least) if kept else words.limit(0)
    top = top.toArrow()
    hashes = top.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    model = Model(counts, hashes[order], top.column("n").to_numpy()[order], tokens, different, total, stored)
    return model, words


SCORED = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base", pa.float64()), ("score", pa.float64()),
        ("rare", pa.list_(pa.struct([("hash", pa.int64()), ("times", pa.int64())]))),
    ]
)


def _scored_group(model: Model, facts: list, tokens: np.ndarray, many: np.ndarray, counts) -> pa.RecordBatch:
    """Rows of a group of texts: ``facts`` are the first three columns, ``counts`` the filter's."""
    starts = np.cumsum(many) - many
    exact, words = model.look(tokens, counts)
    known = exact > 0
    logs = np.where(known, np.log10((exact + 0.5) / model.all), 0.0)
    # the other words of each text, with the times they occur
    owner, rare = np.repeat(np.arange(len(many)), many)[~known], tokens[~known]
    order = np.lexsort((rare, owner))
    owner, rare = owner[order], rare[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (rare[1:] != rare[:-1])])[: len(rare)])
    times = np.diff(first, append=len(rare))
    offsets = np.searchsorted(owner[first], np.arange(len(many) + 1))
    pairs = pa.StructArray.from_arrays([pa.array(rare[first].view(np.int64)), pa.array(times)], names=["hash", "times"])
    found = [pa.array(f, SCORED.field(i).type) for i, f in enumerate(facts)]
    scores = model.scores(tokens, words, starts, counts)
    numbers = many, np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(logs, starts), scores
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
    return pa.RecordBatch.from_arrays([*found, *map(pa.array, numbers), lists], schema=SCORED)


def _grouped(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Groups of whole texts of about ``together`` tokens: ([rows, doc_ids, held_out], tokens, tokens of each text)."""
    held: list[tuple] = []
    size = 0

    def group():
        many = np.array([len(h[3]) for h in held])
        return [[h[i] for h in held] for i in range(3)], np.concatenate([h[3] for h in held]), many

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        columns = [batch.column(c).to_pylist() for c in ("row", "doc_id", "held_out")]
        for k, facts in enumerate(zip(*columns, strict=True)):
            tokens = tokens_of(texts[k].as_py() or b"")
            held.append((*facts, tokens))
            size += len(tokens)
            if size >= together:
                yield group()
                held, size = [], 0
    if held:
        yield group()


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for facts, tokens, many in _grouped(batches, TOGETHER):
            yield _scored_group(model, facts, tokens, many, model.filter.counts)

    return run


GROUP = pa.schema(
    [
        ("group", pa.int64()), ("row", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
        ("many", pa.binary()), ("words", pa.binary()), ("at", pa.binary()),
    ]
)


def _group():
    """One row per group of texts, with its different words and each token's place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for facts, tokens, many in _grouped(batches, TOGETHER):
            words, at = np.unique(tokens, return_inverse=True)
            packed = [a.tobytes() for a in (many.astype(np.int64), words, at.astype(np.uint32))]
            values = [facts[0][0], *facts, *packed]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, GROUP, strict=True)], schema=GROUP)

    return run


def _unpacked(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, tokens of each text, sorted different hashes to ask for) of a group."""
    many, words, at = (
        np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in (("many", np.int64), ("words", np.uint64), ("at", np.uint32))
    )
    tokens = words[at]
    pairs = pairs_in(tokens, np.cumsum(many) - many)
    return tokens, many, np.unique(np.concatenate([words, hashes_of([END]), pairs]))


def _ask(total: int):
    """Groups → (range, group, content): the group's different hashes in that range of blocks, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked = _unpacked(batch, k)[2]
                ranges = block_of(asked, total).astype(np.int64) // RANGE_BLOCKS
                starts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
                parts = [part.tobytes() for part in np.split(asked, starts[1:])]
                group = np.full(len(starts), batch.column("group")[k].as_py(), np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"range": pa.array(ranges[starts]), "group": pa.array(group), "block": pa.nulls(len(starts), pa.int64()),
                     "content": pa.array(parts, pa.binary())}
                )

    return run


def _answer(total: int):
    """Rows sorted by range, its blocks before what is asked of it → (group, range, levels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, part = None, [], None
        for batch in batches:
            ranges, groups, numbers = (batch.column(c).to_pylist() for c in ("range", "group", "block"))
            contents, out = batch.column("content"), []
            for k, (place, group, block) in enumerate(zip(ranges, groups, numbers, strict=True)):
                if place != at:
                    at, blocks, part = place, [], None
                if block is not None:
                    blocks.append((block, pa.scalar(contents[k].as_py(), pa.binary())))
                    continue
                if part is None:
                    part, blocks = Filter(total, blocks, place * RANGE_BLOCKS, RANGE_BLOCKS), []
                asked = np.frombuffer(contents[k].as_buffer(), np.uint64)
                out.append((group, place, part.levels(asked).astype(np.uint8).tobytes()))
            if out:
                kinds = pa.int64(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["group", "range", "levels"]
                )

    return run


def _score_answered(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            facts = [batch.column(c).to_pylist() for c in ("row", "doc_id", "held_out")]
            answers = batch.column("answers").to_pylist()
            for k in range(batch.num_rows):
                tokens, many, asked = _unpacked(batch, k)
                levels = np.frombuffer(b"".join(a["levels"] for a in answers[k]), np.uint8)
                found = count_at(levels.astype(np.int64))
                yield _scored_group(model, [f[k] for f in facts], tokens, many, lambda h: found[np.searchsorted(asked, h)])  # noqa: B023

    return run


FOUND = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "rare array<struct<hash:long,times:long>>"
)


def _by_ranges(rows: DataFrame, model: Model, shared) -> DataFrame:
    """What ``_score`` gives, by a filter that is a table: each group of texts asks every range of blocks once
    for its different n-grams, and gets their levels back."""
    groups = rows.mapInArrow(
        _group(),
        "group long, row array<long>, doc_id array<long>, held_out array<boolean>, many binary, words binary, at binary",
    )
    groups = keep(groups, "groups")
    asked = groups.mapInArrow(_ask(model.total), "range long, group long, block long, content binary")
    blocks = model.stored.select(
        F.floor(F.col("block") / RANGE_BLOCKS).alias("range"), F.lit(None).cast("long").alias("group"), "block", "content"
    )
    answers = (
        asked.unionByName(blocks)
        .repartition("range")
        .sortWithinPartitions("range", F.col("block").isNull())
        .mapInArrow(_answer(model.total), "group long, range long, levels binary")
    )
    answers = answers.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("range", "levels"))).alias("answers"))
    return groups.join(answers, "group").mapInArrow(_score_answered(shared), FOUND)


def scored(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """One row per document (doc_id, held_out, text): doc_id, held_out, n_tokens, n_known (tokens seen in
    training), train_tokens, base_score, score. Null texts are empty and still have an end; without
    training texts every probability is one of an even guess. Repeated rows each have a row."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text"
    )
    found = rows.mapInArrow(_score(shared), FOUND) if model.stored is None else _by_ranges(rows, model, shared)
    found = keep(found, "scores")
    rare = found.select("row", F.inline("rare")).join(words, "hash", "left")
    exact = F.coalesce(F.col("n"), F.lit(0))
    rare = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((exact + 0.5) / F.lit(model.all))).alias("more"),
        F.sum(F.when(exact > 0, F.col("times")).otherwise(0)).alias("known"),
    )
    return found.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "text")
    model, words = train(docs.filter("NOT held_out"))
    return scored(docs, model, words)
