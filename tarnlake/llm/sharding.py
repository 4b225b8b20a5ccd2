"""Sharding: contiguous shards whose largest one is as small as possible.

Groups of rows that must stay together (equal texts) lie in a fixed order and have a size. The
smallest capacity with which a greedy walk needs at most N shards is found by bisection, and the
shards are cut with that capacity.

The walk needs only one question answered: which is the last group boundary at or before byte x (or
the first at or after it)? The rows are laid on one line of bytes by running totals, and the driver
holds a bounded digest of the boundaries: per bucket of the line their number, first and last. That
gives every answer exactly or between two bounds, and a walk over bounds gives bounds of the
capacity. Only the buckets that a walk ended in without an exact answer are split, until all
answers are exact: two to five passes over two numbers per group, whatever the number of groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.words import table
from tarnlake.operators.running import running_totals
from tarnlake.session import keep

#: the line is first seen in at most 2^FIRST_BITS buckets; an open bucket is split into 2^MORE_BITS
FIRST_BITS = 14
MORE_BITS = 8

Bounds = tuple[int, int]


class Boundaries:
    """What the driver knows of the boundaries: disjoint buckets (first, last, number, shift)."""

    def __init__(self, end: int, buckets: list[tuple[int, int, int, int]]):
        self.end = end
        self.buckets = sorted([*buckets, (end, end, 1, 0)])
        self.firsts = [b[0] for b in self.buckets]
        self.lasts = [b[1] for b in self.buckets]
        self.open: set[int] = set()

    def before(self, x: Bounds) -> Bounds:
        """Bounds of the last boundary at or before x, which lies between two bounds itself."""
        return self._before(x[0])[0], self._before(x[1])[1]

    def after(self, x: Bounds) -> Bounds:
        """Bounds of the first boundary at or after x."""
        return self._after(x[0])[0], self._after(x[1])[1]

    def _before(self, x: int) -> Bounds:
        i = bisect_right(self.firsts, x) - 1
        first, last, number, _ = self.buckets[i]
        if x >= last:
            return last, last
        if number <= 2:
            return first, first
        self.open.add(i)
        return first, x

    def _after(self, x: int) -> Bounds:
        i = bisect_left(self.lasts, x)
        first, last, number, _ = self.buckets[min(i, len(self.buckets) - 1)]
        if x <= first:
            return first, first
        if number <= 2 or x >= last:
            return last, last
        self.open.add(i)
        return x, last

    def fits(self, capacity: int, shards: int, side: int) -> bool:
        """Does the walk reach the end? side 0: surely, side 1: possibly."""
        at = 0
        for _ in range(shards):
            reached = self._before(min(at + capacity, self.end))[side]
            if reached >= self.end:
                return True
            if reached <= at:
                return False
            at = reached
        return False

    def capacity(self, shards: int) -> Bounds:
        """Bounds of the smallest capacity that fits."""
        found = []
        for side in (1, 0):
            low, high = -(-self.end // shards) - 1, self.end
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if self.fits(middle, shards, side) else (middle, high)
            found.append(high)
        return found[0], found[1]

    def cuts(self, capacity: Bounds, shards: int) -> list[Bounds]:
        """Bounds of the starts of shards 1 to N-1: each shard aims at an even share of what is
        left, takes no more than the capacity, and leaves no more than the others can hold."""
        needed = [(self.end, self.end)]
        for _ in range(shards - 1):  # the least that must be taken before the last k shards
            last = needed[-1]
            needed.append(self.after((max(0, last[0] - capacity[1]), max(0, last[1] - capacity[0]))))
        needed = needed[::-1]
        starts, at = [], (0, 0)
        for k in range(shards - 1):
            left = shards - k
            even = tuple(a + (self.end - a) // left for a in at)
            near = self._nearest(even[0])[0], self._nearest(even[1])[1]
            most = self.before((min(at[0] + capacity[0], self.end), min(at[1] + capacity[1], self.end)))
            at = tuple(min(max(near[s], needed[k][s], at[s]), most[s]) for s in (0, 1))
            at = (min(at), max(at))
            starts.append(at)
        return starts

    def _nearest(self, x: int) -> Bounds:
        """Bounds of the boundary closest to x."""
        below, above = self._before(x), self._after(x)
        if below[0] != below[1] or above[0] != above[1]:
            return below[0], above[1]
        near = below[0] if x - below[0] <= above[0] - x else above[0]
        return near, near


def _look(starts: DataFrame, cells: list[tuple[int, list[int]]], bits: int) -> list[tuple[int, int, int, int]]:
    """(first, last, number, shift) of the sub-buckets of the given buckets. cells: (shift, buckets)."""
    place = F.lit(None).cast("struct<shift:int,bucket:long>")
    for shift, wanted in cells:
        finer = max(0, shift - bits)
        inside = F.lit(True) if not wanted else F.shiftright("at", shift).isin(wanted)
        place = F.when(
            inside, F.struct(F.lit(finer).alias("shift"), F.shiftright("at", finer).alias("bucket"))
        ).otherwise(place)
    rows = (
        starts.select(place.alias("cell"), "at")
        .filter("cell IS NOT NULL")
        .groupBy("cell")
        .agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("n"))
        .select("a", "b", "n", "cell.shift")
        .collect()
    )
    return [tuple(r) for r in rows]


def cut_points(starts: DataFrame, end: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and where shards 1 to N-1 start. ``starts``: byte ``at`` of each group."""
    shift = max(0, end.bit_length() - FIRST_BITS)
    known = Boundaries(end, _look(starts, [(shift + FIRST_BITS, [])], FIRST_BITS))
    while True:
        capacity = known.capacity(shards)
        known.open.clear()
        for side in (0, 1):  # the walks at both ends of the bounds, and nothing else
            known.fits(capacity[side], shards, 0), known.fits(capacity[side], shards, 1)
        if capacity[0] == capacity[1]:
            cuts = known.cuts(capacity, shards)
            if all(a == b for a, b in cuts):
                return capacity[0], [a for a, _ in cuts]
        spans = [known.buckets[i] for i in known.open]
        cells: dict[int, set[int]] = {}
        for first, _, _, shift in spans:
            cells.setdefault(shift, set()).add(first >> shift)
        finer = _look(starts, [(s, sorted(b)) for s, b in sorted(cells.items())], MORE_BITS)
        rest = [b for i, b in enumerate(known.buckets) if i not in known.open and b[0] != end]
        known = Boundaries(end, rest + finer)


def shard(
    df: DataFrame,
    shards: int,
    size: Column,
    group: list[str],
    order: list[str],
) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0 without gaps in each shard).

    Rows of equal ``group`` columns (null equals null) share a shard, so one group larger than an
    even share makes its shard larger. The line runs by ``group`` and inside a group by ``order``;
    rows that tie in both get slots in no defined order. ``size`` must not be null or negative; rows
    of size 0 take no room on the line and lie with what follows them, so give every row a positive
    size to have groups kept whole. An empty table gives an empty result; clashing column names
    cannot occur but for ``shard`` and ``slot``, which are replaced.
    """
    rows = df.drop("shard", "slot").withColumn("_size", size.cast("long"))
    placed = keep(
        running_totals(rows, [], [*group, *order], {"_at": "_size", "_row": F.lit(1)}), "line"
    )
    end = placed.agg(F.max(F.col("_at") + F.col("_size"))).first()[0]
    if not end:
        return placed.withColumns({"shard": F.lit(0), "slot": F.col("_row")}).drop("_size", "_at", "_row")
    firsts = placed.groupBy(*group).agg(F.min("_at").alias("at"), F.min("_row").alias("row"))
    starts = keep(firsts.select("at", "row"), "groups")
    _, cuts = cut_points(starts.select("at"), end, shards)
    inner = sorted({c for c in cuts if 0 < c < end})
    rows_at = dict(starts.filter(F.col("at").isin(inner)).groupBy("at").agg(F.min("row")).collect()) if inner else {}
    number, first = F.lit(0), F.lit(0).cast("long")
    for cut in cuts:
        past = F.col("_at") >= cut
        number = number + past.cast("int")
        if cut in rows_at:
            first = F.when(past, F.lit(rows_at[cut])).otherwise(first)
    return placed.withColumns({"shard": number, "slot": F.col("_row") - first}).drop("_size", "_at", "_row")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        _digest(F.col("text")).alias("_text"),
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 16, a null text has none), text_crc32, law,
    shard, slot, grown_shard (null: the law ``bytes`` has none).

    Equal texts share a shard; a null text lies with the empty ones. Groups lie in the order of the
    texts' SHA-256, so every shard is a fair mix. Repeated rows each have a row; ties are free.
    """
    rows = _sized(docs)
    return shard(rows, shards, F.col("size"), ["_text"], ["doc_id"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """All rows and columns, and ``shard`` as :func:`shard_documents` has it (a column of that name is replaced).

    Shards are ranges of the texts' digests, so the first digest of each shard tells where a row goes: rows are not
    joined, and repeated or missing ids do no harm.
    """
    placed = shard(_sized(docs), shards, F.col("size"), ["_text"], ["doc_id"])
    firsts = placed.groupBy("shard").agg(F.min("_text").alias("first")).collect()  # one row per shard
    number = F.lit(0)
    for row in sorted(firsts):
        number = F.when(_digest(F.col("text")) >= F.lit(bytes(row["first"])), F.lit(row["shard"])).otherwise(number)
    return docs.drop("shard").withColumn("shard", number)


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """The documents as Parquet, one folder per shard; large shards are several files."""
    sharded(docs, shards).hint("rebalance", F.col("shard")).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"))
