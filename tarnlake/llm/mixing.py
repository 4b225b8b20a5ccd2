"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's share of the mix over its size is how often each of its documents is wanted: 2.4 means two
whole copies for certain and a third one with probability 0.4. The third copies are a fixed-size
sample: documents are ranked by their random odds over their inclusion odds, u / (1 - u) divided by
p / (1 - p), and taken in that order until the words that are left to the source are used up. Random
numbers come from a digest of doc_id, so reruns agree.

Ranking runs over ranges of (source, rank) of even size, so a source with a third of all rows is
many tasks; sources meet the rows as one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.words import table
from tarnlake.operators.running import running_totals
from tarnlake.session import keep

#: weights in the order of the sources, repeated
WEIGHTS = (5.0, 2.0, 1.0)
#: a target is at most so many times the size of its source
MOST = 3


def word_count(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]``, none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number above 0 and below 1 from 52 bits of MD5."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target per source. The targets add up to all sizes; none is above ``most``
    times its source's size, and what a source cannot take is reshared by weight.

    With sources in the order of ``most`` * size / weight, those that reach their limit come first: a
    source does if its limit is below its share of what the ones before it left. So one running total
    replaces the rounds of resharing.
    """
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    present = F.col("source").isNull().cast("int")
    ranked = running_totals(
        sized.withColumn("_missing", present), [], ["_missing", "source"], {"_rank": F.lit(1)}
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = keep(ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(most)), "sources")
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, heavy = whole[0] or 0, whole[1] or 1.0
    lined = running_totals(
        ranked.withColumn("_ratio", F.col("limit") / F.col("weight")), [], ["_ratio", "_rank"],
        {"_used": "limit", "_gone": "weight"},
    )
    left, others = F.lit(total) - F.col("_used"), F.lit(heavy) - F.col("_gone")
    lined = keep(lined.withColumn("full", F.col("limit") * others < F.col("weight") * left), "targets")
    full = lined.filter("full").agg(F.sum("limit"), F.sum("weight")).first()
    rest, shared = total - (full[0] or 0), heavy - (full[1] or 0.0)
    share = F.col("weight") * F.lit(float(rest) / shared if shared else 0.0)
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share)
    return lined.select("source", "source_size", target.alias("target"))


def _place(seed: str) -> Column:
    """Where a document stands in the order of its source: (odds, doc_id, size), null without a share."""
    u = uniform(F.col("doc_id"), seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    return F.when(F.col("p") > 0, F.struct(odds.alias("odds"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size")))


def cuts(
    rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: str = "mix"
) -> DataFrame:
    """One row per source: source, source_size, target, whole (certain copies), p (probability of one
    more), cut (the last place that gets it) and last (one later place that gets it too).

    The sample of a source ends where its words are used up; its last place goes to the document not
    yet taken whose size fits best what is left, if taking it brings the source closer to its target.
    """
    wanted = keep(targets(rows, weights, most), "wanted")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = wanted.select(
        F.col("source").alias("_source"), "source_size", "target",
        F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"),
    )
    same = F.col("source").eqNullSafe(F.col("_source"))
    placed = rows.join(wanted.select("_source", "p"), same).withColumn("place", _place(seed))
    placed = placed.filter("place IS NOT NULL").select("source", "place", "size")
    ranked = keep(running_totals(placed, ["source"], ["place"], {"before": "size"}), "ranked")

    room = (F.col("target") - F.col("whole") * F.col("source_size")).alias("room")
    ranked = ranked.join(wanted.select("_source", room), same).drop("_source")
    inside = F.col("before") + F.col("size") <= F.col("room")
    spent = ranked.groupBy("source").agg(
        F.max(F.when(inside, F.col("place"))).alias("cut"),
        F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0)).alias("spent"),
    )
    spent = keep(spent.withColumnRenamed("source", "_source"), "spent")
    gap = F.col("room") - F.col("spent")
    off = F.abs(F.col("size") - gap)
    last = (
        ranked.filter(~inside & (F.col("size") > 0))
        .join(spent, same)
        .filter(off < gap)
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "place")).alias("last"))
    )
    last = keep(last.select(F.col("source").alias("_source"), F.col("last.place").alias("last")), "last")
    for more in (spent.select("_source", "cut"), last):
        more = more.withColumnRenamed("_source", "_other")
        wanted = wanted.join(more, F.col("_source").eqNullSafe(F.col("_other")), "left").drop("_other")
    return keep(wanted.withColumnRenamed("_source", "source"), "cuts")


def with_copies(rows: DataFrame, found: DataFrame, seed: str = "mix") -> DataFrame:
    """``rows`` (doc_id, source, size, …) with source_size, target and copies. Only the sources' rows move."""
    found = found.withColumnRenamed("source", "_source")
    place = _place(seed)
    more = F.coalesce((place <= F.col("cut")) | (place == F.col("last")), place == F.col("last"), place <= F.col("cut"), F.lit(False))
    return (
        rows.join(found, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copies", (F.col("whole") + more.cast("long")).cast("long"))
        .drop("_source", "whole", "p", "cut", "last")
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: str = "mix"
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (whole times the mix takes
    it, 0 to ``most``), taken (copies * size).

    Null texts have no words and null sources are a source. Rows repeated with one doc_id, size and
    source share their place, so they are taken alike. A source without words has no copies. Other
    columns are not read; an empty table gives no rows.
    """
    rows = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return with_copies(rows, cuts(rows, weights, most, seed), seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: str = "mix"
) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns. Texts stay where they
    are read; documents without words are never wanted and go."""
    size = word_count(F.col("text"))
    rows = keep(docs.select("doc_id", "source", size.alias("size")), "sizes")
    found = cuts(rows, weights, most, seed)
    whole = docs.select("doc_id", "source", size.alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    taken = with_copies(whole, found, seed).filter("copies > 0 AND size > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ((('0x' || substr(md5('mix' || doc_id::VARCHAR), 1, 13))::BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS others
      FROM w WINDOW before AS (ORDER BY 3 * source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * source_size * others < weight * rest AS is_full FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE weight *
        ((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (is_full) OVER (), 0))::DOUBLE /
         (sum(weight) OVER () - coalesce(sum(weight) FILTER (is_full) OVER (), 0))) END AS target FROM f),
r AS (SELECT d.*, source_size, target, floor(target / source_size) AS n, target / source_size - floor(target / source_size) AS p
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS odds, target - n * source_size AS room FROM r),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM o),
i AS (SELECT *, p > 0 AND used + size <= room AS inside FROM c),
g AS (SELECT *, room - coalesce(sum(size) FILTER (inside) OVER (PARTITION BY source), 0) AS gap FROM i),
e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (p > 0 AND NOT inside AND size > 0 AND abs(size - gap) < gap) DESC, abs(size - gap), odds, doc_id) = 1
             AND p > 0 AND NOT inside AND size > 0 AND abs(size - gap) < gap AS extra FROM g)
SELECT doc_id, size, source_size, target, ((n + (inside OR extra)::INT) * size)::BIGINT AS taken FROM e
"""
