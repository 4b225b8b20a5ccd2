"""URL rules by a sort-merge range join, in DataFrame operations only.

A rule is a host and a path; it fits urls on its host or a subdomain whose path starts with the
rule's. Keys are canonical: the host's labels in reverse order, then the path. For a rule host, the urls
that a rule fits are one interval of such keys, and the intervals of the rules of a host are nested
or apart. A sweep over the sorted boundaries keeps the stack of open rules: each boundary knows the
innermost rule from there on. Urls are sorted in between and take the rule of the last boundary
before them. A url is swept once for each of its ancestor hosts that has rules, so at most as often
as the longest rule host has labels; the longest of the rules found wins.

Sweeps run per (rule host, salt): the urls of each rule host are counted, a host has a salt for every
``SWEPT`` of them, its boundaries are repeated for each salt and its urls are dealt out among the salts. So a
host with a third of all urls is as many tasks as its size needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm.words import table
from tarnlake.names import quoted
from tarnlake.session import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the registered query
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: urls of a rule host in one sweep
SWEPT = 1 << 17
#: but so many salts at least, one per url at most, so that small tables run in parallel as well
SALTS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case) and path
    (up to ``?``, ``#`` or the end); both empty for null or without ``://``."""
    after = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, after, 1), UPPER, LOWER), F.regexp_extract(url, after, 2)


def reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def boundaries(rules: DataFrame) -> DataFrame:
    """The sorted sweep over the rules: domain, at (place on the key line), closes (0 opens, 1
    closes), rule (the innermost open one from there on, null: none).

    A rule's interval runs from its path to the last key that starts with it. Depth is the running
    number of open rules; what is open after a boundary at depth d is the last rule opened at that
    depth, so the stack is a window per (host, depth). Of rules repeated for a host and path the
    blocking one counts; rules without a host, path or verdict are ignored.
    """
    rules = (
        rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
    )
    labels = F.split("host", r"\.")
    rules = rules.select(
        reversed_host(labels).alias("domain"),
        F.size(labels).alias("labels"),
        "path",
        F.struct(
            F.char_length(F.concat("host", "path")).alias("length"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("rule"),
    )
    edge = lambda closes: F.struct(F.lit(closes).alias("closes"))
    events = rules.select("*", F.explode(F.array(edge(0), edge(1))).alias("edge")).select(
        "domain", "labels", "path", "rule", F.col("edge.closes").alias("closes")
    )
    # nested intervals that end together close from the inside: the longer path first
    place = [F.when(F.col("closes") == 0, F.col("path")).otherwise(F.concat("path", F.lit(LAST))), F.col("closes")]
    events = events.select("*", place[0].alias("at"), F.when(F.col("closes") == 1, -F.length("path")).otherwise(F.length("path")).alias("tie"))
    line = Window.partitionBy("domain").orderBy("at", "closes", "tie").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("depth", F.sum(F.when(F.col("closes") == 0, 1).otherwise(-1)).over(line))
    level = Window.partitionBy("domain", "depth").orderBy("at", "closes", "tie").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("closes") == 0, F.col("rule")), ignorenulls=True).over(level)
    return events.select(
        "domain", "labels", "at", "closes", "tie", F.when(F.col("depth") > 0, opened).alias("rule")
    )


#: sorts after every character that a path continues with
LAST = "\U0010ffff\U0010ffff"


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", salts: int = SALTS,
    swept: int = SWEPT,
) -> DataFrame:
    """``pages`` (columns named below replaced) with host, path, rule (``host`` + ``path`` of the longest
    rule that fits, null: none) and verdict (that rule's, else ``otherwise``).

    Of rules of the same length on different hosts the one later in code-point order wins. Null and
    malformed urls have an empty host and path and fit no rule. Repeated rows are judged each;
    without rules every url gets ``otherwise``.
    """
    host, path = host_and_path(F.col(quoted(url)))
    others = pages.drop("host", "path", "rule", "verdict").columns
    # the own columns in one struct, so that none of any name is in the way
    box = F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in others]).alias("box")
    rows = pages.select(box, host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    rows = keep(rows, "urls")
    unboxed = [F.col(f"box.{quoted(c)}").alias(c) for c in others]
    edges = keep(boundaries(rules), "boundaries")  # read more than once below
    depths = [r[0] for r in edges.select("labels").distinct().collect()]  # at most 127 by DNS
    if not depths:
        return rows.select(*unboxed, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    labels = F.split("host", r"\.")
    ancestors = F.filter(
        F.array(*[F.when(F.size(labels) >= d, reversed_host(F.slice(labels, -d, d))) for d in depths]),
        lambda domain: domain.isNotNull(),
    )
    keys = rows.select("row", F.explode(ancestors).alias("domain"), F.col("path").alias("at"))
    # one row per rule host and number of salts; hosts without a rule leave
    asked = keys.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    needed = F.least("n", F.greatest(F.lit(salts), F.ceil(F.col("n") / swept))).cast("int")
    hosts = edges.select("domain").distinct().join(asked, "domain").select("domain", needed.alias("salts"))
    hosts = keep(hosts, "hosts")
    rule = edges.schema["rule"].dataType
    salted = keys.join(hosts, "domain").select(
        "domain", F.pmod(F.hash("row"), F.col("salts")).alias("salt"), "at", F.lit(0).alias("closes"),
        F.lit(1 << 30).alias("tie"), F.lit(None).cast(rule).alias("rule"), "row",
    )
    repeated = edges.join(hosts, "domain").select(
        "domain", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "at", "closes",
        "tie", F.coalesce("rule", F.struct(F.lit(0).alias("length"), F.lit("").alias("rule"), F.lit("").alias("verdict"))).alias("rule"),
        F.lit(None).cast("long").alias("row"),
    )
    sweep = Window.partitionBy("domain", "salt").orderBy("at", "closes", "tie")
    sweep = sweep.rowsBetween(Window.unboundedPreceding, 0)
    found = (
        salted.unionByName(repeated)
        .withColumn("rule", F.last("rule", ignorenulls=True).over(sweep))
        .filter("row IS NOT NULL AND rule.length > 0")
        .groupBy("row")
        .agg(F.max("rule").alias("found"))
    )
    return rows.join(found, "row", "left").select(
        *unboxed, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(otherwise)).alias("verdict")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, rule_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (
  SELECT page_id,
         translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM u),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM s LEFT JOIN m USING (page_id)
"""
