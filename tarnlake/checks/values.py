"""FN: scalar, JSON and nested functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnlake.checks.registry import check
from tarnlake.checks.views import DIRTY, dirty_events
from tarnlake.functions import json as js
from tarnlake.functions import numbers, text, times

_SPACE = "[ \\t\\n\\r\\f\\x0b]+"


@check(
    "fn_01_trim_and_case",
    f"""SELECT event_id, regexp_replace(note, '^\\s+|\\s+$', '', 'g') AS stripped,
          trim(regexp_replace(note, '\\s+', ' ', 'g')) AS collapsed, lower(note) AS lowered,
          upper(note) AS uppered, length(note) AS n FROM {DIRTY}""",
)
def _(lake):
    c = F.col("note")
    return dirty_events(lake).select(
        "event_id",
        text.strip(c).alias("stripped"),
        text.collapse_spaces(c).alias("collapsed"),
        F.lower(c).alias("lowered"),
        F.upper(c).alias("uppered"),
        F.length(c).cast("long").alias("n"),
    )


@check(
    "fn_02_trim_character",
    "SELECT p_partkey, trim('__' || p_name || '_x__', '_') AS name FROM part",
)
def _(lake):
    padded = F.concat(F.lit("__"), "p_name", F.lit("_x__"))
    return lake.part.select("p_partkey", F.btrim(padded, F.lit("_")).alias("name"))


@check(
    "fn_03_matches",
    """SELECT doc_id, regexp_matches(text, '^[A-Z][a-z]+ (the|la|der)') AS anchored,
         contains(text, '@') AS has_at, starts_with(lang, 'e') AS starts, ends_with(source, '1') AS ends
       FROM documents""",
)
def _(lake):
    c = F.col("text")
    return lake.documents.select(
        "doc_id",
        c.rlike("^[A-Z][a-z]+ (the|la|der)").alias("anchored"),
        c.contains("@").alias("has_at"),
        F.col("lang").startswith("e").alias("starts"),
        F.col("source").endswith("1").alias("ends"),
    )


@check(
    "fn_04_null_words",
    f"SELECT event_id, CASE WHEN age IN ('unknown', 'invalid', 'null', 'nan', '') THEN NULL ELSE age END AS age FROM {DIRTY}",
)
def _(lake):
    return dirty_events(lake).select(
        "event_id", text.null_if_in(F.col("age"), numbers.MISSING_WORDS).alias("age")
    )


@check(
    "fn_05_path_parts",
    """SELECT page_id, regexp_extract(url, '^([a-z0-9]+)://', 1) AS scheme,
         regexp_extract(url, '^[a-z0-9]+://([^/]+)', 1) AS bucket,
         regexp_extract(url, '^[a-z0-9]+://[^/]+/?(.*)$', 1) AS key,
         string_split(url, '/')[-1] AS base,
         CASE WHEN contains(string_split(url, '/')[-1], '.')
              THEN '.' || string_split(string_split(url, '/')[-1], '.')[-1] ELSE '' END AS ext
       FROM pages""",
)
def _(lake):
    url = F.col("url")
    return lake.pages.select(
        "page_id",
        *[text.uri_part(url, p).alias(p) for p in ("scheme", "bucket", "key")],
        text.base_name(url).alias("base"),
        text.extension(url).alias("ext"),
    )


@check(
    "fn_06_template",
    """SELECT p_partkey, 'Classify "' || p_name || '" as ECONOMY or PROMO.' || chr(10) || 'Size: '
         || CAST(p_size AS VARCHAR) || ' {kept} ' || p_name AS prompt FROM part""",
)
def _(lake):
    template = 'Classify "{text}" as {options}.\nSize: {size} {brace}kept} {text}'
    filled = text.fill_template(
        template, text=F.col("p_name"), options=F.lit(" or ".join(["ECONOMY", "PROMO"])),
        size=F.col("p_size"), brace=F.lit("{"),
    )
    return lake.part.select("p_partkey", filled.alias("prompt"))


@check(
    "fn_07_md5",
    """SELECT c_custkey, md5('{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_mktsegment":"' || c_mktsegment
         || '","c_name":"' || c_name || '"}') AS digest FROM customer""",
)
def _(lake):
    digest = text.md5_of_fields(*[F.col(c) for c in sorted(["c_name", "c_custkey", "c_mktsegment"])])
    return lake.customer.select("c_custkey", digest.alias("digest"))


@check(
    "fn_08_times",
    f"""SELECT event_id, TRY_CAST(date AS TIMESTAMP) AS parsed,
          strftime(TRY_CAST(date AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS iso,
          strftime(TRY_CAST(date AS TIMESTAMP), '%Y%m%d_%H%M%S') AS stamp FROM {DIRTY}""",
)
def _(lake):
    parsed = times.parse_time(F.col("date"))
    return dirty_events(lake).select(
        "event_id", parsed.alias("parsed"), times.iso(parsed).alias("iso"),
        times.stamp(parsed).alias("stamp"),
    )


@check(
    "fn_09_durations",
    """SELECT event_id, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS seconds,
         strftime(ts - INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS cutoff FROM events""",
)
def _(lake):
    start = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    return lake.events.select(
        "event_id",
        times.seconds_between(start, F.col("ts")).alias("seconds"),
        F.date_format(times.minutes_before(F.col("ts"), 10), "yyyy-MM-dd HH:mm:ss").alias("cutoff"),
    )


@check(
    "fn_10_numbers",
    f"""SELECT event_id, TRY_CAST(age AS DOUBLE) AS number, value % 1 = 0 AS whole,
          CASE WHEN floor(value) = 0 THEN NULL ELSE round(user_id / floor(value), 6) END AS ratio,
          CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value - 5, 0.0), 1.0) END AS clamped FROM {DIRTY}""",
)
def _(lake):
    value = F.col("value")
    return dirty_events(lake).select(
        "event_id",
        numbers.to_number(F.col("age")).alias("number"),
        numbers.is_whole(value).alias("whole"),
        F.round(numbers.ratio(F.col("user_id"), F.floor(value)), 6).alias("ratio"),
        numbers.clamp01(value - 5).alias("clamped"),
    )


@check(
    "fn_10_variation",
    "SELECT lang, round(stddev_samp(n_chars) / avg(n_chars), 6) AS variation FROM documents GROUP BY lang",
)
def _(lake):
    return lake.documents.groupBy("lang").agg(
        F.round(numbers.variation(F.col("n_chars")), 6).alias("variation")
    )


def nested_events(lake, *more):
    props = F.from_json("props", "k int")
    return lake.events.select(
        F.col("event_id").alias("id"),
        F.struct(
            F.col("user_id").alias("user"),
            F.struct(F.col("event_type").alias("kind"), props.alias("props")).alias("what"),
        ).alias("body"),
        F.array("event_type", F.lit("x")).alias("tags"),
        *more,
    )


@check(
    "fn_11_flatten",
    """SELECT event_id AS id, user_id AS "body.user", event_type AS "body.what.kind",
         CAST(json_extract_string(props, '$.k') AS INT) AS "body.what.props.k",
         '["' || event_type || '","x"]' AS tags FROM events""",
)
def _(lake):
    return js.flatten(nested_events(lake))


@check(
    "fn_12_unwrap",
    """SELECT user_id AS u, event_type AS kind FROM events
       UNION ALL SELECT user_id + 1, 'next' FROM events""",
)
def _(lake):
    doc = F.concat(
        F.lit('{"rows": [{"u": '), F.col("user_id").cast("string"), F.lit(', "kind": "'), "event_type",
        F.lit('"}, {"u": '), (F.col("user_id") + 1).cast("string"), F.lit(', "kind": "next"}]}'),
    )
    parsed = lake.events.select(F.from_json(doc, "rows array<struct<u bigint, kind string>>").alias("d"))
    return js.unwrap(parsed.select("d.rows"))


@check(
    "fn_13_nested_lookup",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS absent FROM events""",
)
def _(lake):
    props = F.col("props")
    return lake.events.select(
        "event_id", js.get_path(props, "k").alias("k"), js.get_path(props, "a.b").alias("absent")
    )


@check(
    "fn_13_nullability",
    """SELECT event_type, bool_or(json_extract_string(props, '$.k') IS NULL) AS k_nullable,
         true AS absent_nullable FROM events GROUP BY event_type""",
)
def _(lake):
    props = F.col("props")
    return lake.events.groupBy("event_type").agg(
        js.is_nullable(js.get_path(props, "k")).alias("k_nullable"),
        js.is_nullable(js.get_path(props, "a.b")).alias("absent_nullable"),
    )


# Answers as a model gives them: fenced JSON, plain JSON, JSON without a field, prose.
ANSWER = """CASE event_type
  WHEN 'click' THEN '```json' || chr(10) || '{"classification": "A' || CAST(user_id AS STRING) || '", "confidence": 0.75, "reasoning": "r"}' || chr(10) || '```'
  WHEN 'view' THEN '{"classification": "B", "confidence": 0.5, "reasoning": "s"}'
  WHEN 'purchase' THEN '{"classification": "C"}'
  WHEN 'signup' THEN 'I can not tell'
  END"""
CATEGORY = "classification string, confidence double, reasoning string"
REQUIRED = ["classification", "confidence", "reasoning"]


@check(
    "fn_14_parse_response",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'A' || CAST(user_id AS VARCHAR) WHEN 'view' THEN 'B'
         ELSE 'Non-AI' END AS classification,
         CAST(CASE event_type WHEN 'click' THEN 0.75 WHEN 'view' THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence,
         event_type NOT IN ('click', 'view') AS failed FROM events""",
)
def _(lake):
    parsed = js.parse_response(F.expr(ANSWER), CATEGORY, REQUIRED)
    return lake.events.select("event_id", parsed.alias("r")).select(
        "event_id",
        F.coalesce("r.classification", F.lit("Non-AI")).alias("classification"),
        F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"),
        F.col("r").isNull().alias("failed"),
    )


# Lenient JSON: fences, bare keys and words, other literals, leading zeros, missing and trailing
# commas, an open string.
LENIENT = """CASE event_type
  WHEN 'click' THEN '```json' || chr(10) || '{kind: click, user: 00' || CAST(user_id AS STRING) || ', ok: TRUE, none: NULL, tags: ["a", "b",],}' || chr(10) || '```'
  WHEN 'view' THEN '{"kind": "view"' || chr(10) || '  "user": ' || CAST(user_id AS STRING) || ',' || chr(10) || ' "ok": False, "none": , "tags": []}'
  WHEN 'purchase' THEN '{"kind": "purchase",' || chr(10) || ' "user": ' || CAST(user_id AS STRING) || ', "ok": true, "tags": ["a"], "none": "open text' || chr(10) || '}'
  WHEN 'signup' THEN '{"kind": "signup", "user": ' || CAST(user_id AS STRING) || ', "ok": true, "none": "a, b: c", "tags": ["x"]}'
  ELSE 'nothing here' END"""


@check(
    "fn_15_repair_json",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind,
         CASE WHEN event_type <> 'error' THEN user_id END AS "user",
         CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN false ELSE true END AS ok,
         CASE event_type WHEN 'purchase' THEN 'open text' WHEN 'signup' THEN 'a, b: c' END AS none,
         CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 END AS tags
       FROM events""",
)
def _(lake):
    fixed = js.repair_json(F.expr(LENIENT))
    schema = "kind string, user bigint, ok boolean, none string, tags array<string>"
    return lake.events.select("event_id", F.from_json(fixed, schema).alias("r")).select(
        "event_id", "r.kind", "r.user", "r.ok", "r.none", F.size("r.tags").cast("long").alias("tags")
    )


@check(
    "fn_16_lift_details",
    """SELECT event_id, event_type = 'click' AS is_ai_company, CAST(0.25 AS DOUBLE) AS is_ai_company_ai_confidence,
         'because ' || event_type AS is_ai_company_ai_reasoning FROM events""",
)
def _(lake):
    result = F.struct(
        F.lit(0.25).alias("confidence"),
        F.struct(
            (F.col("event_type") == "click").alias("is_ai_company"),
            F.concat(F.lit("because "), "event_type").alias("reasoning"),
        ).alias("details"),
    )
    return lake.events.select("event_id", *js.lift_details(result))


# Declared result types of the text tools.
SENTIMENT_TYPE = (
    "sentiment string, score double, "
    "aspect_sentiments map<string, struct<sentiment: string, score: double>>"
)
CATEGORY_TYPE = (
    "category string, confidence double, details struct<is_ai_company: boolean, reasoning: string, "
    "ai_technologies: array<string>, ai_focus_areas: array<string>>"
)


@check(
    "fn_17_nested_types",
    """SELECT event_id, 'positive' AS sentiment, value AS score, value AS price_score, true AS is_ai_company,
         event_type AS first_technology FROM events""",
)
def _(lake):
    value = F.col("value")
    sentiment = F.to_json(
        F.struct(
            F.lit("positive").alias("sentiment"),
            value.alias("score"),
            F.create_map(
                F.lit("price"), F.struct(F.lit("positive").alias("sentiment"), value.alias("score"))
            ).alias("aspect_sentiments"),
        )
    )
    category = F.to_json(
        F.struct(
            F.lit("AI").alias("category"),
            F.struct(
                F.lit(True).alias("is_ai_company"), F.array("event_type").alias("ai_technologies")
            ).alias("details"),
        )
    )
    return lake.events.select(
        "event_id",
        F.from_json(sentiment, SENTIMENT_TYPE).alias("s"),
        F.from_json(category, CATEGORY_TYPE).alias("c"),
    ).select(
        "event_id",
        "s.sentiment",
        "s.score",
        F.expr("s.aspect_sentiments['price'].score").alias("price_score"),
        "c.details.is_ai_company",
        F.get("c.details.ai_technologies", F.lit(0)).alias("first_technology"),
    )


@check(
    "fn_18_arrays",
    """SELECT doc_id, len(w) AS words, list_contains(w, 'the') AS has_the,
         array_to_string(list_filter(w, lambda x: length(x) = 3), '|') AS short FROM (
           SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
)
def _(lake):
    words = lake.documents.select("doc_id", F.split("text", " ").alias("w"))
    return words.select(
        "doc_id",
        F.size("w").cast("long").alias("words"),
        F.array_contains("w", "the").alias("has_the"),
        F.array_join(F.filter("w", lambda x: F.length(x) == 3), "|").alias("short"),
    )


@check(
    "fn_18_explode",
    """SELECT word, count(*) AS n FROM (
         SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word""",
)
def _(lake):
    words = lake.documents.select(F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
