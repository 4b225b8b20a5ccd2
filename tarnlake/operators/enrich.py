"""Text-derived columns: categories, sentiment, entities, labels and their error policy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.json import parse_response
from tarnlake.functions.text import fill_template, is_blank, let
from tarnlake.operators.filters import drop_blank_rows, drop_empty_rows
from tarnlake.session import ship_package
from tarnlake.operators.scorers import (
    AI_TERMS, any_term, keyword_category, keyword_sentiment, try_rows,
)

Scorer = Callable[[Column], Column]

# The registered tools, their options, factors and output column names.
TOOLS: dict[str, dict] = {
    "ai_company_classifier": {
        "type": "categorization",
        "options": ["AI", "Non-AI"],
        "factors": [
            "1. Use of AI/ML technologies",
            "2. Focus on data science or machine learning",
            "3. AI-related products or services",
            "4. Mention of artificial intelligence, machine learning, or related terms",
        ],
        "terms": {"AI": AI_TERMS},
        "output": {
            "classification": "{source_col}_classification",
            "confidence": "{source_col}_confidence",
            "reasoning": "{source_col}_reasoning",
        },
    },
    "company_scalable_classification": {
        "type": "categorization",
        "options": ["Y", "N"],
        "factors": [],
        "terms": {
            "Y": ["enterprise", "developer", "developers", "infrastructure", "platform", "saas", "b2b"],
            "N": ["recruiting", "hiring", "music", "video", "drug", "patients", "robot", "accounting",
                  "marketing", "education"],
        },
        "output": {
            "classification": "{source_col}_scalable_cls",
            "confidence": "{source_col}_scalable_conf",
            "reasoning": "{source_col}_scalable_reason",
        },
    },
    "company_size_classification": {
        "type": "categorization",
        "options": ["Startup", "Small", "Medium", "Enterprise"],
        "factors": [
            "1. Revenue figures", "2. Employee count", "3. Market presence", "4. Industry standards",
        ],
        "terms": {
            "Startup": ["startup", "founded", "seed"],
            "Small": ["small", "local", "family"],
            "Medium": ["regional", "medium", "growing"],
            "Enterprise": ["global", "enterprise", "multinational", "worldwide"],
        },
        "output": {
            "classification": "{source_col}_size_cls",
            "confidence": "{source_col}_size_conf",
            "reasoning": "{source_col}_size_reason",
        },
    },
    "customer_sentiment_analysis": {
        "type": "sentiment",
        "factors": [
            "1. Product quality", "2. Customer service", "3. Value for money", "4. Overall experience",
        ],
        "aspects": {
            "product_quality": ["product", "quality", "food", "item"],
            "customer_service": ["service", "staff", "waiter", "support"],
            "value_for_money": ["price", "value", "money", "expensive", "cheap"],
        },
        "output": {
            "product_quality": "{source_col}_product_sentiment",
            "customer_service": "{source_col}_service_sentiment",
            "value_for_money": "{source_col}_value_sentiment",
            "overall": "{source_col}_overall_sentiment",
            "reasoning": "{source_col}_sentiment_reason",
        },
    },
}

NO_TEXT = "No text provided for analysis"


def tool_named(tool_id: str) -> dict:
    if tool_id not in TOOLS:
        raise ValueError(f"unknown tool {tool_id!r}; known: {sorted(TOOLS)}")
    return TOOLS[tool_id]


def output_names(tool: dict, source: str) -> dict[str, str]:
    """Output column names of a tool for one source column."""
    return {k: template.format(source_col=source) for k, template in tool["output"].items()}


def _require(df: DataFrame, columns: list[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"no such column: {', '.join(absent)}")


def prompt(tool: dict, template: str, text: Column) -> Column:
    """The filled prompt of a tool, for scorers that need one."""
    return fill_template(
        template,
        text=text,
        classification_options=F.lit(" or ".join(tool.get("options", []))),
        classification_factors=F.lit("\n".join(tool.get("factors", []))),
    )


def categorize(
    df: DataFrame, tool: dict, columns: list[str], scorer: Scorer | None = None, template: str | None = None
) -> DataFrame:
    """Add classification, confidence and reasoning of each text column.

    Blank or null text gets the second option with confidence 0.0. Each source column has its own
    result; nothing depends on row positions. With a ``template`` the scorer gets the tool's prompt with
    the text filled in, else the text.
    """
    _require(df, columns)
    score = scorer or keyword_category(tool["options"], tool["terms"])
    for source in columns:
        text = F.col(f"`{source}`")
        empty = F.struct(
            F.lit(tool["options"][1]).alias("classification"),
            F.lit(0.0).alias("confidence"),
            F.lit(NO_TEXT).alias("reasoning"),
        )
        asked = text if template is None else prompt(tool, template, text)
        df = df.withColumn("_r", F.when(text.isNull() | is_blank(text), empty).otherwise(score(asked)))
        df = df.withColumns(
            {name: F.col(f"_r.{part}") for part, name in output_names(tool, source).items()}
        ).drop("_r")
    return df


def sentiment(
    df: DataFrame, tool: dict, source: str, scorer: Scorer | None = None
) -> DataFrame:
    """Add one score per aspect, the overall score and a reason; empty text or a failure is 0.0."""
    _require(df, [source])
    score = scorer or keyword_sentiment(tool["aspects"])
    text = F.col(f"`{source}`")
    empty = text.isNull() | (text == "")
    names = output_names(tool, source)
    df = df.withColumn("_r", F.when(~empty, score(text)))
    columns = {
        names[a]: F.coalesce(F.try_element_at("_r", F.lit(a)), F.lit(0.0))
        for a in names
        if a != "reasoning"
    }
    reason = F.when(empty, F.lit(NO_TEXT)).otherwise(F.lit("Scored by word lists"))
    return df.withColumns({**columns, names["reasoning"]: reason}).drop("_r")


def with_default(
    response: Column, schema: str, required: list[str], default: str
) -> Column:
    """Parsed answer, or the default label with the reason for the failure."""

    def failed(reason: str) -> Column:
        return F.struct(
            F.lit(default).alias("classification"),
            F.lit(0.0).alias("confidence"),
            F.lit(reason).alias("reasoning"),
        )

    def answered(parsed: Column) -> Column:
        fields = ("classification", "confidence", "reasoning")
        return F.when(parsed.isNull(), failed("Failed to parse response")).otherwise(
            F.struct(*[parsed.getField(n).alias(n) for n in fields])
        )

    return F.when(response.isNull(), failed("Error: no response")).otherwise(
        let(parse_response(response, schema, required), answered)
    )


def apply_tool(
    df: DataFrame, tool_id: str, columns: list[str], scorer: Scorer | None = None
) -> DataFrame:
    """Drop empty and blank rows, then add the columns of a registered tool."""
    tool = tool_named(tool_id)
    _require(df, columns)
    rows = drop_blank_rows(drop_empty_rows(df))
    if tool["type"] == "categorization":
        return categorize(rows, tool, columns, scorer)
    for source in columns:
        rows = sentiment(rows, tool, source, scorer)
    return rows


def transform_batch(
    df: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    path: str,
    batch_size: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """(transformed rows, error rows) of a user function over batches of rows.

    Each row has the ``original`` row as JSON and the ``transformed`` one as struct of ``schema``,
    or the ``error``. The result is written to ``path`` once, so a costly function runs once per
    row although two frames are returned.
    """
    out = f"original string, transformed struct<{schema}>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), batch_size):
                batch = rows.iloc[start : start + batch_size]
                done = try_rows(function, batch.drop(columns="_original"))
                yield pd.DataFrame(
                    [(o, r, e) for o, (r, e) in zip(batch["_original"], done)],
                    columns=["original", "transformed", "error"],
                )

    ship_package(df.sparkSession)
    result = df.withColumn("_original", F.to_json(F.struct(*df.columns))).mapInPandas(run, out)
    result.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    return (
        written.filter("error IS NULL").drop("error"),
        written.filter("error IS NOT NULL").drop("transformed"),
    )


def ai_companies(df: DataFrame, column: str, terms: list[str] = AI_TERMS) -> DataFrame:
    """Rows whose text names a key term, with the label column ``AI_Classification``."""
    return df.filter(any_term(F.col(column), terms)).withColumn("AI_Classification", F.lit("Yes"))


def custom(
    df: DataFrame, template: str, inputs: list[str], answer: Scorer, output: str, name: str
) -> DataFrame:
    """Fill a user's template, score it, parse the JSON answer into the declared type."""
    filled = fill_template(template, **{c: F.col(c) for c in inputs})
    return df.withColumn(name, F.from_json(answer(filled), output))


# Patterns of the entity types, in ASCII classes, and a text each match contains.
ENTITY_PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@"),
    "phone": (r"\+[0-9][0-9 ()-]{8,}[0-9]", "+"),
    "date": (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "-"),
    "url": (r"https?://[^\s\"<>]+", "://"),
}


def entities(text: Column, types: list[str] | None = None) -> Column:
    """array<struct<entity, type>> of the entities in a text, by type and position."""

    def of_type(kind: str) -> Column:
        pattern, hint = ENTITY_PATTERNS[kind]
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        some = F.when(text.contains(hint), found).otherwise(F.array().cast("array<string>"))
        return F.transform(some, lambda e: F.struct(e.alias("entity"), F.lit(kind).alias("type")))

    return F.concat(*[of_type(kind) for kind in types or list(ENTITY_PATTERNS)])


def label_score(score: Column, positive: float = 0.7, negative: float = 0.3) -> Column:
    """positive, negative or neutral by two thresholds."""
    return (
        F.when(score >= positive, "positive").when(score <= negative, "negative").otherwise("neutral")
    )


def gate(label: Column, confidence: Column, threshold: float = 0.7) -> Column:
    """The label, or 'unknown' below the confidence threshold."""
    return F.when(confidence >= threshold, label).otherwise(F.lit("unknown"))


def classify(
    df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """A user's classify function over batches of the whole table."""
    ship_package(df.sparkSession)
    return df.mapInPandas(function, schema)
