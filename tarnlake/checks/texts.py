"""TXT: text enrichment on whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from tarnlake.checks.registry import check
from tarnlake.checks.relational import rounded
from tarnlake.checks.values import ANSWER, CATEGORY, REQUIRED
from tarnlake.operators import enrich as txt
from tarnlake.operators.scorers import batch_category
from tarnlake.session import work_path

# A tool over words that do occur in the documents.
LICENSE_TOOL = {
    "type": "categorization",
    "options": ["Legal", "Other"],
    "terms": {"Legal": ["license", "copyright", "rights reserved"], "Other": ["token", "the"]},
    "output": {
        "classification": "{source_col}_classification",
        "confidence": "{source_col}_confidence",
        "reasoning": "{source_col}_reasoning",
    },
}


def word(term: str, column: str = "text") -> str:
    return f"regexp_matches(lower({column}), '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


_HITS = f"""SELECT doc_id, CAST({word('license')} AS INT) + CAST({word('copyright')} AS INT)
    + CAST({word('rights reserved')} AS INT) AS legal,
  CAST({word('token')} AS INT) + CAST({word('the')} AS INT) AS other,
  array_to_string(list_filter([CASE WHEN {word('license')} THEN 'license' END,
    CASE WHEN {word('copyright')} THEN 'copyright' END,
    CASE WHEN {word('rights reserved')} THEN 'rights reserved' END], lambda x: x IS NOT NULL), ', ') AS legal_words,
  array_to_string(list_filter([CASE WHEN {word('token')} THEN 'token' END,
    CASE WHEN {word('the')} THEN 'the' END], lambda x: x IS NOT NULL), ', ') AS other_words,
  lang = 'fr' AS blank
  FROM documents"""


@check(
    "txt_01_categorize",
    f"""SELECT doc_id,
          CASE WHEN blank OR legal + other = 0 OR legal < other THEN 'Other' ELSE 'Legal' END AS text_classification,
          CASE WHEN blank THEN 0 WHEN legal + other = 0 THEN 0.5
               ELSE round(greatest(legal, other) / CAST(legal + other AS DOUBLE), 6) END AS text_confidence,
          CASE WHEN blank THEN 'No text provided for analysis' WHEN legal + other = 0 THEN 'No key term found'
               WHEN legal >= other THEN 'Matched: ' || legal_words ELSE 'Matched: ' || other_words END AS text_reasoning
        FROM ({_HITS})""",
)
def _(lake):
    blank = F.when(F.col("lang") == "fr", F.lit(" \n ")).otherwise(F.col("text"))
    docs = lake.documents.select("doc_id", blank.alias("text"))
    return rounded(txt.categorize(docs, LICENSE_TOOL, ["text"]).drop("text"), 6, "text_confidence")


@check(
    "txt_01_batch_scorer",
    f"""SELECT doc_id, CASE WHEN {word('license')} THEN 'Legal' ELSE 'Other' END AS text_classification,
          length(text) / 100000.0 AS text_confidence, 'batch' AS text_reasoning FROM documents""",
)
def _(lake):
    def score(texts: pd.Series) -> pd.DataFrame:
        legal = texts.str.lower().str.contains(r"(?:^|[^a-z0-9])license(?:[^a-z0-9]|$)", regex=True)
        return pd.DataFrame(
            {
                "classification": legal.map({True: "Legal", False: "Other"}),
                "confidence": texts.str.len() / 100000.0,
                "reasoning": "batch",
            }
        )

    docs = lake.documents.select("doc_id", "text")
    return txt.categorize(docs, LICENSE_TOOL, ["text"], batch_category(score, "Other")).drop("text")


SENTIMENT_TOOL = {
    "type": "sentiment",
    "aspects": {"legal": ["license"], "common": ["the", "and"]},
    "output": {
        "legal": "{source_col}_legal_sentiment",
        "common": "{source_col}_common_sentiment",
        "overall": "{source_col}_overall_sentiment",
        "reasoning": "{source_col}_sentiment_reason",
    },
}


@check(
    "txt_02_sentiment",
    f"""SELECT event_id, CAST(CASE WHEN event_type = 'purchase' AND value >= 20 THEN 1 ELSE 0 END AS DOUBLE) AS note_legal_sentiment,
          CAST(CASE WHEN event_type = 'error' THEN 0 WHEN value >= 5 AND value < 20 THEN 1
                    WHEN event_type = 'purchase' THEN 0.5 ELSE s END AS DOUBLE) AS note_common_sentiment,
          CAST(CASE WHEN event_type = 'error' THEN 0 ELSE s END AS DOUBLE) AS note_overall_sentiment,
          CASE WHEN event_type = 'error' THEN 'No text provided for analysis' ELSE 'Scored by word lists' END
            AS note_sentiment_reason
        FROM (SELECT *, CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 0.5 ELSE 1 END AS s FROM events)""",
)
def _(lake):
    mood = F.when(F.col("value") < 5, "bad").when(F.col("value") < 20, "good but bad").otherwise("Great")
    note = F.when(F.col("event_type") == "error", F.lit("")).otherwise(
        F.concat(
            F.lit("The visit was "), mood,
            F.when(F.col("event_type") == "purchase", " with a license").otherwise(""),
        )
    )
    notes = lake.events.select("event_id", note.alias("note"))
    return txt.sentiment(notes, SENTIMENT_TOOL, "note").drop("note")


@check(
    "txt_03_row_errors",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'A' || CAST(user_id AS VARCHAR) WHEN 'view' THEN 'B'
         ELSE 'Non-AI' END AS classification,
         CAST(CASE event_type WHEN 'click' THEN 0.75 WHEN 'view' THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence,
         CASE event_type WHEN 'click' THEN 'r' WHEN 'view' THEN 's' WHEN 'error' THEN 'Error: no response'
           ELSE 'Failed to parse response' END AS reasoning FROM events""",
)
def _(lake):
    result = txt.with_default(F.expr(ANSWER), CATEGORY, REQUIRED, "Non-AI")
    return lake.events.select("event_id", result.alias("r")).select("event_id", "r.*")


@check(
    "txt_05_batch_transform",
    """SELECT event_id, user_id * 2 AS doubled, CAST(NULL AS VARCHAR) AS error FROM events WHERE value <= 300
       UNION ALL SELECT event_id, NULL, 'value too large' FROM events WHERE value > 300""",
)
def _(lake):
    def double(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["value"] > 300).any():
            raise ValueError("value too large")
        return pd.DataFrame({"doubled": batch["user_id"] * 2})

    rows = lake.events.select("event_id", "user_id", "value")
    path = work_path(lake.spark, "batch-transform")
    done, failed = txt.transform_batch(rows, double, "doubled: bigint", path)
    key = F.get_json_object("original", "$.event_id").cast("long").alias("event_id")
    return done.select(key, "transformed.doubled", F.lit(None).cast("string").alias("error")).unionAll(
        failed.select(key, F.lit(None).cast("long"), "error")
    )


@check(
    "txt_06_key_terms",
    f"""SELECT doc_id, 'Yes' AS "AI_Classification" FROM documents
        WHERE {word('license')} OR {word('token')} OR {word('rights reserved')}""",
)
def _(lake):
    docs = lake.documents.select("doc_id", "text")
    return txt.ai_companies(docs, "text", ["license", "token", "rights reserved"]).drop("text")


@check(
    "txt_07_custom",
    """SELECT p_partkey, length('Sort ' || p_name || ' of ' || p_brand) AS n, p_name AS label FROM part""",
)
def _(lake):
    def answer(prompt):
        label = F.regexp_extract(prompt, "^Sort (.*) of ", 1)
        return F.to_json(F.struct(F.length(prompt).alias("n"), label.alias("label")))

    out = txt.custom(
        lake.part, "Sort {p_name} of {p_brand}", ["p_name", "p_brand"], answer,
        "n bigint, label string", "result",
    )
    return out.select("p_partkey", "result.n", "result.label")


_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"\+[0-9][0-9 ()-]{8,}[0-9]",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "url": r'https?://[^\s"<>]+',
}


@check(
    "txt_08_entities",
    " UNION ALL ".join(
        f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS entity, '{k}' AS type FROM documents"
        for k, p in _KINDS.items()
    ),
)
def _(lake):
    found = lake.documents.select("doc_id", F.explode(txt.entities(F.col("text"))).alias("e"))
    return found.select("doc_id", "e.entity", "e.type")


@check(
    "txt_09_label_scores",
    """SELECT event_id, CASE WHEN value / 100 >= 0.7 THEN 'positive' WHEN value / 100 <= 0.3 THEN 'negative'
         ELSE 'neutral' END AS label FROM events""",
)
def _(lake):
    return lake.events.select("event_id", txt.label_score(F.col("value") / 100).alias("label"))


@check(
    "txt_10_confidence_gate",
    """SELECT event_id, CASE WHEN value / 100 >= 0.7 THEN event_type ELSE 'unknown' END AS label FROM events""",
)
def _(lake):
    gated = txt.gate(F.col("event_type"), F.col("value") / 100)
    return lake.events.select("event_id", gated.alias("label"))


@check(
    "txt_11_classify",
    """SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS kind FROM conversations""",
)
def _(lake):
    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kind = (batch["text"].str.len() > 200).map({True: "long", False: "short"})
            yield batch[["conv_id", "turn"]].assign(kind=kind)

    talk = lake.conversations.select("conv_id", "turn", "text")
    return txt.classify(talk, classify, "conv_id bigint, turn bigint, kind string")
