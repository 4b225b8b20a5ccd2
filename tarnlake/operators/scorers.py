"""Text scorers: keyword rules as plain column expressions, and user functions over batches.

A scorer maps a text column to a struct column. The rule scorers stay inside the JVM; a user's
batch function (a model, a remote call) runs as a pandas UDF over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlake.functions.text import let

CATEGORY = "struct<classification:string,confidence:double,reasoning:string>"

# Terms that mark a company as an AI company.
AI_TERMS = [
    "llm", "generative ai", "machine learning", "artificial intelligence", "deep learning",
    "neural network", "neural networks", "data science", "ai", "ml",
]

# Small word lists of the default sentiment rules.
POSITIVE_WORDS = [
    "good", "great", "excellent", "amazing", "love", "loved", "friendly", "fresh", "delicious",
    "best", "perfect", "happy", "helpful", "outstanding",
]
NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "worst", "slow", "cold", "rude", "poor", "hate", "hated",
    "disappointing", "overpriced", "broken", "never",
]


def has_term(text: Column, term: str) -> Column:
    """Whether a lower-case text contains a term as whole words.

    The plain search decides most texts; the expression starts with the term itself, so that it is
    searched for as fast, and then looks at the characters on both sides.
    """
    word = re.escape(term.lower())
    whole = rf"{word}(?<![a-z0-9]{word})(?![a-z0-9])"
    return text.contains(term.lower()) & text.rlike(whole)


def _found(low: Column, terms: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(has_term(low, t), F.lit(t)) for t in terms]))


def matched_terms(text: Column, terms: list[str]) -> Column:
    """The terms found in a text, in the order of the list."""
    return let(F.lower(text), lambda low: _found(low, terms))


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether any term is found; the search stops at the first."""
    return let(
        F.lower(text), lambda low: reduce(lambda a, b: a | b, [has_term(low, t) for t in terms])
    )


def keyword_category(options: list[str], terms: dict[str, list[str]]) -> Callable[[Column], Column]:
    """Rule scorer: the option with most matched terms (the earlier one on a tie), its share of all
    matches as confidence; without a match the second option with confidence 0.5."""
    ruled = [o for o in options if terms.get(o)]

    def choose(found: Column) -> Column:
        lists = [found.getField(f"m{i}") for i in range(len(ruled))]
        hits = [F.size(m) for m in lists]
        total = reduce(lambda a, b: a + b, hits)
        best = F.greatest(*hits) if len(hits) > 1 else hits[0]
        label, matched = F, F
        for option, words, n in zip(ruled, lists, hits):
            label = label.when(n == best, F.lit(option))
            matched = matched.when(n == best, words)
        return F.when(
            total > 0,
            F.struct(
                label.alias("classification"),
                (best / total).cast("double").alias("confidence"),
                F.concat(F.lit("Matched: "), F.array_join(matched, ", ")).alias("reasoning"),
            ),
        ).otherwise(
            F.struct(
                F.lit(options[1]).alias("classification"),
                F.lit(0.5).alias("confidence"),
                F.lit("No key term found").alias("reasoning"),
            )
        )

    def score(text: Column) -> Column:
        def lists(low: Column) -> Column:
            return F.struct(*[_found(low, terms[o]).alias(f"m{i}") for i, o in enumerate(ruled)])

        return let(let(F.lower(text), lists), choose)

    return score


# Words after which a new clause begins.
CLAUSE_WORDS = ["but", "however", "although", "though", "while", "whereas", "yet"]
_CLAUSES = rf"[.,;:!?\n]+|\b(?:{'|'.join(CLAUSE_WORDS)})\b"


def _hits(low: Column, aspects: dict[str, list[str]]) -> Column:
    """Every positive and negative word of a lower-case text with the aspect named nearest to it in its clause (of two
    as near, the one that follows; null in a clause that names none): array of (good, aspect)."""
    terms = {term.lower(): aspect for aspect, words in aspects.items() for term in words}
    # a term of several words becomes one
    for term in sorted((t for t in terms if " " in t), key=len, reverse=True):
        low = F.replace(low, F.lit(term), F.lit(term.replace(" ", "_")))
    named = F.create_map(*[F.lit(x) for t, a in terms.items() for x in (t.replace(" ", "_"), a)])
    good, bad = F.array(*map(F.lit, POSITIVE_WORDS)), F.array(*map(F.lit, NEGATIVE_WORDS))

    def of_clause(clause: Column) -> Column:
        words = F.regexp_extract_all(clause, F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
        placed = lambda keep, what: F.filter(
            F.transform(words, lambda w, i: F.when(keep(w), F.struct(i.alias("at"), what(w).alias("is")))), lambda m: m.isNotNull()
        )
        found = F.struct(
            placed(lambda w: F.array_contains(good, w) | F.array_contains(bad, w), lambda w: F.array_contains(good, w)).alias("hits"),
            placed(lambda w: F.map_contains_key(named, w), lambda w: F.try_element_at(named, w)).alias("names"),
        )
        return let(found, assigned)

    def assigned(found: Column) -> Column:
        def one(hit: Column) -> Column:
            far = lambda n: F.abs(n["at"] - hit["at"]) * 2 + (n["at"] < hit["at"]).cast("int")
            near = F.array_min(F.transform(found["names"], lambda n: F.struct(far(n).alias("far"), n["is"].alias("is"))))
            return F.struct(hit["is"].alias("good"), near["is"].alias("aspect"))

        return F.transform(found["hits"], one)

    return F.flatten(F.transform(F.split(low, _CLAUSES), of_clause))


def keyword_sentiment(aspects: dict[str, list[str]]) -> Callable[[Column], Column]:
    """Rule scorer: values in [0, 1], shares of positive among positive and negative words.

    ``overall`` is that of the whole text. Each aspect has that of the words that stand nearest to it in their clause; an
    aspect that is named without such words has that of the clauses that name no aspect; one that is not named has 0.0. Without
    any such word a share is 0.5.
    """

    def share(good: Column, bad: Column, otherwise: Column) -> Column:
        return F.when(good + bad > 0, good / (good + bad)).otherwise(otherwise)

    def score(text: Column) -> Column:
        def values(low: Column) -> Column:
            words = F.struct(
                _found(low, POSITIVE_WORDS).alias("good"), _found(low, NEGATIVE_WORDS).alias("bad")
            )
            overall = let(words, lambda w: share(F.size(w["good"]), F.size(w["bad"]), F.lit(0.5)))
            return let(F.struct(overall.alias("overall"), _hits(low, aspects).alias("hits")), lambda f: by_aspect(low, f))

        def by_aspect(low: Column, found: Column) -> Column:
            def of(aspect: Column, otherwise: Column) -> Column:
                mine = F.filter(found["hits"], lambda h: h["aspect"].eqNullSafe(aspect))
                return let(mine, lambda m: share(F.size(F.filter(m, lambda h: h["good"])), F.size(F.filter(m, lambda h: ~h["good"])), otherwise))

            general = of(F.lit(None).cast("string"), F.lit(0.5))
            named = [
                x
                for aspect, words in aspects.items()
                for x in (F.lit(aspect), F.when(any_term(low, words), of(F.lit(aspect), general)).otherwise(F.lit(0.0)))
            ]
            return F.create_map(*named, F.lit("overall"), found["overall"])

        return let(F.lower(text), values)

    return score


def try_rows(
    function: Callable[[pd.DataFrame], pd.DataFrame], batch: pd.DataFrame
) -> list[tuple[dict | None, str | None]]:
    """(result, error) of each row. A batch that raises is halved until the rows at fault are
    alone, so a few bad rows cost few calls and lose nothing but themselves."""
    try:
        rows = function(batch).to_dict("records")
        if len(rows) != len(batch):
            raise ValueError(f"{len(rows)} results for {len(batch)} rows")
        return [(row, None) for row in rows]
    except Exception as error:
        if len(batch) == 1:
            return [(None, str(error))]
        half = len(batch) // 2
        return try_rows(function, batch.iloc[:half]) + try_rows(function, batch.iloc[half:])


def batch_category(
    function: Callable[[pd.Series], pd.DataFrame], failure: str
) -> Callable[[Column], Column]:
    """Scorer from a batch function text → (classification, confidence, reasoning).

    A row that raises gets the failure label with the error as its reason; one bad text never
    fails the job.
    """
    names = ["classification", "confidence", "reasoning"]

    @F.pandas_udf(CATEGORY)
    def score(texts: pd.Series) -> pd.DataFrame:
        done = try_rows(lambda batch: function(batch["text"])[names], texts.to_frame("text"))
        return pd.DataFrame(
            [
                row or {"classification": failure, "confidence": 0.0, "reasoning": f"Error: {error}"}
                for row, error in done
            ],
            columns=names,
        )

    return score
