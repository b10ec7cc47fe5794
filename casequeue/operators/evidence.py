"""Text evidence: injection flags, quote grounding, draft checks, token cost."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from casequeue.functions.text import strip

# Signals that a narrative addresses a model, tested in any case.
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?previous",
    r"system\s+prompt",
    r"developer\s+message",
    r"assistant\s*:",
    r"<\s*system",
    r"follow\s+these\s+instructions",
    r"reveal\s+(the\s+)?prompt",
)
INJECTION_FLAG = "possible_prompt_injection_in_source_text"

# Bounds of a draft.
MINIMUM_DRAFT_INPUT = 20
EXTRACT_FALLBACK = 240
HEADLINE_CHARS = (1, 180)
SUMMARY_CHARS = (1, 1200)
QUOTE_CHARS = (1, 800)
LIST_SIZES = {
    "key_points": (1, 6),
    "evidence_quotes": (1, 4),
    "missing_information": (0, 6),
    "risk_flags": (0, 6),
    "recommended_human_actions": (0, 5),
}

# USD per million tokens (input, cached input, output) by model.
PRICE_PER_MILLION = {"gpt-5.6-luna": (0.20, 0.02, 1.20)}


def injection_flag(text: Column) -> Column:
    """Whether any pattern occurs; one scan of the text."""
    return text.rlike("(?iU)(" + "|".join(INJECTION_PATTERNS) + ")")


def add_risk_flag(flags: Column, condition: Column, flag: str = INJECTION_FLAG) -> Column:
    """Append a flag where the condition holds; first occurrences keep their order."""
    return F.when(condition, F.array_distinct(F.array_append(flags, F.lit(flag)))).otherwise(flags)


def draft_input(narrative: Column, longest: int | None = None) -> Column:
    """The text a draft is written from: all of it, or its first `longest` characters.

    A bound is that of a model's prompt, which the caller knows.
    """
    return narrative if longest is None else F.left(narrative, F.lit(longest))


def draft_eligible(cases: DataFrame, longest: int | None = None) -> DataFrame:
    """Cases a draft can be requested for, judged on the whole text, with `draft_input`."""
    text = F.col("narrative")
    return cases.where(
        F.col("has_narrative")
        & (F.coalesce(F.length(strip(text)), F.lit(0)) >= MINIMUM_DRAFT_INPUT)
    ).withColumn("draft_input", draft_input(text, longest))


def first_sentence(text: Column) -> Column:
    """Through the first `.`, `!` or `?`; without one, the first 240 characters."""
    ends = [F.nullif(F.instr(text, mark), F.lit(0)) for mark in (".", "!", "?")]
    return F.left(text, F.coalesce(F.least(*ends), F.lit(EXTRACT_FALLBACK)))


def _find(quote: Column, text: Column, start: Column) -> Column:
    """One-based position of `quote` at or after `start`, 0 when absent."""
    return F.call_function("locate", quote, text, start)


def _positions_udf():
    def starts(texts: pd.Series, quotes: pd.Series) -> pd.Series:
        def one(text, quote):
            if text is None or quote is None:
                return None
            found, at = [], text.find(quote) if quote else -1
            while at >= 0:
                found.append(at)
                at = text.find(quote, at + 1)
            return found

        return pd.Series([one(t, q) for t, q in zip(texts, quotes, strict=True)], dtype=object)

    return F.pandas_udf(starts, ArrayType(IntegerType()))


def quote_positions(text: Column, quote: Column) -> Column:
    """Zero-based starts of every occurrence, overlapping ones included.

    Only texts that hold the quote go to the Arrow function, which is linear in
    the text and its hits; the others never leave the JVM.
    """
    none = F.array().cast("array<int>")
    holds = (quote != "") & F.contains(text, quote)
    found = _positions_udf()(F.when(holds, text), F.when(holds, quote))
    return F.when(holds, found).when(text.isNotNull() & quote.isNotNull(), none)


def _span(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def _exact(text: Column, quote: Column) -> Column:
    start, end = quote["start"], quote["end"]
    return (
        (start >= 0) & (end > start) & (end <= F.length(text))
    ) & (_span(text, start, end) == quote["text"])


def grounded_quote(text: Column, quote: Column) -> Column:
    """The quote with usable offsets, or NULL when it is not grounded.

    Absent text fails. A unique occurrence repairs the offsets. A repeated one
    needs the given offsets to be exact. Two searches tell these cases apart.
    """
    first = _find(quote["text"], text, F.lit(1))
    again = _find(quote["text"], text, first + 1)
    repaired = F.struct(
        quote["text"].alias("text"),
        (first - 1).alias("start"),
        (first - 1 + F.length(quote["text"])).alias("end"),
    )
    kept = F.struct(
        quote["text"].alias("text"), quote["start"].alias("start"), quote["end"].alias("end")
    )
    return F.when((first > 0) & (again == 0), repaired).when(
        (first > 0) & _exact(text, quote), kept
    )


def ground_quotes(drafts: DataFrame, text: str = "narrative", quotes: str = "quotes") -> DataFrame:
    """Repair the quotes of each draft in place; `grounded` tells whether all hold."""
    fixed = F.transform(quotes, lambda q: grounded_quote(F.col(text), q))
    return drafts.withColumn(quotes, fixed).withColumn(
        "grounded", F.forall(quotes, lambda q: q.isNotNull())
    )


def split_grounded(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) drafts of `ground_quotes`."""
    ok = F.coalesce(F.col("grounded"), F.lit(False))
    return drafts.where(ok).drop("grounded"), drafts.where(~ok).drop("grounded")


def quotes_valid(text: Column, quotes: Column) -> Column:
    """Whether every span lies inside the text and equals its quote."""
    return F.forall(
        quotes,
        lambda q: (q["end"] <= F.length(text)) & (_span(text, q["start"], q["end"]) == q["text"]),
    )


def draft_errors(payload: Column) -> Column:
    """Names of the bounds a draft payload breaks, in field order."""

    def chars(c: Column, bounds: tuple[int, int]) -> Column:
        return F.coalesce(F.length(c), F.lit(-1)).between(*bounds)

    rules = {
        "headline": chars(payload["headline"], HEADLINE_CHARS),
        "summary": chars(payload["summary"], SUMMARY_CHARS),
    }
    for name, (low, high) in LIST_SIZES.items():
        missing = F.lit(0 if low == 0 else -1)
        rules[name] = F.coalesce(F.array_size(payload[name]), missing).between(low, high)
    rules["quote_bounds"] = F.forall(
        payload["evidence_quotes"],
        lambda q: chars(q["text"], QUOTE_CHARS) & (q["start"] >= 0) & (q["end"] > 0),
    )
    return F.array_compact(
        F.array(
            *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
        )
    )


def check_drafts(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) drafts by payload bounds; rejects carry `errors`."""
    marked = drafts.withColumn("errors", draft_errors(F.col("payload")))
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def token_cost(
    usage: DataFrame,
    prices: Mapping[str, tuple[float, float, float]] = PRICE_PER_MILLION,
    *,
    strict: bool = True,
) -> DataFrame:
    """Add `cost_usd`. A model without a price fails the job, or is NULL if not strict."""
    table = F.create_map(
        *[
            part
            for model, price in prices.items()
            for part in (F.lit(model), F.array(*[F.lit(float(p)) for p in price]))
        ]
    )
    price = F.try_element_at(table, F.col("model"))
    tokens_in, cached = F.col("input_tokens"), F.col("cached_input_tokens")
    cost = (
        F.greatest(tokens_in - cached, F.lit(0)) * price[0]
        + cached * price[1]
        + F.col("output_tokens") * price[2]
    ) / F.lit(1e6)
    unknown = F.raise_error(F.concat(F.lit("no price for model "), F.col("model"))).cast("double")
    missing = unknown if strict else F.lit(None).cast("double")
    return usage.withColumn("cost_usd", F.when(price.isNull(), missing).otherwise(F.round(cost, 8)))
