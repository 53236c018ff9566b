"""Column functions over logged SQL text, questions and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.functions.text import contains_any, contains_word, literal_map


def clean_sql_text(sql: Column) -> Column:
    """Logged SQL without fences, comments and a trailing semicolon; an aggregate
    written without parentheses gets them."""
    out = F.regexp_replace(sql, fv.SQL_FENCE, "")
    out = F.regexp_replace(out, fv.SQL_LINE_COMMENT, "")
    out = F.regexp_replace(out, fv.SQL_BLOCK_COMMENT, "")
    out = F.regexp_replace(F.trim(out), r"^\s+|\s+$", "")
    out = F.regexp_replace(out, fv.SQL_SEMICOLONS, "")
    out = F.regexp_replace(out, fv.SQL_BARE_AGGREGATE, "$1($2)")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def primary_table(sql: Column) -> Column:
    """First identifier after FROM, JOIN, UPDATE or INTO; null when there is none."""
    name = F.regexp_extract(sql, fv.SQL_TABLE, 1)
    return F.nullif(name, F.lit(""))


def extract_periods(question: Column) -> Column:
    """Number of periods asked for, clamped; the unit itself is not interpreted."""
    digits = F.regexp_extract(F.lower(question), fv.PERIODS_ASKED, 1)
    # Too long a number for an integer is certainly above the greatest one.
    number = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 9, F.lit(fv.MAX_PERIODS)).otherwise(digits.try_cast("int"))
    return F.when(number.isNull(), F.lit(fv.DEFAULT_PERIODS)).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(fv.MAX_PERIODS), number))
    )


def percent_change(last_actual: Column, last_forecast: Column) -> Column:
    return F.coalesce(
        F.try_divide((last_forecast - last_actual) * 100, F.nullif(last_actual, F.lit(0.0))),
        F.lit(0.0),
    )


def trend_label(percent: Column) -> Column:
    return (
        F.when(percent > fv.TREND_PERCENT, F.lit("upward"))
        .when(percent < -fv.TREND_PERCENT, F.lit("downward"))
        .otherwise(F.lit("stable"))
    )


def entity_from_question(question: Column, first_column: Column) -> Column:
    """Plural entity named in the question, else the cleaned first column, else 'items'."""
    lowered = F.lower(question)
    words = list(fv.ENTITIES)
    chain = F.when(lowered.contains(words[0]), F.lit(fv.ENTITIES[words[0]]))
    for word in words[1:]:
        chain = chain.when(lowered.contains(word), F.lit(fv.ENTITIES[word]))
    cleaned = F.trim(
        F.replace(
            F.regexp_replace(first_column, r"(?i)(?:COUNT|SUM|AVG|MAX|MIN)\s*\(|\)", ""),
            F.lit("_"),
            F.lit(" "),
        )
    )
    return F.coalesce(chain, cleaned, F.lit("items"))


def is_aggregation_question(question: Column) -> Column:
    return question.rlike("(?i)" + fv.AGGREGATION_PATTERN)


def answer_style(question: Column, has_structured: Column) -> Column:
    """One of six answer styles, by the first keyword group that matches."""
    lowered = F.lower(question)

    def rule(style: str, words: list[str]) -> Column:
        hit = contains_any(lowered, words)
        return hit & has_structured if style == "numeric" else hit

    first, *rest = fv.ANSWER_STYLES
    return reduce(
        lambda chain, entry: chain.when(rule(*entry), F.lit(entry[0])),
        rest,
        F.when(rule(*first), F.lit(first[0])),
    ).otherwise(F.lit("concise"))


def refusal_flag(answer: Column) -> Column:
    lowered = F.lower(answer)
    return contains_any(lowered, fv.REFUSAL_PHRASES) | (F.length(F.trim(lowered)) < 30)


def keyword_hit(answer: Column, keywords: Column) -> Column:
    lowered = F.lower(answer)
    return F.exists(keywords, lambda word: lowered.contains(word))


def route_reason(route: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(fv.ROUTE_REASONS), route), F.lit("Unknown routing decision")
    )


def table_route_reason(route: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(fv.TABLE_ROUTE_REASONS), route),
        F.lit("Unknown routing decision"),
    )


def is_not_available(text: Column) -> Column:
    return contains_any(F.lower(text), fv.NOT_AVAILABLE_PHRASES)


def needs_chart(question: Column, strict: bool = False) -> Column:
    """Does the question ask for something to draw?"""
    lowered = F.lower(question)
    return (contains_any if strict else contains_word)(lowered, fv.PLOT_WORDS)


def chart_type(question: Column, x_column: Column, strict: bool = False) -> Column:
    """bar, line or pie: an explicit wish first, then share words, then a time axis."""
    lowered = F.lower(question)
    has = contains_any if strict else contains_word
    kinds = list(fv.CHART_TYPES)
    chain = F.when(has(lowered, fv.CHART_TYPES[kinds[0]]), F.lit(kinds[0]))
    for kind in kinds[1:]:
        chain = chain.when(has(lowered, fv.CHART_TYPES[kind]), F.lit(kind))
    chain = chain.when(contains_any(lowered, fv.SHARE_WORDS), F.lit("pie"))
    chain = chain.when(contains_any(F.lower(x_column), fv.TIME_AXIS_WORDS), F.lit("line"))
    return chain.otherwise(F.lit("bar"))


def forecast_summary_text(
    value_name: Column, periods: Column, last_actual: Column, next_forecast: Column, anomalies: Column
) -> Column:
    """Template sentences about one forecast."""
    def two(number: Column) -> Column:
        return F.call_function("format_number", number, F.lit("0.00"))

    return F.concat(
        F.lit("Forecast for **"), value_name, F.lit("** over the next "),
        periods.cast("string"), F.lit(" periods. Last actual value: **"), two(last_actual),
        F.lit("**."),
        F.when(
            next_forecast.isNotNull(),
            F.concat(F.lit(" Next period forecast: **"), two(next_forecast), F.lit("**.")),
        ).otherwise(F.lit("")),
        F.when(
            anomalies > 0,
            F.concat(
                F.lit(" **"), anomalies.cast("string"),
                F.lit(" anomaly/anomalies** detected outside the 95% confidence interval."),
            ),
        ).otherwise(F.lit(" No anomalies detected — data is within expected bounds.")),
    )
