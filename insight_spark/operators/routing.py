"""Which kind of answer a question needs, as one ordered rule cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.functions.text import contains_any, contains_word, starts_with_any, words_of
from insight_spark.operators.relational import agg_dominant
from insight_spark.operators.scale import HOT_LEAST, kept, lookup


def is_general(question: Column, strict: bool = False) -> Column:
    """Greeting, capability question, or general knowledge.

    ``strict`` keeps greetings without a word end, so that "highest" counts as "hi".
    """
    lowered = F.trim(F.lower(question))
    patterns = [p if strict or p.endswith(r"\b") else p + r"\b" for p in fv.GENERAL_PATTERNS]
    return (
        lowered.rlike("|".join(f"(?:{p})" for p in patterns))
        | contains_any(lowered, fv.GENERAL_TOPICS)
        | (starts_with_any(lowered, fv.GENERAL_STARTERS) & ~contains_any(lowered, fv.DATA_SIGNALS))
    )


def is_forecast(question: Column) -> Column:
    lowered = F.lower(question)
    return ~contains_any(lowered, fv.HISTORICAL_SIGNALS) & contains_any(lowered, fv.FORECAST_WORDS)


def csv_route(question: Column, has_csv: Column) -> Column:
    """SQL, RAG, or null when the fixed patterns leave the question open."""
    q = F.trim(question)
    return (
        F.when(question.isNull() | (F.length(q) < 3), F.lit("SQL"))
        .when(~has_csv, F.lit("RAG"))
        .when(q.rlike("(?i)" + fv.CHART_QUESTION_PATTERN), F.lit("SQL"))
        .when(q.rlike("(?i)" + fv.TABLE_QUESTION_PATTERN), F.lit("SQL"))
    )


def only_table_files(files: Column) -> Column:
    """True when every file of the session is a CSV or Excel file."""
    return F.forall(
        files, lambda f: F.lower(F.element_at(F.split(f, r"\."), -1)).isin(*fv.TABLE_FILE_TYPES)
    )


def classify_route(
    question: Column, has_docs: Column, has_csv: Column, files: Column,
    hint: Column | None = None, dominant: Column | None = None, strict: bool = False,
) -> Column:
    """GENERAL, FORECAST, DOCUMENT, SQL or HYBRID; the first rule that holds decides.

    ``hint`` is the vocabulary hint (csv, document, tie, or null when there is no
    vocabulary); ``dominant`` the majority source of the best chunks on a tie. An
    undecided question goes to SQL. Stateless, so it also runs on a stream.
    """
    hint = F.lit(None).cast("string") if hint is None else hint
    dominant = F.lit("mixed") if dominant is None else dominant
    q = F.lower(question)
    chart_words = contains_any(q, fv.CHART_WORDS) if strict else contains_word(q, fv.CHART_WORDS)
    mixed = has_docs & has_csv & ~only_table_files(files)
    by_table = F.when(contains_any(q, fv.TABLE_COMPARISON_WORDS), F.lit("HYBRID")).otherwise(F.lit("SQL"))
    by_document = F.when(contains_any(q, fv.CROSS_SOURCE_WORDS), F.lit("HYBRID")).otherwise(F.lit("DOCUMENT"))
    by_chunks = (
        F.when(dominant == "csv", F.lit("SQL"))
        .when(dominant == "document", F.lit("DOCUMENT"))
        .otherwise(F.lit("HYBRID"))
    )
    definition = (
        contains_any(q, fv.DEFINITION_WORDS)
        & contains_any(q, fv.DATA_REQUEST_WORDS)
        & ~contains_any(q, fv.PURE_METRIC_WORDS)
    )
    return (
        F.when(is_general(question, strict), F.lit("GENERAL"))
        .when(has_csv & is_forecast(question), F.lit("FORECAST"))
        .when(~has_docs & ~has_csv, F.lit("GENERAL"))
        .when(has_docs & ~has_csv, F.lit("DOCUMENT"))
        .when(has_csv & chart_words, F.lit("SQL"))
        .when(mixed & (hint == "csv"), by_table)
        .when(mixed & (hint == "document"), by_document)
        .when(mixed & (hint == "tie"), by_chunks)
        .when(contains_any(q, fv.HYBRID_WORDS), F.lit("HYBRID"))
        .when(definition, F.lit("HYBRID"))
        .otherwise(F.lit("SQL"))
    )


def source_hint(
    questions: DataFrame, vocabulary: DataFrame, query_id: str, question: str, keys: list[str] | None = None
) -> DataFrame:
    """Vocabulary hits per question and the side with more: csv, document or tie.

    ``vocabulary`` is (keys, term, vocabulary). Intent words never count.
    """
    keys = keys or []
    terms = F.array_except(words_of(F.col(question)), F.array(*[F.lit(w) for w in fv.INTENT_WORDS]))
    asked = kept(questions.select(query_id, *keys, F.explode(F.array_distinct(terms)).alias("term")), "question-words")
    # One row per word, so a word that is in every question is looked up and not joined pair by pair.
    sides = vocabulary.groupBy(*keys, "term").agg(
        F.count_if(F.col("vocabulary") == "csv").alias("csv"), F.count_if(F.col("vocabulary") == "document").alias("document")
    )
    found = lookup(asked, sides, [*keys, "term"], HOT_LEAST)
    hits = found.groupBy(query_id).agg(
        F.coalesce(F.sum("csv"), F.lit(0)).alias("csv_hits"), F.coalesce(F.sum("document"), F.lit(0)).alias("doc_hits")
    )
    return (
        questions.select(query_id)
        .join(hits, query_id, "left")
        .fillna(0, ["csv_hits", "doc_hits"])
        .withColumn(
            "hint",
            F.when(F.col("csv_hits") > F.col("doc_hits"), F.lit("csv"))
            .when(F.col("doc_hits") > F.col("csv_hits"), F.lit("document"))
            .otherwise(F.lit("tie")),
        )
    )


def source_dominance(hits: DataFrame, query_id: str, source_type: str, rank: str = "rank") -> DataFrame:
    """Majority source type of the three best chunks per question, else "mixed"."""
    return agg_dominant(hits, query_id, source_type, rank, 3)


def route_final(route: Column, has_table: Column) -> Column:
    """A table route without any table of the session is answered as GENERAL."""
    return F.when((route == "SQL") & ~has_table, F.lit("GENERAL")).otherwise(route)


def combine_hybrid(
    table_answers: DataFrame, document_answers: DataFrame, key: str
) -> DataFrame:
    """One answer per question from the table and the document answer.

    Inputs: (key, table_text, row_count) and (key, document_text, not_found).
    """
    both = table_answers.join(document_answers, key, "full")
    table_text = F.coalesce("table_text", F.lit(""))
    document_text = F.coalesce("document_text", F.lit(""))
    no_table = (
        (table_text == "")
        | F.lower(table_text).contains("not available")
        | (F.coalesce("row_count", F.lit(1)) == 0)
    )
    no_document = F.coalesce("not_found", F.lit(False))
    used = (
        F.when(no_table & no_document, F.lit("none"))
        .when(no_table, F.lit("document"))
        .when(no_document, F.lit("table"))
        .otherwise(F.lit("both"))
    )
    text = (
        F.when(F.col("used") == "none", F.lit(fv.NOT_AVAILABLE_FILES_ANSWER))
        .when(F.col("used") == "document", F.trim(document_text))
        .when(F.col("used") == "table", F.trim(table_text))
        .otherwise(
            F.concat(
                F.lit("**Data Analysis:**\n"), F.trim(table_text),
                F.lit("\n\n**Document Context:**\n"), F.trim(document_text),
            )
        )
    )
    return both.withColumn("used", used).select(key, "used", text.alias("answer"))
