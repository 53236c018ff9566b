"""Quality measures over logs of questions, predictions and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.functions.logs import keyword_hit, refusal_flag
from insight_spark.operators.relational import agg_accuracy, agg_confusion
from insight_spark.operators.scale import kept, value_at_index

ROUTES = ["sql", "document", "hybrid", "general", "forecast"]


def eval_routing(log: DataFrame, expected: str = "expected", predicted: str = "predicted") -> dict[str, DataFrame]:
    """Overall and per-category accuracy, confusion over all five routes, failures."""
    return {
        "overall": agg_accuracy(log, expected, predicted),
        "per_category": agg_accuracy(log, expected, predicted, expected),
        "confusion": agg_confusion(log, expected, predicted, ROUTES),
        "failures": log.filter(F.col(expected) != F.col(predicted)),
    }


def eval_retrieval(log: DataFrame, answer: str = "answer", keywords: str = "keywords") -> DataFrame:
    """Hit rate: answers with at least one expected keyword."""
    hit = keyword_hit(F.col(answer), F.col(keywords))
    return log.agg(
        F.count_if(hit).alias("hits"),
        F.count("*").alias("total"),
        F.round(F.count_if(hit) * 100.0 / F.count("*"), 1).alias("hit_rate_pct"),
    )


def retrieval_misses(log: DataFrame, answer: str = "answer", keywords: str = "keywords") -> DataFrame:
    """The rows whose answer has none of its keywords; an answer that is null has none."""
    return log.filter(~F.coalesce(keyword_hit(F.col(answer), F.col(keywords)), F.lit(False)))


def latency_per_question(log: DataFrame, question: str, route: str, seconds: str) -> DataFrame:
    return log.groupBy(question, route).agg(F.avg(seconds).alias("mean_s"))


def eval_latency(log: DataFrame, question: str, route: str, seconds: str) -> DataFrame:
    """Mean per question, then mean and 95th-percentile-by-index per class and overall."""
    means = kept(latency_per_question(log, question, route, seconds), "latency")
    per_class = means.groupBy(F.col(route).alias("class")).agg(F.avg("mean_s").alias("avg_s"), F.count("*").alias("questions"))
    per_class_p95 = value_at_index(means.withColumnRenamed(route, "class"), ["class"], "mean_s", 0.95, "p95_s")
    overall = means.agg(F.avg("mean_s").alias("avg_s"), F.count("*").alias("questions")).withColumn("class", F.lit("overall"))
    overall_p95 = value_at_index(means, [], "mean_s", 0.95, "p95_s").withColumn("class", F.lit("overall"))
    stats = per_class.unionByName(overall).join(per_class_p95.unionByName(overall_p95), "class")
    return stats.select("class", "questions", F.round("avg_s", 3).alias("avg_s"), F.round("p95_s", 3).alias("p95_s"))


def eval_guard(log: DataFrame, answer: str = "answer") -> DataFrame:
    """Share of questions that were refused; rate-limited answers do not count."""
    kept = log.filter(~_rate_limited(answer))
    guarded = refusal_flag(F.col(answer))
    return kept.agg(
        F.count_if(guarded).alias("guarded"),
        F.count("*").alias("total"),
        F.round(F.count_if(guarded) * 100.0 / F.count("*"), 1).alias("guard_rate_pct"),
    )


def _rate_limited(answer: str) -> Column:
    return F.lower(F.col(answer)).contains("rate limit") | F.col(answer).contains("429")


def guard_slippages(log: DataFrame, answer: str = "answer", chars: int = 100) -> DataFrame:
    """The rows that were answered instead of refused, with the start of the answer as ``snippet``."""
    leaked = log.filter(~_rate_limited(answer) & ~refusal_flag(F.col(answer)))
    return leaked.withColumn("snippet", F.substring(F.lower(F.col(answer)), 1, chars))


def eval_language(log: DataFrame, expected: str = "expected", detected: str = "detected") -> DataFrame:
    return log.agg(
        F.count_if(F.col(expected) == F.col(detected)).alias("correct"),
        F.count("*").alias("total"),
        F.round(F.count_if(F.col(expected) == F.col(detected)) * 100.0 / F.count("*"), 1).alias("accuracy_pct"),
        F.count_distinct(detected).alias("languages"),
    )


def grade(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= low, F.lit(name)) for low, name in fv.GRADES], F.lit(fv.LOWEST_GRADE))


def eval_overall(scores: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Mean of the scores and its grade."""
    return (
        scores.groupBy(*(by or []))
        .agg(F.avg(score).alias("_mean"))
        .select(*(by or []), F.round("_mean", 1).alias("overall"), grade(F.col("_mean")).alias("grade"))
    )
