"""Chart specifications from query results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.functions.logs import chart_type
from insight_spark.operators.relational import number_of


def chart_points(df: DataFrame, order: list[str], points: int = fv.CHART_POINTS) -> DataFrame:
    """The rows a chart draws: the first ``points`` by ``order``."""
    return df.orderBy(*order).limit(points)


def chart_spec(
    df: DataFrame, question: str, order: list[str], strict: bool = False, points: int = fv.CHART_POINTS
) -> DataFrame:
    """One row (type, x, y, x_label, y_label, title, truncated); no row when there
    is nothing to draw: fewer than two rows or a y value that is no number.

    First column is x, second is y. Only the drawn points are collected, at most
    ``points``; ``truncated`` tells that there are more.
    """
    x, y = df.columns[0], df.columns[1] if len(df.columns) > 1 else df.columns[0]
    drawn = chart_points(df, order, points + 1).select(
        F.struct(*order).alias("_key"),
        F.col(x).cast("string").alias("_x"),
        number_of(df, y).alias("_y"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("_key", "_x", "_y")))
    return (
        drawn.agg(ordered.alias("_all"))
        .select(F.slice("_all", 1, points).alias("_p"), (F.size("_all") > points).alias("_more"))
        .select("*", F.size("_p").alias("_n"), F.size(F.filter("_p", lambda p: p["_y"].isNotNull())).alias("_numbers"))
        .filter((F.col("_n") >= fv.CHART_MIN_ROWS) & (F.col("_n") == F.col("_numbers")))
        .select(
            chart_type(F.lit(question), F.lit(x), strict).alias("type"),
            F.transform("_p", lambda p: p["_x"]).alias("x"),
            F.transform("_p", lambda p: p["_y"]).alias("y"),
            F.lit(x).alias("x_label"),
            F.lit(y).alias("y_label"),
            F.lit(f"{y} by {x}").alias("title"),
            F.col("_more").alias("truncated"),
        )
    )
