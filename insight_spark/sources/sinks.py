"""Evaluation results as JSON and as a text report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_lines(title: str, sections: dict[str, DataFrame]) -> DataFrame:
    """A report as (line_no, value): per section a heading and one line per row.

    Sections are small summaries; their rows are sorted by their text.
    """
    first = next(iter(sections.values()))
    out = first.sparkSession.createDataFrame([(0, 0, "", f"{'=' * 70}"), (0, 1, "", title), (0, 2, "", "=" * 70)], "s int, n int, k string, value string")
    for number, (name, df) in enumerate(sections.items(), start=1):
        heading = df.sparkSession.createDataFrame(
            [(number, 0, "", name.upper()), (number, 1, "", "-" * 70)], "s int, n int, k string, value string"
        )
        line = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns])
        rows = df.select(F.lit(number).alias("s"), F.lit(2).alias("n"), line.alias("k"), line.alias("value"))
        out = out.unionByName(heading).unionByName(rows)
    return out.orderBy("s", "n", "k")


def write_report(title: str, sections: dict[str, DataFrame], path: str) -> None:
    """One text file: a report has few lines, so a single output file is fine."""
    report_lines(title, sections).select("value").coalesce(1).write.mode("overwrite").text(path)
