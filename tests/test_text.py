"""String functions against a plain-Python model."""

import re
import string
from datetime import datetime

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.functions import logs, text as tx

WORDS = st.lists(st.text(alphabet=string.printable + "éßñ漢", max_size=20), min_size=1, max_size=60)


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r["x"] for r in df.select("i", expr(F.col("s")).alias("x")).orderBy("i").collect()]


def model_token(s):
    kept = "".join(" " if c in "_-/\\|" else c for c in s.lower())
    kept = "".join(c for c in kept if c.isalnum() or c == "_" or c in " \t\n\r\x0b\x0c")
    return " ".join(kept.split())


@settings(max_examples=8, deadline=None)
@given(WORDS)
def test_normalize_token(spark, values):
    assert column(spark, values, tx.normalize_token) == [model_token(v) for v in values]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*fv.ABBREVIATIONS, "size", "deal"]), min_size=1, max_size=4), min_size=1, max_size=40))
def test_expand_abbreviations(spark, phrases):
    values = [" ".join(p) for p in phrases]
    expected = [" ".join(fv.ABBREVIATIONS.get(w, w) for w in p) for p in phrases]
    assert column(spark, values, tx.expand_abbreviations) == expected


@settings(max_examples=8, deadline=None)
@given(WORDS)
def test_words_of(spark, values):
    expected = [re.findall(r"\b[a-zA-Z]{3,}\b", v.lower()) for v in values]
    assert column(spark, values, tx.words_of) == expected


def model_month(value):
    for fmt in ("%b", "%B", "%m", "%Y-%m", "%m/%Y", "%b %Y", "%B %Y"):
        try:
            return datetime.strptime(value.strip(), fmt).strftime("%B")
        except ValueError:
            continue
    return None


def test_parse_month(spark):
    values = [
        "Jan", "jan", "JAN", "January", "1", "01", "12", "13", "0", "2024-01", "2024-1", "2024-13", "01/2024",
        "Jan 2024", "january  2024", "May", "Sept", "Sep 24", "", "March 2024 x", " june ", "2024", "1/24",
    ]
    assert column(spark, values, tx.parse_month) == [model_month(v) for v in values]


def test_month_number(spark):
    assert column(spark, ["Jan", " may", "09", "9", "13", "x", "december"], tx.month_number) == [1, 5, 9, 9, None, None, 12]


def test_humanize_and_record_type(spark):
    names = ["TreatmentCost_USD", "LengthOfStay_Days", "PerformanceScore"]
    assert column(spark, names, tx.humanize_column) == ["Treatment Cost USD", "Length Of Stay Days", "Performance Score"]
    ids = ["PatientID", "EmployeeId", "OrderNo", "ItemNumber", "ID", "Zip Code", "Casino"]
    assert column(spark, ids, tx.record_type) == ["Patient", "Employee", "Order", "Item", "Record", "Zip", "Casi"]


def test_format_value(spark):
    def shown(name, values, role="numeric"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
        return [r["x"] for r in df.select("i", tx.format_value(name, F.col("v"), role).alias("x")).orderBy("i").collect()]

    assert shown("TreatmentCost_USD", [67000.0, 99.5, 2.675, 100.5, None]) == ["$67,000", "$99.50", "$2.67", "$100", "N/A"]
    assert shown("Salary_LPA", [11.45, 1234.25]) == ["11.4 LPA" if f"{11.45:,.1f}" == "11.4" else "11.5 LPA", "1,234.2 LPA"]
    assert shown("Churn_Rate", [2.25]) == ["2.2%"]
    assert shown("Age", [72.0, 72.5, 0.125]) == ["72", "72.50", "0.12"]
    assert shown("Name", [1.5], "text") == ["1.5"]


def test_table_name(spark):
    df = spark.createDataFrame([("abcdefgh-1", "/x/Sales Report H1.2025.csv"), ("c", "n" * 80 + ".xlsx")], "c string, f string")
    got = [r[0] for r in df.select(tx.table_name_for(F.col("c"), F.col("f"))).collect()]
    assert got == ["upload_abcdefgh_sales_report_h1_2025", ("upload_c_" + "n" * 80)[:63]]
    from insight_spark.sources.tables import upload_table_name

    assert [upload_table_name("abcdefgh-1", "/x/Sales Report H1.2025.csv"), upload_table_name("c", "n" * 80 + ".xlsx")] == got


def test_clean_sql(spark):
    values = [
        "```sql\nSELECT MAX col FROM t;\n```", "SELECT a -- note\nFROM t", "SELECT /* x\ny */ a FROM t;", "SELECT COUNT(*) FROM t",
        'select avg "Deal Size" from t',
    ]
    assert column(spark, values, logs.clean_sql_text) == [
        "SELECT MAX(col) FROM t", "SELECT a \nFROM t", "SELECT  a FROM t", "SELECT COUNT(*) FROM t", 'select avg "Deal Size" from t',
    ]


def test_primary_table(spark):
    values = ["SELECT 1 FROM `a` JOIN b", "update [t] set x = 1", "INSERT INTO \"up_1\" VALUES (1)", "SELECT 1"]
    assert column(spark, values, logs.primary_table) == ["a", "t", "up_1", None]


def test_periods_and_trend(spark):
    values = ["forecast next 12 months", "next 99 weeks", "0 periods", "two months", "in 3  Quarters"]
    assert column(spark, values, logs.extract_periods) == [12, 36, 1, 6, 3]
    df = spark.createDataFrame([(100.0, 103.0), (100.0, 97.0), (100.0, 102.0), (0.0, 5.0)], "a double, f double")
    got = [r[0] for r in df.select(logs.trend_label(logs.percent_change(F.col("a"), F.col("f")))).collect()]
    assert got == ["upward", "downward", "stable", "stable"]


def test_entities(spark):
    values = ["How many repos?", "count of employees", "how many"]
    got = column(spark, values, lambda q: logs.entity_from_question(q, F.lit("COUNT(order_id)")))
    assert got == ["repositories", "employees", "order id"]


def test_answer_style(spark):
    values = ["When is it?", "How many rows", "give an overview", "why so", "list everything", "ok"]
    assert column(spark, values, lambda q: logs.answer_style(q, F.lit(True))) == ["direct", "numeric", "overview", "causal", "list", "concise"]
    assert column(spark, values[1:2], lambda q: logs.answer_style(q, F.lit(False))) == ["causal"]


def test_charts_whole_words_and_strict(spark):
    values = ["summarize the paragraph", "cut into pieces", "show a bar chart", "revenue breakdown", "plots of sales"]
    assert column(spark, values, logs.needs_chart) == [False, False, True, True, True]
    assert column(spark, values, lambda q: logs.needs_chart(q, strict=True)) == [True, False, True, True, True]
    chart = lambda strict: column(spark, values, lambda q: logs.chart_type(q, F.lit("order_month"), strict))
    assert chart(False) == ["line", "line", "bar", "pie", "line"]
    assert chart(True) == ["line", "pie", "bar", "pie", "line"]


def test_forecast_summary(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (1.0, None, 3)], "l double, n double, a int")
    got = [r[0] for r in df.select(logs.forecast_summary_text(F.lit("Revenue"), F.lit(6), F.col("l"), F.col("n"), F.col("a"))).collect()]
    assert got[0].endswith("Next period forecast: **2.00**. No anomalies detected — data is within expected bounds.")
    assert got[1].endswith("Last actual value: **1.00**. **3 anomaly/anomalies** detected outside the 95% confidence interval.")


def test_numbers_in_plain_notation_only(spark):
    from pyspark.sql import functions as F

    from insight_spark.functions.text import is_numeric_string
    from insight_spark.operators.relational import coerce_numeric

    cells = {"12": 12.0, " -1.5e3 ": -1500.0, ".5": 0.5, "7.": 7.0, "12d": None, "3F": None, "NaN": None, "inf": None, "": None, "1 2": None, None: None}
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", coerce_numeric(F.col("c")).alias("n"), is_numeric_string(F.col("c")).alias("is")).collect()
    assert {r["c"]: r["n"] for r in rows} == cells
    assert all(r["is"] == (cells[r["c"]] is not None) for r in rows)


def test_dates_as_they_are_written(spark):
    from pyspark.sql import functions as F

    from insight_spark.operators.relational import coerce_date

    cells = {
        "20240115": "2024-01-15 00:00", "2024.01.15": "2024-01-15 00:00", "01/15/2024 10:30": "2024-01-15 10:30",
        "15/03/2024": "2024-03-15 00:00", "03/04/2024": "2024-03-04 00:00", "March 5 2024": "2024-03-05 00:00", "Mar 5 2024": "2024-03-05 00:00",
        "2024Q1": "2024-01-01 00:00", "2024Q4": "2024-10-01 00:00", "Jan-2024": "2024-01-01 00:00", "March 5, 2024": "2024-03-05 00:00",
        "2024": "2024-01-01 00:00", "20241345": None, "12345678": None, "x": None, None: None,
    }
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", F.date_format(coerce_date(F.col("c")), "yyyy-MM-dd HH:mm").alias("d")).collect()
    assert {r["c"]: r["d"] for r in rows} == cells


def test_too_many_periods_are_clamped(spark):
    from pyspark.sql import functions as F

    from insight_spark.functions.logs import extract_periods

    asked = {"next 99999999999 months": 36, "0000000000012 weeks": 12, "some day": 6, "2 years": 2}
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", extract_periods(F.col("q")).alias("n")).collect()
    assert {r["q"]: r["n"] for r in rows} == asked
