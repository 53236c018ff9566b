import pytest
from pyspark.sql import functions as F

from insight_spark.operators import charts, profile as prof, relational as rel


@pytest.fixture(scope="module")
def patients(spark):
    rows = [(f"P{i:03d}", 30 + i, "Oncology" if i < 18 else "ICU", f"note {i} is long", 1000.5 * i, i % 5, "2024-01-%02d" % (i % 28 + 1)) for i in range(40)]
    rows.append(("P999", None, "Lonely", None, 5.0, 1, None))
    return spark.createDataFrame(
        rows, "PatientID string, Age int, Department string, Notes string, TreatmentCost_USD double, LengthOfStay_Days int, AdmitDate string"
    )


def test_roles(patients):
    assert prof.role_map(patients) == {
        "PatientID": "id", "Age": "numeric", "Department": "categorical", "Notes": "text", "TreatmentCost_USD": "numeric",
        "LengthOfStay_Days": "numeric", "AdmitDate": "date",
    }
    strict = prof.role_map(patients, strict=True)
    assert strict["LengthOfStay_Days"] == "date" and strict["AdmitDate"] == "date"


def test_roles_of_hard_names(spark):
    df = spark.createDataFrame([(7, 1.5, "x", 2020), (8, 2.5, "y", 2021)], "PatientID int, Width double, casino string, fiscal_year int")
    assert prof.role_map(df) == {"PatientID": "id", "Width": "numeric", "casino": "id", "fiscal_year": "date"}
    assert prof.role_map(df, strict=True) == {"PatientID": "numeric", "Width": "date", "casino": "id", "fiscal_year": "date"}


def test_schema_roles(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "3", "a", 2.0)], "order_id int, due string, amount string, kind string, created double")
    got = {r["column"]: r["role"] for r in prof.schema_roles(df, ["order_id"]).collect()}
    assert got == {"order_id": "id", "due": "date", "amount": "numeric", "kind": "categorical", "created": "date"}


def test_narrative(patients):
    rows = {r["record_id"]: r["text"] for r in prof.row_narratives(patients, prof.role_map(patients), "p.csv").collect()}
    assert rows["P005"] == (
        "Patient P005 — Age: 35. Department: Oncology. Notes: note 5 is long. Treatment Cost USD: $5,002. "
        "Length Of Stay Days: 0. Admit Date: 2024-01-06."
    )
    assert rows["P999"] == "Patient P999 — Department: Lonely. Treatment Cost USD: $5.00. Length Of Stay Days: 1."


def test_group_summary(patients):
    rows = {r["group_val"]: r["text"] for r in prof.group_summaries(patients, prof.role_map(patients), "p.csv", ["PatientID"]).collect()}
    assert set(rows) == {"Oncology", "ICU"}
    lines = rows["Oncology"].split("\n")
    assert lines[0] == "Oncology Department — 18 patients:"
    assert lines[1] == "  - P000: 30, note 0 is long, $0.00, 0, 2024-01-01"
    assert len(lines) == 18 and lines[16] == "  ... and 3 more."
    assert lines[17] == "Averages — Average Age: 38.50. Average Treatment Cost USD: $8,504. Average Length Of Stay Days: 1.83."


def test_overview(patients):
    text = prof.dataset_overview(patients, prof.role_map(patients), "p.csv").first()["text"].split("\n")
    assert text[:3] == ["Dataset overview — p.csv", "Contains 41 patients with 7 attributes.", "Department breakdown: ICU (22), Oncology (18), Lonely (1)."]
    assert text[3] == "Age: ranges 30–69, average 49.50."


def test_plain_rows(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(12)], "id int, name string")
    rows = prof.plain_row_chunks(df, "f.xlsx", ["id"], sheet="S1").collect()
    assert sorted(r["row"] for r in rows if r["type"] == "excel_row") == list(range(12))
    summary = next(r["text"] for r in rows if r["type"] == "excel")
    assert summary == "Excel File: f.xlsx, Sheet: S1\nColumns: id, name\nTotal Rows: 12\n\nSample:\nid: 0, name: n0\nid: 1, name: n1\nid: 2, name: n2"
    assert next(r["text"] for r in rows if r["row"] == 3) == "From f.xlsx, Sheet 'S1', Row 3:\nid: 3, name: n3"


def test_guard_and_text(spark):
    empty = spark.createDataFrame([], "k int, v string")
    assert tuple(rel.guard_empty_or_sentinel(empty, ["k"]).first())[:2] == (0, True)
    sentinel = spark.createDataFrame([(1, "This information is NOT AVAILABLE in the uploaded data")], "k int, v string")
    assert rel.guard_empty_or_sentinel(sentinel, ["k"]).first()["not_available"]
    fine = spark.createDataFrame([(1, "x"), (2, "no results")], "k int, v string")
    assert not rel.guard_empty_or_sentinel(fine, ["k"]).first()["not_available"]
    assert rel.result_text(empty, ["k"]).first()["text"] == "No results found."
    assert rel.result_text(spark.createDataFrame([(42,)], "n int"), ["n"]).first()["text"] == "Result: 42"
    assert rel.result_text(fine, ["k"]).first()["text"] == "Found 2 result(s):\n\n• k: 1, v: x\n• k: 2, v: no results\n"


def test_month_sort(spark):
    df = spark.createDataFrame([("Mar", 1), ("Jan", 2), ("unknown", 3), ("Feb", 4)], "Month string, v int")
    assert [r["Month"] for r in rel.sort_month_names(df, ["v"]).collect()] == ["Jan", "Feb", "Mar", "unknown"]
    other = spark.createDataFrame([("b", 1), ("a", 2)], "Month string, v int")
    assert [r["v"] for r in rel.sort_month_names(other, ["v"]).collect()] == [1, 2]


def test_chart_needs_numbers_and_rows(spark):
    good = spark.createDataFrame([("Jan", "1.5"), ("Feb", "2")], "month string, total string")
    row = charts.chart_spec(good, "revenue please", ["month"]).first()
    assert (row["type"], row["x"], row["y"], row["title"]) == ("line", ["Feb", "Jan"], [2.0, 1.5], "total by month")
    assert charts.chart_spec(good.limit(1), "q", ["month"]).count() == 0
    assert charts.chart_spec(good.withColumn("total", F.lit("x")), "q", ["month"]).count() == 0


def test_dates_in_many_forms(spark):
    values = ["2024-01-05", "2024-01-05 10:00:00", "1/5/2024", "Jan 2024", "January 2024", "Jan 5, 2024", "5-Jan-2024", "2024/1/5", "2024", "17", "x", "2024-02-30"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r["d"] for r in df.select("i", F.date_format(rel.coerce_date(F.col("s")), "yyyy-MM-dd").alias("d")).orderBy("i").collect()]
    assert got == ["2024-01-05"] * 3 + ["2024-01-01"] * 2 + ["2024-01-05"] * 3 + ["2024-01-01"] + [None] * 3


def test_chart_says_when_points_are_left_out(spark):
    from insight_spark.operators import charts

    months = spark.createDataFrame([(f"2020-{i:03d}", float(i)) for i in range(80)], "month string, total double")
    cut = charts.chart_spec(months, "revenue", ["month"]).first()
    assert len(cut["x"]) == 50 and cut["truncated"]
    whole = charts.chart_spec(months, "revenue", ["month"], points=80).first()
    assert len(whole["x"]) == 80 and not whole["truncated"] and whole["y"][-1] == 79.0
