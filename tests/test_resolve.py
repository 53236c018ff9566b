import pytest
from pyspark.sql import functions as F

from insight_spark.operators import resolve


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(
        [("Jan", "Technology & Engineering", 1), ("Feb", "Sales", 2), ("May", "Human-Resources", 3)], "Month string, Dept string, n int"
    )
    return resolve.value_forms(df, "up")


def test_values(spark, index):
    cases = {
        "January": ("Jan", "canonical"), "jan": ("Jan", "canonical"), "Jan": ("Jan", "exact"), "2024-02": ("Feb", "month"),
        "januray": ("januray", "unchanged"), "human resources": ("Human-Resources", "canonical"),
        "technology engineering": ("Technology & Engineering", "canonical"), "Salse": ("Sales", "fuzzy"), "nothing": ("nothing", "unchanged"),
    }
    literals = spark.createDataFrame([("up", v, None) for v in cases], "table string, literal string, hint string")
    got = {r["literal"]: (r["resolved"], r["method"]) for r in resolve.resolve_values(literals, index).collect()}
    assert got == cases


def test_fuzzy_month(spark):
    df = spark.createDataFrame([("January",), ("February",)], "Month string")
    literals = spark.createDataFrame([("t", "januray", None)], "table string, literal string, hint string")
    row = resolve.resolve_values(literals, resolve.value_forms(df, "t")).first()
    assert (row["resolved"], row["method"]) == ("January", "fuzzy")


def test_hint_goes_first(spark):
    df = spark.createDataFrame([("North", "NORTH")], "a string, b string")
    index = resolve.value_forms(df, "t")
    literals = spark.createDataFrame([("t", "north", None), ("t", "north", "b")], "table string, literal string, hint string")
    got = {r["hint"]: r["resolved"] for r in resolve.resolve_values(literals, index).collect()}
    assert got == {None: "North", "b": "NORTH"}


def test_columns(spark):
    names = spark.createDataFrame(
        [("t", c, i) for i, c in enumerate(["Month", "Revenue", "New_Customers", "Avg_Deal_Size"])], "table string, column string, pos int"
    )
    cases = {
        "average deal size": ("Avg_Deal_Size", "canonical"), "avg deal size": ("Avg_Deal_Size", "canonical"), "deal": ("Avg_Deal_Size", "canonical"),
        "rev": ("Revenue", "expanded"), "revenu": ("Revenue", "fuzzy"), "zzz": ("zzz", "unchanged"), "new customers": ("New_Customers", "canonical"),
    }
    asked = spark.createDataFrame([("t", c) for c in cases], "table string, asked string")
    got = {r["asked"]: (r["resolved"], r["method"]) for r in resolve.resolve_column(asked, resolve.column_forms(names)).collect()}
    assert got == cases


def test_rewrite(spark, index):
    rows = [
        (1, "SELECT * FROM up WHERE Month = 'January' AND n > '3' OR Dept IN ('salse', 'sales')"), (2, "SELECT \"Month\" FROM up"),
        (3, "SELECT 'January'"),
    ]
    df = spark.createDataFrame(rows, "sql_id int, sql string").withColumn("table", F.lit("up"))
    got = {r["sql_id"]: r["rewritten"] for r in resolve.rewrite_literals(df, index).collect()}
    assert got == {
        1: "SELECT * FROM up WHERE Month = 'Jan' AND n > '3' OR Dept IN ('Sales', 'Sales')", 2: "SELECT \"Month\" FROM up", 3: "SELECT 'Jan'",
    }


def test_a_quote_in_a_stored_value_is_escaped(spark):
    from insight_spark.operators import resolve

    names = spark.createDataFrame([("O'Brien Ltd",), ("Plain",)], "name string")
    index = resolve.value_forms(names, "t")
    logged = spark.createDataFrame([(1, "t", "SELECT 1 FROM t WHERE name = 'obrien ltd' OR name = 'plain' OR x = 'zzz'")], "sql_id int, table string, sql string")
    out = resolve.rewrite_literals(logged, index).first()["rewritten"]
    assert "'plain'" not in out and "'Plain'" in out and "'zzz'" in out
    assert "'O''Brien Ltd'" in out or "'obrien ltd'" in out
