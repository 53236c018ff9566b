from pyspark.sql import functions as F

from insight_spark.operators import routing

# Labelled questions and the route the rules give with a table, a
# document and no vocabulary.
BENCHMARK = [
    ("how many rows are in the dataset", "SQL"), ("what is the total revenue", "SQL"), ("show me the top 5 products by sales", "SQL"),
    ("what is the average salary", "SQL"), ("list all unique departments", "SQL"), ("what is the maximum value in the dataset", "SQL"),
    ("count transactions by month", "SQL"), ("plot revenue over time", "SQL"),
    ("compare the data trends with what the document says", "HYBRID"), ("why are sales declining based on the report", "HYBRID"),
    ("what factors explain the numbers in the spreadsheet", "HYBRID"), ("hello how are you", "GENERAL"), ("what can you do", "GENERAL"),
    ("explain what machine learning is", "GENERAL"), ("forecast sales for the next 6 months", "FORECAST"),
    ("predict revenue for next quarter", "FORECAST"), ("what will the trend look like next year", "FORECAST"),
    ("detect anomalies in the time series", "FORECAST"), ("show me a projection for the next 12 periods", "FORECAST"),
    ("is there an outlier in the data over time", "FORECAST"), ("what were last year's unaudited internal projections", "SQL"),
]


def routes(spark, questions, docs=True, csv=True, files=("a.csv", "b.txt"), strict=False, hint=None, dominant=None):
    df = spark.createDataFrame(list(enumerate(questions)), "i int, q string")
    route = routing.classify_route(
        F.col("q"), F.lit(docs), F.lit(csv), F.array(*[F.lit(f) for f in files]),
        None if hint is None else F.lit(hint), None if dominant is None else F.lit(dominant), strict,
    )
    return [r["r"] for r in df.select("i", route.alias("r")).orderBy("i").collect()]


def test_labelled_questions(spark):
    assert routes(spark, [q for q, _ in BENCHMARK]) == [r for _, r in BENCHMARK]


def test_document_questions_of_a_document_session(spark):
    asked = ["summarize the uploaded document", "what are the key findings in the report", "what does the file say about strategy"]
    assert routes(spark, asked, csv=False) == ["DOCUMENT"] * 3
    assert routes(spark, asked, docs=False, csv=False) == ["GENERAL"] * 3


def test_word_ends_and_strict(spark):
    asked = ["highest revenue by region", "history of sales", "read the paragraph on stock"]
    assert routes(spark, asked, hint="document") == ["DOCUMENT", "DOCUMENT", "DOCUMENT"]
    assert routes(spark, asked, hint="document", strict=True) == ["GENERAL", "GENERAL", "SQL"]


def test_vocabulary_hints(spark):
    asked = ["attendance of staff", "compare attendance"]
    assert routes(spark, asked, hint="csv") == ["SQL", "HYBRID"]
    assert routes(spark, asked, hint="document") == ["DOCUMENT", "HYBRID"]
    assert routes(spark, asked[:1], hint="tie", dominant="csv") == ["SQL"]
    assert routes(spark, asked[:1], hint="tie", dominant="document") == ["DOCUMENT"]
    assert routes(spark, asked[:1], hint="tie") == ["HYBRID"]
    assert routes(spark, asked[:1], hint="document", files=("a.csv", "b.xlsx")) == ["SQL"]


def test_definition_with_data(spark):
    asked = ["explain what score means and show top 5 districts", "what is the maximum value, show it"]
    assert routes(spark, asked) == ["HYBRID", "SQL"]


def test_table_router(spark):
    df = spark.createDataFrame([("hi", True), ("sum of sales", True), ("bar chart please", True), ("describe it", True), ("describe it", False)], "q string, c boolean")
    assert [r[0] for r in df.select(routing.csv_route(F.col("q"), F.col("c"))).collect()] == ["SQL", "SQL", "SQL", None, "RAG"]


def test_sql_route_without_table(spark):
    df = spark.range(1)
    assert df.select(routing.route_final(F.lit("SQL"), F.lit(False))).first()[0] == "GENERAL"
